"""What a task holds and what is shuffled stays bounded as the tables grow."""

import datetime as dt
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from mercato.ml import pipeline as M
from mercato.params import FIXTURE_PARAMS as P
from mercato.plans import reports as R
from mercato.plans import views as V


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_forest_holds_little_in_a_task(spark):
    forest = M.forest_pipeline(P).getStages()[-1]
    assert forest.getMaxMemoryInMB() <= 128  # every running task of an executor holds as much
    assert not forest.getCacheNodeIds()


def test_tasks_of_the_jobs_are_bounded(spark):
    from mercato.session import TASK_BYTES, bound_tasks

    size, dealt = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    import __spark_entry__ as entry

    spark.conf.unset(size)
    spark.conf.unset(dealt)
    entry.queries()["order_status_counts"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(size) == str(TASK_BYTES) and int(spark.conf.get(dealt)) >= 400
    spark.conf.set(size, "16k")
    bound_tasks(spark)
    assert spark.conf.get(size) == "16k"
    spark.conf.unset(size)


def test_seller_history_asof_counts_strictly_earlier_orders(spark):
    """A hot seller over many ranges, equal timestamps, orders of several sellers, missing keys; few shuffles."""
    rnd = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    orders = [(i, start + dt.timedelta(hours=rnd.randint(0, 400)), rnd.random() < 0.3, rnd.choice([None, 1, 5, 9]))
              for i in range(600)]
    items = [(i, rnd.choice([1, 1, 1, 1, 2, 3, None])) for i in range(600) for _ in range(rnd.randint(1, 3))]
    fo = spark.createDataFrame(
        orders, "order_id long, order_purchase_timestamp timestamp_ntz, is_late boolean, days_to_deliver int").select(
        "*", F.lit(P.delivered_status).alias("order_status"), F.lit(False).alias("has_placeholder_delivery_date"))
    star = SimpleNamespace(fact_orders=fo, fact_order_items=spark.createDataFrame(items, "order_id long, seller_id long"))
    out = V.seller_history_asof(star, P)
    assert _plan(out).count("Exchange hashpartitioning") <= 4  # each was one of several over all rows before
    per = {}
    for o, s in items:
        if s is not None:
            per[s, o] = per.get((s, o), 0) + 1
    by = {o[0]: o for o in orders}
    got = {(r.seller_id, r.order_id): r for r in out.collect()}
    assert set(got) == set(per)
    for (s, o), r in got.items():
        prior = [(by[x], n) for (t, x), n in per.items() if t == s and by[x][1] < by[o][1]]
        rows, late = sum(n for _, n in prior), sum(n for x, n in prior if x[2])
        days = [(x[3], n) for x, n in prior if x[3] is not None]
        assert r.seller_prior_orders == len(prior)
        assert (r.seller_prior_late_rate is None) == (rows == 0)
        if rows:
            assert abs(r.seller_prior_late_rate - 100 * late / rows) <= 0.005 + 1e-9
        assert (r.seller_prior_avg_days_to_deliver is None) == (not days)
        if days:
            mean = sum(d * n for d, n in days) / sum(n for _, n in days)
            assert abs(r.seller_prior_avg_days_to_deliver - mean) <= 0.05 + 1e-9


def test_unified_checks_shuffle_pairs_only(spark):
    rows = [("A", 1, None), ("A", 1, 2.0), ("A", 2, None), ("B", 3, 1.0), (None, None, None)]
    u = spark.createDataFrame(rows, "segment string, customer_unique_id long, price double")
    out = R.unified_checks(u)
    got = {(r.check_name, r.item): r.value for r in out.collect()}
    assert got == {("people_per_segment", "A"): 2, ("people_per_segment", "B"): 1, ("people_per_segment", "<none>"): 0,
                   ("totals", "rows"): 5, ("totals", "people"): 3, ("totals", "unmatched_rows"): 1,
                   ("nulls", "segment"): 1, ("nulls", "customer_unique_id"): 1, ("nulls", "price"): 3}
    pairs = [x for x in _plan(out).splitlines() if "HashAggregate(keys=[segment" in x and "customer_unique_id" in x.split("functions")[0]]
    assert pairs and all("count" not in x for x in pairs)  # no counts for each person


def test_unified_orders_move_no_row_for_the_category_and_delays_no_partial_sets(spark):
    from mercato.plans.registry import star_for

    s = star_for(spark, "/root/testdata/sf0.001")
    sla = V.category_sla(s, P)
    rfm = spark.createDataFrame([], V.rfm_scores(s, P).schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unified, delays = _plan(V.unified_orders(s, P, rfm, sla)), _plan(V.delivery_delay_drivers(s, P))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the items, once they have met their orders, do not move again
    assert "BroadcastHashJoin [product_category_name" in "".join(unified.splitlines()[:5])
    lines = delays.splitlines()
    at = next(i for i, x in enumerate(lines) if "partial_mode" in x)
    assert "REPARTITION_BY_COL" in "".join(lines[at + 1:at + 5])  # rows of an order meet before the aggregate


def test_forest_is_grown_by_fits_of_few_trees(spark):
    assert M.tree_counts(300, P.forest_trees_at_once) == [30] * 10
    assert M.tree_counts(10, 4) == [4, 3, 3] and M.tree_counts(3, 30) == [3]
    fits = [x for x in M.forest_pipeline(P, P.num_trees).getStages() if hasattr(x, "getNumTrees")]
    # a task holds a copy of the trees of its fit
    assert sum(x.getNumTrees() for x in fits) == P.num_trees and max(x.getNumTrees() for x in fits) <= 30
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.2 + x / 2), *[x if c == "seller_hist_late_rate" else rnd.random() for c in M.NUMERIC], "S", "C")
            for i, x in ((i, rnd.random()) for i in range(400))]
    df = spark.createDataFrame(rows, "order_id long, label int, " + ", ".join(f"{c} double" for c in M.NUMERIC)
                               + ", customer_state string, primary_category string")
    model = M.fit(df, P.with_(forest_trees_at_once=4), logistic=False, num_trees=10).forest
    assert [x.getNumTrees for x in M.forests(model)] == [4, 3, 3]
    late = {r.order_id: r.p_late for r in M.probabilities(model, df).collect()}
    votes = {}
    for r in model.transform(df).collect():  # raw predictions are the added votes of the trees
        votes[r.order_id] = sum(r[x.getRawPredictionCol()][1] for x in M.forests(model)) / 10
    assert late.keys() == votes.keys() and all(abs(late[k] - votes[k]) < 1e-9 for k in votes)
    importance = M.feature_importance(model).collect()
    assert abs(sum(r.importance for r in importance) - 1) < 1e-9 and importance[0].feature == "seller_hist_late_rate"


def test_delays_deal_only_items_of_their_orders(spark):
    from mercato.plans.registry import star_for

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = star_for(spark, "/root/testdata/sf0.001")
        lines = _plan(V.delivery_delay_drivers(s, P)).splitlines()
        flags = _plan(s.fact_orders.select("order_id", "has_items")).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, x in enumerate(lines) if "Window [row_number()" in x)
    below = lines[at + 1:at + 8]
    # items of other orders are left out where the order's items are numbered, in the same partitions
    semi = next(i for i, x in enumerate(below) if "LeftSemi" in x)
    assert not any("Exchange" in x for x in below[:semi])
    # and only the columns of the order, not the features, are dealt by customer
    dealt = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(customer_id" in x)
    assert not any("freight_ratio_pct" in x for x in lines[dealt:dealt + 3])
    # one row an order is dealt for has_items, counted in the tasks that read the items
    flag = next(i for i, x in enumerate(flags) if "ExistenceJoin" in x)
    assert any("HashAggregate(keys=[order_id" in x for x in flags[flag:])


def _tables(spark, folder) -> str:
    """Small tables of the driver's schemas: repeated lines, an unknown product, a missing key, two suppliers an order."""
    rnd = random.Random(9)
    day = dt.datetime(1996, 3, 1)
    rows = {
        "nation": [dict(n_nationkey=i, n_name=f"N{i}") for i in range(3)],
        "customer": [dict(c_custkey=i, c_nationkey=i % 3, c_mktsegment=f"M{i % 2}", c_acctbal=float(i)) for i in range(12)],
        "supplier": [dict(s_suppkey=i, s_nationkey=i % 3) for i in range(5)],
        "part": [dict(p_partkey=i, p_type="PROMO" if i % 3 else "LARGE", p_brand=f"B{i % 4}", p_size=i + 1) for i in range(10)],
        "orders": [dict(o_orderkey=i, o_custkey=i % 12, o_orderstatus="F", o_orderpriority="2-HIGH",
                        o_orderdate=day + dt.timedelta(days=rnd.randint(0, 200))) for i in range(80)],
        "lineitem": [dict(l_orderkey=rnd.choice([*range(80), None]), l_linenumber=rnd.randint(1, 2), l_partkey=rnd.randint(0, 11),
                          l_suppkey=rnd.randint(0, 4), l_quantity=float(rnd.randint(1, 9)), l_extendedprice=rnd.randint(100, 9999) / 100,
                          l_discount=0.05, l_tax=0.02, l_returnflag="R", l_linestatus="O",
                          l_shipdate=day + dt.timedelta(days=rnd.randint(200, 260))) for _ in range(260)],
    }
    for name, made in rows.items():
        schema = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").schema
        kinds = {x.name: x.dataType.simpleString() for x in schema}
        fit = [tuple((int(r[c]) if kinds[c] in ("int", "bigint") else r[c]) if r.get(c) is not None else None for c in kinds) for r in made]
        spark.createDataFrame(fit, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _asked(spark, folder, key, monkeypatch, view):
    """The optimised plan and the rows of a report, which must not store ``view``."""
    from mercato.plans import catalog, shared as W  # noqa: F401
    from mercato.plans.registry import REGISTRY, star_for

    named, once = [], W.once
    with monkeypatch.context() as m:
        m.setattr(W, "once", lambda name, *a, **k: (named.append(name), once(name, *a, **k))[1])
        out = REGISTRY[key](star_for(spark, folder), P)
        rows = sorted(map(str, out.collect()))
    assert view not in named
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(x for x in lines if "Relation [" not in x), rows  # a relation names every column of its table


def test_extract_reconciliation_makes_the_pairs_alone(spark, tmp_path, monkeypatch):
    from mercato.plans import quality as Q
    from mercato.plans import shared as W
    from mercato.plans.registry import star_for

    folder = _tables(spark, tmp_path)
    s = star_for(spark, folder)
    plan, rows = _asked(spark, folder, "extract_reconciliation", monkeypatch, "unified_orders")
    assert "l_linenumber" not in plan and "freight_value" not in plan  # the lines of an order are not numbered for it
    assert rows and rows == sorted(map(str, Q.extract_reconciliation(W.rfm_scores(s, P), W.unified_orders(s, P)).collect()))


def test_delay_feature_sanity_makes_its_columns_alone(spark, tmp_path, monkeypatch):
    from mercato.plans import shared as W
    from mercato.plans.registry import star_for

    folder = _tables(spark, tmp_path)
    plan, rows = _asked(spark, folder, "delay_feature_sanity", monkeypatch, "delivery_delay_drivers")
    assert "freight_ratio_pct" not in plan and "order_hour" not in plan
    assert rows == sorted(map(str, R.delay_feature_sanity(W.delivery_delay_drivers(star_for(spark, folder), P)).collect()))


def test_high_correlation_pairs_makes_its_columns_alone(spark, tmp_path, monkeypatch):
    from mercato.plans import shared as W
    from mercato.plans.registry import star_for

    folder = _tables(spark, tmp_path)
    plan, rows = _asked(spark, folder, "high_correlation_pairs", monkeypatch, "delivery_delay_drivers")
    assert "primary_category" not in plan and "customer_state" not in plan
    stored = R.feature_correlation(W.delivery_delay_drivers(star_for(spark, folder), P))
    assert rows and rows == sorted(map(str, R.high_correlation_pairs(stored, P).collect()))


def test_extract_difference_sample_makes_the_pairs_alone(spark, tmp_path, monkeypatch):
    from mercato.plans import quality as Q
    from mercato.plans import shared as W
    from mercato.plans.registry import star_for

    folder = _tables(spark, tmp_path)
    s = star_for(spark, folder)
    plan, rows = _asked(spark, folder, "extract_difference_sample", monkeypatch, "unified_orders")
    assert "l_linenumber" not in plan and "freight_value" not in plan
    assert rows == sorted(map(str, Q.extract_difference_sample(W.rfm_scores(s, P), W.unified_orders(s, P)).collect()))


def test_stored_tables_leave_no_shuffle_files(spark):
    """A job of several stored tables holds the shuffle files of one of them at a time."""
    import time

    from mercato.session import CLEANUP, written

    def shuffled() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(i).getName()) for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP)
    out = written(spark.range(5000).selectExpr("id % 97 as k", "id as v").groupBy("k").agg(F.sum("v").alias("v")))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(CLEANUP) == setting  # other queries keep theirs
    assert out.agg(F.sum("v")).first()[0] == sum(range(5000))


def test_orders_are_made_once_for_the_views_of_a_report(spark, tmp_path):
    from mercato.ml.store import ModelStore
    from mercato.plans import shared as W
    from mercato.plans.registry import star_for
    from mercato.session import ensure_checkpoint_dir
    from mercato.sources.lens import deferred
    from mercato.sources.star import Star

    s = star_for(spark, _tables(spark, tmp_path))
    made = W.orders_once(s, P)
    plan = made.fact_orders.select("order_id", "is_late")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan  # the lines are not joined to the parts again
    assert sorted(map(str, made.fact_orders.collect())) == sorted(map(str, s.fact_orders.collect()))
    stored = [m.run for m in ModelStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables").manifests()]
    assert W.orders_once(s, P).fact_orders.inputFiles() and stored == [
        m.run for m in ModelStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables").manifests()]
    # a view is found by the star that was asked for
    sla, unified = W.category_sla(made, P), W.unified_orders(s, P)
    assert sorted(W.category_sla(s, P).inputFiles()) == sorted(sla.inputFiles())
    fresh = V.unified_orders(s, P, V.rfm_scores(s, P), V.category_sla(s, P))
    assert unified.count() and sorted(map(str, unified.collect())) == sorted(map(str, fresh.collect()))
    # orders that are not made from the raw ones stay
    other = deferred(Star, {"bridge_payments": lambda: s.bridge_payments}, fact_orders=s.fact_orders.limit(3), raw=s.raw)
    assert W.orders_once(other, P).fact_orders.count() == 3


def test_lines_are_numbered_by_the_columns_of_an_item(spark, tmp_path):
    from pyspark.sql import Window

    from mercato.sources import lens

    folder = _tables(spark, tmp_path)
    li = spark.read.parquet(f"{folder}/lineitem.parquet")
    li = li.unionAll(li.withColumns({"l_returnflag": F.lit("A"), "l_linestatus": F.lit("F")})).unionAll(
        li.withColumn("l_tax", F.lit(0.07))).localCheckpoint()
    li.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    got = lens.items(spark, folder)
    assert "l_returnflag" not in _plan(got) and "l_linestatus" not in _plan(got)
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus")
    want = [(r.l_orderkey, r.n, r.l_partkey, r.l_suppkey, r.l_shipdate, round(r.l_extendedprice, 2),
             round(r.l_extendedprice * r.l_tax + 1e-9, 2)) for r in li.withColumn("n", F.row_number().over(w)).collect()]
    rows = [(*r[:5], float(r[5]), float(r[6])) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [r[:6] for r in sorted(rows, key=key)] == [r[:6] for r in sorted(want, key=key)]
    assert all(abs(a[6] - b[6]) < 0.011 for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True))


def _exchanges(spark, df_of) -> list[str]:
    """The exchanges of a plan without broadcasts, a line each."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return [x for x in _plan(df_of()).splitlines() if "Exchange " in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_that_have_met_by_order_are_grouped_there(spark, tmp_path):
    from mercato.plans.registry import star_for

    s = star_for(spark, _tables(spark, tmp_path))
    sla = _exchanges(spark, lambda: V.category_sla(s, P))
    assert not [x for x in sla if "product_category_name" in x and "order_id" in x.split("hashpartitioning")[-1]]
    revenue = _exchanges(spark, lambda: V.revenue_by_category(s, P))
    assert not [x for x in revenue if "product_category_name" in x and "order_id" in x.split("hashpartitioning")[-1]]
    cancelled = _exchanges(spark, lambda: V.cancellation_analysis(s, P))
    assert sum("hashpartitioning(order_id" in x and "REPARTITION_BY_COL" not in x for x in cancelled) <= sum(
        "hashpartitioning(order_id" in x for x in _exchanges(spark, lambda: s.fact_orders.select("order_id", "customer_id"))) + 1
    rfm = _exchanges(spark, lambda: V.rfm_raw(s, P))
    assert not [x for x in rfm if "hashpartitioning(order_id" in x and "customer_city" in x]


def test_unified_checks_equal_plain_counts(spark):
    """Nulls in every column, people with nulls in some of their rows, no rows at all."""
    rnd = random.Random(4)
    rows = [(rnd.choice(["A", "B", None]), rnd.choice([1, 2, 3, 4, None]), rnd.choice([1.0, None]), rnd.choice(["x", None]))
            for _ in range(300)]
    u = spark.createDataFrame(rows, "segment string, customer_unique_id long, price double, city string")
    people = {g: len({r[1] for r in rows if r[0] == g and r[1] is not None}) for g in {r[0] for r in rows}}
    want = {("people_per_segment", g or "<none>"): n for g, n in people.items()} | {
        ("totals", "people"): sum(people.values()), ("totals", "rows"): 300,
        ("totals", "unmatched_rows"): sum(r[0] is None for r in rows)} | {
        ("nulls", c): sum(r[i] is None for r in rows) for i, c in enumerate(u.columns)}
    assert {(r.check_name, r.item): r.value for r in R.unified_checks(u).collect()} == want
    assert R.unified_checks(u)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert R.unified_checks(u.limit(0)).collect() == []


def test_features_meet_the_history_by_order_alone(spark, tmp_path):
    from mercato.ml import jobs
    from mercato.plans.registry import star_for

    s = star_for(spark, _tables(spark, tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = _plan(jobs.features_asof(s, P)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_both = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(order_id" in x and "seller_id" in x.split("),")[0]]
    assert by_both and not any("freight_ratio_pct" in x for i in by_both for x in lines[i:i + 4])
    assert not any("l_shipdate" in x and "max(" in x for x in lines)  # the dates of the orders are stored


def test_fits_read_rows_that_are_encoded_once(spark, tmp_path, monkeypatch):
    """As many parts as run at a time; several fits in a session that has observed a write."""
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(20).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(str(tmp_path / "observed"))
    assert seen.get["n"] == 20
    rnd = random.Random(6)
    rows = [(i, int(rnd.random() < 0.3), *[rnd.random() for _ in M.NUMERIC], f"S{i % 3}", f"C{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "order_id long, label int, " + ", ".join(f"{c} double" for c in M.NUMERIC)
                               + ", customer_state string, primary_category string")
    at_once = spark.sparkContext.defaultParallelism
    assert M.dealt_for_fits(df.repartition(40)).rdd.getNumPartitions() == at_once
    assert M.dealt_for_fits(df.repartition(1)).rdd.getNumPartitions() == 1
    with monkeypatch.context() as m:
        m.setattr(M, "TASK_ROWS", 400 // (3 * at_once) + 1)
        assert M.dealt_for_fits(df.repartition(40)).rdd.getNumPartitions() == 3 * at_once
    fitted = M.fit(df, P.with_(forest_trees_at_once=2), num_trees=6)
    assert [x.getNumTrees for x in M.forests(fitted.forest)] == [2, 2, 2]
    kinds = [type(x).__name__ for x in fitted.logistic.stages]
    assert kinds[:3] == [type(x).__name__ for x in fitted.forest.stages[:3]] and kinds[3:] == ["StandardScalerModel", "LogisticRegressionModel"]
    assert M.probabilities(fitted.logistic, M.probabilities(fitted.forest, fitted.test).drop("p_late")).count() == fitted.test.count()
