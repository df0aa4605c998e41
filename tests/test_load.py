"""Incremental load and shared views: what counts once, what is read again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mercato.ml.store import Manifest, ModelStore, folder_of, now
from mercato.params import FIXTURE_PARAMS as P
from mercato.plans import quality as Q
from mercato.plans import shared as W
from mercato.plans import views as V
from mercato.plans.registry import star_for
from mercato.session import ensure_checkpoint_dir
from mercato.sources.load import BATCH, StarLoad, loaded_once
from mercato.sources.star import Star

SF = "/root/testdata/sf0.001"


def _part(s: Star, keep) -> Star:
    """The part of a star whose orders ``keep`` selects; dimensions come with the first part only."""
    ids = s.fact_orders.where(keep).select("order_id")
    t = {n: df.join(ids, "order_id", "left_semi") if "order_id" in df.columns else df for n, df in s.tables().items()}
    return Star(**t)


def _rows(s: Star) -> dict:
    return {n: df.count() for n, df in s.tables().items()}


def test_batches_add_up_and_a_replayed_batch_counts_once(spark, tmp_path):
    s = star_for(spark, SF)
    early = F.coalesce(F.col("order_purchase_timestamp") < F.lit(dt.datetime(1995, 1, 1)), F.lit(True))
    one, two = _part(s, early), _part(s, ~early)
    two = Star(**{n: df if "order_id" in df.columns else df.limit(0) for n, df in two.tables().items()})
    load = StarLoad(spark, str(tmp_path / "star"))
    first = load.load("1994", one)
    load.load("1995", two)
    assert load.load("1994", one) == first and len(load.batches()) == 2
    got, whole = load.star(), _rows(s)
    assert _rows(got) == whole
    assert {t: sum(int(m.inputs[t]) for m in load.batches()) for t in whole} == whole
    assert {r.status for r in load.check().collect()} == {"OK"} and load.check().count() == 16
    assert {r.status for r in Q.row_count_report(s, got).collect()} == {"OK"}
    assert load.star(["1994"]).fact_orders.count() == int(first.inputs["fact_orders"]) < whole["fact_orders"]
    # a month filter reads only its folders, in every batch
    plan = got.orders_between(dt.date(1996, 1, 1), dt.date(1996, 2, 1))
    assert plan.count() == s.orders_between(dt.date(1996, 1, 1), dt.date(1996, 2, 1)).count()
    read = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and "purchase_month" in read.split("PartitionFilters")[1].split("]")[0]
    # the same orders under another id are found as repeated keys
    assert load.repeated_keys("fact_orders", ["order_id"]).count() == 0
    load.load("again", two)
    again = load.repeated_keys("fact_orders", ["order_id"])
    assert again.count() == two.fact_orders.count() and again.where("batches = 2").count() == again.count()
    assert load.retract("again") and not load.retract("again")
    assert _rows(load.star()) == whole


def test_half_written_and_lost_batches_are_not_read(spark, tmp_path):
    s = star_for(spark, SF)
    load = StarLoad(spark, str(tmp_path / "star"))
    with pytest.raises(FileNotFoundError):
        load.star()
    m = load.load("a", s)
    s.dim_sellers.write.parquet(f"{load.root}/tables/dim_sellers/{BATCH}=lost")  # a driver that ended before its manifest
    assert _rows(load.star()) == _rows(s)
    with pytest.raises(FileNotFoundError):
        load.star(["a", "b"])
    # a second writer of the same batch: the first manifest counts
    assert load.store.publish(Manifest(m.key, "later", now() + 1000, "a", m.inputs, m.parameters)) == m
    # stored rows that are lost show against the manifest
    p, fs = folder_of(spark, f"{load.root}/tables/bridge_reviews/{BATCH}={m.run}")
    for status in fs.listStatus(p):
        fs.delete(status.getPath(), False)
    spark.catalog.clearCache()
    bad = {r.table_name: (r.status, r.loaded) for r in load.check().collect()}
    assert bad["bridge_reviews"] == ("MISMATCH", 0) and bad["dim_sellers"][0] == "OK"


def test_row_count_report_loads_a_star_once(spark):
    s = star_for(spark, SF)
    first = loaded_once(s)
    store = StarLoad(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/star")
    n = len(store.batches())
    again = loaded_once(star_for(spark, SF))
    assert len(store.batches()) == n
    assert sorted(first.fact_orders.inputFiles()) == sorted(again.fact_orders.inputFiles())


def _views(spark) -> list[Manifest]:
    return ModelStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/views").manifests()


def test_second_report_reads_the_stored_view(spark):
    jobs = entry.queries()
    jobs["dash_segments"](spark, SF).collect()
    before = {m.run for m in _views(spark)}
    second = jobs["geo_drill"](spark, SF)
    assert {m.run for m in _views(spark)} == before
    unified = [m.run.rsplit("/", 1)[1] for m in _views(spark) if m.tag == "unified_orders"]
    files = second.inputFiles()
    assert files and all(any(run in f for run in unified) for f in files)


def test_stored_views_equal_the_computed_ones(spark):
    s = star_for(spark, SF)
    fresh = {"rfm_scores": V.rfm_scores(s, P), "category_sla": V.category_sla(s, P),
             "cohort_retention": V.cohort_retention(s, P), "revenue_by_category": V.revenue_by_category(s, P),
             "seller_performance": V.seller_performance(s, P), "cancellation_analysis": V.cancellation_analysis(s, P),
             "delivery_delay_drivers": V.delivery_delay_drivers(s, P),
             "unified_orders": V.unified_orders(s, P, V.rfm_scores(s, P), V.category_sla(s, P))}
    for name, df in fresh.items():
        got = getattr(W, name)(s, P)
        assert got.dtypes == df.dtypes, name
        assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty(), name


def test_changed_rows_or_parameters_make_a_new_view(spark, tmp_path):
    star_for(spark, SF).save(str(tmp_path / "star"))
    s = Star.load(spark, str(tmp_path / "star"))
    n = W.seller_performance(s, P).count()
    runs = {m.run for m in _views(spark)}
    assert W.seller_performance(Star.load(spark, str(tmp_path / "star")), P).count() == n
    assert {m.run for m in _views(spark)} == runs
    W.seller_performance(s, P.with_(risk_top_k=P.risk_top_k + 1)).count()
    assert len(_views(spark)) == len(runs) + 1
    # one more seller's items under the same path
    items = s.fact_order_items.limit(1).withColumns({"seller_id": F.lit(-5).cast(dict(s.fact_order_items.dtypes)["seller_id"]),
                                                     "order_item_id": F.lit(99).cast("int")})
    items.write.mode("append").parquet(str(tmp_path / "star" / "fact_order_items"))
    W.seller_performance(Star.load(spark, str(tmp_path / "star")), P).count()
    assert len(_views(spark)) == len(runs) + 2
