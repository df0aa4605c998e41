"""ML on generated rows with a planted effect (the fixtures carry only a weak
signal): the forest must find it, importances sum to 1, gates report a status,
and a saved model scores exactly like the fitted one."""

import random

import pytest
from pyspark.sql import functions as F

from mercato.ml import pipeline as M
from mercato.params import FIXTURE_PARAMS as P


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        rate = rnd.uniform(0, 40)
        late = 1 if rnd.random() < (0.05 + rate / 50.0) else 0
        feats = [float(rnd.randint(0, 6)), float(rnd.randint(0, 23)), float(rnd.randint(1, 12)),
                 float(rnd.randint(1, 4)), 1.0, rnd.uniform(10, 500), rnd.uniform(1, 50), rnd.uniform(1, 30),
                 rnd.uniform(100, 5000), rnd.uniform(1000, 50000), rate, rnd.uniform(5, 30),
                 float(rnd.randint(1, 500)), rnd.uniform(0, 48)]
        rows.append((i, late, *feats, f"S{rnd.randint(0, 5)}", f"C{rnd.randint(0, 9)}"))
    cols = ["order_id long", "label int"] + [f"{c} double" for c in M.NUMERIC] + [
        "customer_state string", "primary_category string"]
    return spark.createDataFrame(rows, ", ".join(cols))


def test_forest_finds_planted_effect(spark, planted, tmp_path):
    f = M.fit(planted, P, logistic=True, num_trees=20)
    scored = M.score(f.forest, f.test, 0.5)
    auc = M.auc(scored).first()[0]
    assert auc > 0.75
    assert M.gate_status(auc) == "OK"
    imp = M.feature_importance(f.forest).collect()
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-6
    assert imp[0].feature == "seller_hist_late_rate"
    lr_auc = M.auc(M.score(f.logistic, f.test, 0.5)).first()[0]
    assert lr_auc > 0.7
    rep = {r["class"]: r for r in M.classification_report(scored).collect()}
    assert rep["Late"].support + rep["On Time"].support == f.test.count()
    cm = sum(r["count"] for r in M.confusion_matrix(scored).collect())
    assert cm == f.test.count()
    best = M.best_threshold(M.curve_table(scored)).first()
    assert 0.0 <= best.threshold <= 1.0 and 0.0 <= best.f1 <= 1.0
    path = str(tmp_path / "model")
    M.save_model(f.forest, path)
    again = M.score(M.load_model(path), f.test, 0.5)
    a = {r.order_id: r.p_late for r in scored.select("order_id", "p_late").collect()}
    b = {r.order_id: r.p_late for r in again.select("order_id", "p_late").collect()}
    assert a == b


def test_split_is_repeatable_and_proportional(spark, planted):
    tr1, te1 = M.stratified_split(planted, P)
    tr2, te2 = M.stratified_split(planted, P)
    ids1 = {r.order_id for r in te1.select("order_id").collect()}
    assert ids1 == {r.order_id for r in te2.select("order_id").collect()}
    sizes = {r.label: (r["test"], r["all"]) for r in M.with_split(planted, P).groupBy("label").agg(
        F.count_if("is_test").alias("test"), F.count(F.lit(1)).alias("all")).collect()}
    for test, rows in sizes.values():  # each class gives its own fifth, to the resolution of the buckets
        assert abs(test - 0.2 * rows) <= 2
    assert not ids1 & {r.order_id for r in tr2.select("order_id").collect()}
    w = M.with_balanced_weights(tr1).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    ws = sorted(r.w for r in w)
    assert abs(ws[0] - ws[1]) < 1e-6  # balanced: both classes carry the same total weight


def test_psi_zero_for_same_distribution(spark):
    df = spark.createDataFrame([(float(i % 50), i % 2) for i in range(1000)], "v double, period int")
    assert abs(M.psi(df, "v", "period", [10.0, 20.0, 30.0]).first().psi) < 1e-3


def test_unseen_category_is_scored(spark, planted):
    f = M.fit(planted, P, logistic=False, num_trees=5)
    new = planted.limit(5).withColumn("primary_category", F.lit("never_seen"))
    assert M.score(f.forest, new, 0.5).count() == 5


def test_daily_top_risk_two_phase_is_exact(spark):
    import datetime as dt

    rows = [(i, (i * 7919 % 1000) / 1000.0, 1 if i % 3 == 0 else 0) for i in range(2000)]
    scored = spark.createDataFrame(rows, "order_id long, p_late double, flag int")
    ts = spark.createDataFrame([(i, dt.datetime(2020, 1, 1 + i % 3)) for i in range(2000)],
                               "order_id long, order_purchase_timestamp timestamp_ntz")
    got = M.daily_top_risk(scored, ts, 5, buckets=16).collect()
    want = {}
    for i, p_, _ in rows:
        want.setdefault(1 + i % 3, []).append((-p_, i))
    for d in want:
        exp = [i for _, i in sorted(want[d])[:5]]
        assert [r.order_id for r in sorted((r for r in got if r.day.day == d), key=lambda r: r["rank"])] == exp


def test_registered_ml_jobs_run(spark):
    """Every registered model-output job (rows-only in the driver gate) runs on the
    smallest scale and returns rows of the expected shape."""
    import __spark_entry__ as entry

    q = entry.queries()
    got = {k: q[k](spark, "/root/testdata/sf0.001").collect() for k in sorted(q)
           if k.startswith("ml_") and k not in entry.oracle_sql()}
    assert len(got["ml_forest_report"]) == 2 and len(got["ml_validated_threshold"]) == 2
    assert len(got["ml_feature_importance"]) == len(M.FEATURES)
    assert sum(r["count"] for r in got["ml_confusion_matrix"]) == got["ml_forest_report"][0].support + \
        got["ml_forest_report"][1].support
    assert all(len(v) > 0 for v in got.values())


def test_text_ids_are_split_and_halved(spark, planted):
    """Ids of a real export are text; the halves of the holdout are disjoint and both hold rows."""
    from mercato.ml import jobs

    text = planted.withColumn("order_id", F.concat(F.lit("f00d"), F.hex("order_id")))
    train, test = M.stratified_split(text, P)
    a, b = jobs.halves(test, P)
    ids = [{r.order_id for r in x.select("order_id").collect()} for x in (train, a, b)]
    assert all(ids) and not (ids[0] & ids[1] or ids[0] & ids[2] or ids[1] & ids[2])
    assert sum(map(len, ids)) == planted.count() and abs(len(ids[1]) - len(ids[2])) < 0.2 * test.count()


def test_curve_and_auc_are_exact(spark):
    """Against a plain count over all pairs and thresholds, ties included."""
    rnd = random.Random(11)
    rows = [(i, int(rnd.random() < 0.3), rnd.choice([0.61605, 0.6161, 0.1, 0.25, rnd.random()])) for i in range(400)]
    scored = M.flagged(spark.createDataFrame(rows, "order_id long, label int, p_late double"), 0.6161)
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(M.auc(scored).first()[0] - area) < 1e-12
    curve = {r.threshold: r for r in M.curve_table(scored).collect()}
    assert set(curve) == {s for *_, s in rows}
    for t, r in curve.items():
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        assert abs(r.precision - tp / (tp + fp)) < 1e-12 and abs(r.tpr - tp / len(pos)) < 1e-12
        assert abs(r.fpr - fp / len(neg)) < 1e-12
    counts = {(r.label, r.prediction): r["count"] for r in M.confusion_matrix(scored).collect()}
    assert counts[1, 1] == sum(s >= 0.6161 for s in pos)
    assert M.auc(scored.limit(0)).first()[0] is None


def test_results_follow_parameters_and_data(spark):
    """Another threshold, split or input never meets an old model."""
    from mercato.ml import jobs
    from mercato.plans.registry import star_for

    p = P.with_(num_trees=4)
    s = star_for(spark, "/root/testdata/sf0.001")
    first = jobs.training(s, p)
    assert first.seconds and jobs.training(s, p.with_(threshold=0.05)).path == first.path
    assert jobs.training(s, p).seconds is None  # found, not fitted again
    a = {(r.label, r.prediction): r["count"] for r in jobs.confusion(s, p).collect()}
    b = {(r.label, r.prediction): r["count"] for r in jobs.confusion(s, p.with_(threshold=0.05)).collect()}
    assert a != b
    key = jobs._identity(s, p, "split")[0]
    again = star_for(spark, "/root/testdata/sf0.001")
    assert jobs._identity(again, p, "split")[0] == key and jobs.training(again, p).path == first.path
    assert jobs._identity(s, p.with_(test_fraction=0.3), "split")[0] != key
    # customers of another state change the features, so they make another training
    s.dim_customers = s.dim_customers.withColumn("customer_state", F.lit("XX"))
    assert jobs._identity(s, p, "split")[0] != key
    other = jobs.training(s, p)
    assert other.seconds and other.path != first.path
    rows = jobs.validated_threshold(star_for(spark, "/root/testdata/sf0.001"), p).collect()
    assert len(rows) == 2 and sum(r.support for r in rows) > 0 and rows[0].accuracy is not None


def test_train_and_score_commands(spark, tmp_path):
    from mercato.ml import jobs
    from mercato.plans.registry import star_for

    s = star_for(spark, "/root/testdata/sf0.001")
    p = P.with_(num_trees=3)
    jobs.training(s, p, path=str(tmp_path / "late"))
    scored = jobs.score_saved(s, p, str(tmp_path / "late"))
    assert scored.count() == jobs.features(s, p).count() and "cold_start_seller" in scored.columns


def test_store_reads_published_runs_only(spark, tmp_path):
    from mercato.ml.store import Manifest, ModelStore, table_version

    store = ModelStore(spark, str(tmp_path / "store"))
    assert store.find("k") is None and store.manifests() == []
    half = store.new_run()
    spark.range(3).write.parquet(f"{half}/scores")  # a driver that was lost before it published
    assert store.find("k") is None
    runs = [store.new_run() for _ in range(2)]
    for r in runs:
        spark.range(3).write.parquet(f"{r}/scores")
    first = store.publish(Manifest("k", runs[0], 5, "split", {"t": "1"}, "p"))
    second = store.publish(Manifest("k", runs[1], 9, "split", {"t": "1"}, "p"))  # a slower writer
    assert first.run == second.run == runs[0] == store.find("k").run
    assert not (tmp_path / "store" / "runs" / runs[1].rsplit("/", 1)[1]).exists()
    store.publish(Manifest("l", half, 11, "split", {"t": "2"}, "p"))
    assert store.latest().run == half and [m.key for m in store.manifests()] == ["k", "l"]
    # a table's version follows its files
    spark.range(5).write.parquet(str(tmp_path / "t"))
    one = table_version(spark.read.parquet(str(tmp_path / "t")))
    assert one == table_version(spark.read.parquet(str(tmp_path / "t")))
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert one != table_version(spark.read.parquet(str(tmp_path / "t")))
