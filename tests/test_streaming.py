"""The streaming scorer scores every arriving feature file exactly once."""

import random

from mercato.ml import pipeline as M
from mercato.params import FIXTURE_PARAMS as P
from mercato.streaming.scoring import score_stream


def test_stream_scores_new_files(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, i % 2, *[rnd.uniform(0, 10) for _ in M.NUMERIC], "S1", "C1") for i in range(200)]
    cols = ["order_id long", "label int"] + [f"{c} double" for c in M.NUMERIC] + [
        "customer_state string", "primary_category string"]
    df = spark.createDataFrame(rows, ", ".join(cols))
    f = M.fit(df, P, logistic=False, num_trees=3)
    M.save_model(f.forest, str(tmp_path / "model"))
    src = tmp_path / "incoming"
    df.limit(50).write.parquet(str(src / "batch1"))

    def run():
        q = score_stream(spark, str(tmp_path / "model"), str(src / "*"), str(tmp_path / "scored"), str(tmp_path / "progress"),
                         df.schema, name=f"t{random.randint(0, 10**9)}")
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "scored"))

    out = run()
    assert out.count() == 50 and "p_late" in out.columns and "flag" in out.columns
    # a second run of the query, with another application's checkpoint folder, goes on where the first ended
    ids = df.select("order_id")
    df.join(ids.exceptAll(spark.read.parquet(str(src / "batch1")).select("order_id")), "order_id").limit(50).select(
        *df.columns).write.parquet(str(src / "batch2"))
    before = spark.sparkContext.getCheckpointDir()
    try:
        spark.sparkContext.setCheckpointDir(str(tmp_path / "other-application"))
        out = run()
    finally:
        spark.sparkContext.setCheckpointDir(before)
    assert out.count() == 100 and out.select("order_id").distinct().count() == 100
