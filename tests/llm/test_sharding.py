"""Extendible hashing against its SQL at limits that split, and hot ids."""

import pytest
from pyspark.sql import functions as F

from mercato.llm import sharding as S
from tools.oracle_check import duck, frame_hash


@pytest.mark.parametrize("limit", [S.BYTE_LIMIT, 50_000, 1_500])
def test_equals_sql(spark, sf_llm, limit):
    docs = spark.read.parquet(f"{sf_llm}/documents.parquet")
    got = S.assign(docs, byte_limit=limit).toPandas()
    assert frame_hash(got) == frame_hash(duck(sf_llm).execute(S.oracle(limit)).df())


def test_hot_ids_and_equal_rows_are_split(spark, sf_llm):
    docs = spark.read.parquet(f"{sf_llm}/documents.parquet").select("doc_id", "text")
    hot = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 7).otherwise(F.col("doc_id")))
    same = spark.range(400).select(F.lit(3).cast("long").alias("doc_id"), F.lit("equal text " * 5).alias("text"))
    rows = hot.union(same).union(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    rows = rows.withColumn("depth", F.lit("clash"))
    got = S.assign(rows, byte_limit=6_000, keep=rows.columns).toPandas()
    assert len(got) == rows.count()
    per = got.groupby("shard_id").agg(total=("n_bytes", "sum"), n=("n_bytes", "size"), said=("shard_bytes", "max"),
                                      docs=("shard_docs", "max"))
    assert (per.total == per.said).all() and (per.n == per.docs).all()
    assert ((per.total <= 6_000) | (per.n == 1)).all()
    ids = sorted(got.shard_id.unique())
    assert not any(b.startswith(a) for a, b in zip(ids, ids[1:]))  # no shard is a prefix of another
    assert S.assign(rows.limit(0)).count() == 0


def test_written_shards_hold_all_rows(spark, sf_llm, tmp_path):
    docs = spark.read.parquet(f"{sf_llm}/documents.parquet")
    S.write(docs, str(tmp_path / "out"), byte_limit=60_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert back.select(*docs.columns).exceptAll(docs).count() == 0
