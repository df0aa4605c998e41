"""Running totals, exact quantiles, hashes and wide arithmetic."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercato.functions.hashing import id_bits, id_unit
from mercato.functions.numeric import round_ratio, unscaled
from mercato.operators.prefix import exact_quantiles, running_totals


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1.5, float(rnd.randint(0, 40)), rnd.random()])) for _ in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_exact_quantiles_per_group_and_over_all(values):
    rows, df = values
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    for k, group in pdf.groupby("k", dropna=False):
        r = got[None if pd.isna(k) else k]
        assert r.n == group.v.count()
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], group.v.quantile(probs))
    r = exact_quantiles(df, "v", probs).first()
    assert np.allclose([r[f"q{i}"] for i in range(len(probs))], pdf.v.quantile(probs))


def test_no_single_partition_over_the_values(values):
    _, df = values
    plan = running_totals(df.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")), [F.col("v")], {"t": "n"}) \
        ._jdf.queryExecution().toString()
    assert "Window" in plan and plan.count("SinglePartition") <= plan.count("_pid")


def test_running_totals_in_order(spark):
    df = spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("n"))
    got = {r.x: r.t for r in running_totals(df, [F.col("x").desc()], {"t": "n"}).collect()}
    total = 0
    for x in range(999, -1, -1):
        total += x % 7
        assert got[x] == total


def test_hash_of_text_and_integer_ids(spark):
    import hashlib

    df = spark.createDataFrame([(7, "0a9f" * 8), (None, None)], "i long, t string")
    r, null = df.select(id_bits("i", "s").alias("a"), id_bits("t", "s").alias("b"), id_unit("t", "s").alias("u"),
                        id_bits("i", "other").alias("c")).collect()
    assert r.a == int(hashlib.md5(b"7:s").hexdigest()[:13], 16)
    assert r.b == int(hashlib.md5(("0a9f" * 8 + ":s").encode()).hexdigest()[:13], 16)
    assert 0 <= r.u < 1 and r.c != r.a and null.a is None


def test_sums_above_64_bits(spark):
    df = spark.range(1000).select(F.lit("92000000000000.07").cast("decimal(18,2)").alias("v"))
    r = df.agg(round_ratio(F.sum(unscaled("v", 2)), F.count("v") * 100, 2).alias("mean"),
               F.sum(unscaled("v", 2)).alias("cents"))
    assert r.first().cents == 1000 * 9200000000000007 > 2 ** 63 / 1.01
    assert r.first().mean == 92000000000000.07
    big = spark.sql("select cast(4600000000000000005 as decimal(38,0)) * 1000 n, cast(1000 as decimal(38,0)) d")
    assert big.select(round_ratio("n", "d", 0)).first()[0] == float(4600000000000000005)
    odd = spark.sql("select * from values (5, 2, 3.0), (-5, 2, -3.0), (1, 3, 0.0), (null, 1, null), (1, 0, null) t(n, d, want)")
    assert all(r.got == r.want for r in odd.select(round_ratio("n", "d", 0).alias("got"), F.col("want").cast("double")).collect())
