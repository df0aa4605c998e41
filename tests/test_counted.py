"""Medians and modes from counted values against the engine's own aggregates."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mercato.operators import counted
from mercato.operators.counted import grouped_medians, grouped_modes


def table(spark, n, seed):
    rnd = random.Random(seed)
    special = [None, 0.0, 1e300, -1e300, 5e-324, 0.1, 0.1, 0.1]
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", None, "void"]), rnd.choice([rnd.uniform(-9, 9), rnd.choice(special)]),
             rnd.randint(0, 4), rnd.choice([None, "x", "y", "z"])) for _ in range(n)]
    rows = [(g, None if g == "void" else v, w, None if g == "void" else t) for g, v, w, t in rows]
    return spark.createDataFrame(rows, "g string, v double, w int, t string")


@pytest.mark.parametrize("n,bins", [(0, 4), (1, 4), (2, 1), (500, 3), (2001, 64)])
def test_medians_and_modes_equal_the_engine(spark, monkeypatch, n, bins):
    monkeypatch.setattr(counted, "BINS", bins)
    df = table(spark, n, n).cache()
    got = {r.g: (r.v, r.w) for r in grouped_medians(df, ["g"], ["v", "w"]).collect()}
    for r in df.groupBy("g").agg(F.median("v").alias("v"), F.median("w").alias("w")).collect():
        v, w = got[r.g]
        assert w == r.w and (v == r.v or math.isclose(v, r.v, rel_tol=1e-12))
    assert {r.g: (r.t, r.w) for r in grouped_modes(df, ["g"], ["t", "w"]).collect()} == {
        r.g: (r.t, r.w) for r in df.groupBy("g").agg(F.mode("t", True).alias("t"), F.mode(F.col("w").cast("string"), True).alias("w")).collect()}
    whole = grouped_medians(df, [], ["v", "w"]).collect()
    assert len(whole) == 1 and whole[0].w == df.agg(F.median("w")).first()[0]
    df.unpersist()


def test_nan_and_infinite_values(spark):
    inf = float("inf")
    rows = [("a", x) for x in (-inf, 1.0, inf)] + [("b", x) for x in (1.0, float("nan"), float("nan"))] + [("c", -inf), ("c", 3.0)]
    got = {r.g: r.v for r in grouped_medians(spark.createDataFrame(rows, "g string, v double"), ["g"], ["v"]).collect()}
    assert got["a"] == 1.0 and math.isnan(got["b"]) and got["c"] == -inf


def test_no_value_buffers_and_no_single_task(spark):
    from mercato.params import FIXTURE_PARAMS as P
    from mercato.plans.registry import star_for

    s = star_for(spark, "/root/testdata/sf0.001")
    for df in (s.dim_geolocation, s.dim_products):
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        assert "median(" not in plan and "percentile" not in plan and not re.search(r"[^a-z]mode\(", plan)
        assert "checkpoint" not in plan
    assert P is not None
