"""NTILE by cut rows equals the window NTILE, whatever the partitioning."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mercato.operators import ranking
from mercato.operators.ranking import By, first_by, ntile_window, ntiles


def table(spark, n):
    rnd = random.Random(n)
    pick = lambda *xs: rnd.choice(xs)
    words = ["", "a", "ab", "a\0", "a\0b", "é", "zz", "\U0001f642", "\ue000", None]
    rows = [(i, pick(None, rnd.randint(-3, 3), -(1 << 63), (1 << 63) - 1), pick(*words) if rnd.random() < 0.5 else f"c{i % 40}",
             pick(None, Decimal(rnd.randint(-10**6, 10**6)) / 100), pick(None, dt.date(1960 + rnd.randint(0, 90), 1, 1)))
            for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "id long, v long, c string, m decimal(12,2), d date")


ORDERS = {
    "a": ([By("v", descending=True), By("id")], lambda: [F.col("v").desc_nulls_first(), F.col("id").asc()]),
    "b": ([By("c"), By("id", descending=True)], lambda: [F.col("c").asc_nulls_first(), F.col("id").desc()]),
    "c": ([By("m", nulls_last=True), By("c"), By("id")],
          lambda: [F.col("m").asc_nulls_last(), F.col("c").asc_nulls_first(), F.col("id")]),
    "d": ([By("d", descending=True, nulls_last=True), By("v"), By("id")],
          lambda: [F.col("d").desc_nulls_last(), F.col("v").asc_nulls_first(), F.col("id")]),
}


@pytest.mark.parametrize("n,k,fetch", [(0, 4, 10), (1, 4, 10), (3, 4, 1), (7, 2, 1), (1001, 4, 3), (1500, 7, 40), (800, 4, 2000)])
def test_ntiles_equal_window(spark, monkeypatch, n, k, fetch):
    monkeypatch.setattr(ranking, "FETCH", fetch)
    df = table(spark, n).cache()
    got = {r.id: r for r in ntiles(df, k, {out: by for out, (by, _) in ORDERS.items()}).collect()}
    assert len(got) == n
    for out, (_, order) in ORDERS.items():
        assert {i: r[out] for i, r in got.items()} == {r.id: r.q for r in ntile_window(df, k, order(), "q").collect()}
    df.unpersist()


def test_one_value_in_most_rows_and_long_equal_prefixes(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FETCH", 5)
    df = spark.range(4000).selectExpr("id", "if(id < 3500, 7L, id) as v", "concat(repeat('same', 20), lpad(id, 5, '0')) as s").cache()
    got = ntiles(df, 4, {"q": [By("v"), By("s")]}).groupBy("q").agg(F.count("*"), F.min("id"), F.max("id")).collect()
    assert sorted(map(tuple, got)) == [(j + 1, 1000, 1000 * j, 1000 * j + 999) for j in range(4)]
    df.unpersist()


def test_ntiles_plan_neither_sorts_nor_shuffles(spark):
    plan = ntiles(table(spark, 300), 4, {"q": ORDERS["a"][0]})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_text_and_doubles_that_have_no_order_string_raise(spark):
    with pytest.raises(ValueError):
        ntiles(spark.range(3).selectExpr("string(id) s"), 2, {"q": [By("s", descending=True)]})
    with pytest.raises(ValueError):
        ntiles(spark.range(3).selectExpr("double(id) s"), 2, {"q": [By("s")]})


def test_first_by_is_min_of_order(spark):
    df = spark.createDataFrame([(1, 3, "a"), (1, 1, "b"), (2, 5, "c"), (1, 1, "a")], "k int, o int, p string")
    got = {r.k: (r.o, r.p) for r in first_by(df, ["k"], ["o"]).collect()}
    assert got == {1: (1, "a"), 2: (5, "c")}


@pytest.mark.parametrize("shuffle", ["1", "64"])
def test_rfm_equals_window_and_needs_no_checkpoint(spark, monkeypatch, shuffle):
    from pyspark.sql import DataFrame

    from mercato.params import FIXTURE_PARAMS as P
    from mercato.plans import views as V
    from mercato.plans.registry import star_for
    from tests.conftest import SF_SMALL

    def none(*a, **b):
        raise AssertionError("no checkpoint")

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        s = star_for(spark, SF_SMALL)
        monkeypatch.setattr(DataFrame, "checkpoint", none)
        scored = V.rfm_scores(s, P)
        assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
        a = {(r.customer_unique_id, r.customer_city, r.customer_state): r for r in scored.collect()}
        x = V.rfm_raw(s, P)
        tie = [F.col("customer_unique_id").asc(), F.col("customer_city").asc_nulls_first(), F.col("customer_state").asc_nulls_first()]
        for out, first in (("r_score", F.col("recency_days").desc_nulls_last()), ("f_score", F.col("frequency").asc_nulls_first()),
                           ("m_score", F.col("monetary").asc_nulls_first())):
            x = ntile_window(x, 4, [first, *tie], out)
        b = x.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(a) == len(b) > 0
    for r in b:
        g = a[r.customer_unique_id, r.customer_city, r.customer_state]
        assert (g.r_score, g.f_score, g.m_score) == (r.r_score, r.f_score, r.m_score)
