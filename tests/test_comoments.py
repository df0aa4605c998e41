"""Correlations from co-moments against plain pairwise arithmetic."""

import math
import random
from fractions import Fraction

import pytest

from mercato.operators.comoments import correlations

COLS = ["a", "b", "c", "d", "e"]


def plain(rows, i, j):
    pairs = [(Fraction(r[i]), Fraction(r[j])) for r in rows if r[i] is not None and r[j] is not None]
    n = len(pairs)
    if n < 2:
        return None
    mx, my = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    vx, vy = sum((x - mx) ** 2 for x, _ in pairs), sum((y - my) ** 2 for _, y in pairs)
    if not vx or not vy:
        return None
    return float(sum((x - mx) * (y - my) for x, y in pairs)) / math.sqrt(vx) / math.sqrt(vy)


@pytest.mark.parametrize("n,offset", [(0, 0.0), (1, 5.0), (2, 0.0), (400, 0.0), (400, 1e9), (400, -3e12)])
def test_pairwise_with_nulls_constants_and_offsets(spark, n, offset):
    rnd = random.Random(n)
    rows = []
    for _ in range(n):
        x = rnd.uniform(-1, 1)
        rows.append((offset + x, offset + x * 2 + rnd.uniform(-1, 1), None if rnd.random() < 0.4 else offset - x, 0.1, None))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS)).repartition(5)
    got = {(r.feature_a, r.feature_b): r.r for r in correlations(df, COLS).collect()}
    assert len(got) == 10
    for i, a in enumerate(COLS):
        for j, b in enumerate(COLS[:i]):
            want = plain(rows, i, j)
            if want is None:
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want, abs=1e-6 if abs(offset) < 1e10 else 1e-3)


def test_one_aggregate_over_one_shuffle_of_matrices(spark):
    df = spark.range(100).selectExpr(*[f"cast(id * {k + 1} % 7 as double) as c{k}" for k in range(15)])
    plan = correlations(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "corr(" not in plan and plan.count("MapInArrow") == 1
