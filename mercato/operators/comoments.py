"""Pearson correlation of many columns from one matrix of co-moments.

Each task adds up, for every pair of columns and over the rows that have both,
the count, the sums, the squares and the products of its rows as matrix
products over Arrow batches.  It counts every column from the first value it
meets, so that large offsets cost no digits; the partial matrices are then
moved to the common mean of their pair and add up.  One row per pair and task
is shuffled, the input is read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
#: A variance below this share of the squared mean is rounding, not variance.
NOTHING = 1e-28


def comoments(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b (column numbers, b < a), n, the means ma and mb, and saa, sbb and
    sab, the centred sums over the rows that have both.  NaN counts as missing."""
    x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    a, b = np.tril_indices(len(cols), -1)
    names = ["a", "b", "pa", "pb", *_SUMS]

    def run(batches):
        total, start = np.zeros((len(_SUMS), len(cols), len(cols))), np.full(len(cols), np.nan)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            have = ~np.isnan(v)
            new = np.isnan(start) & have.any(axis=0)
            start[new] = v[have.argmax(axis=0)[new], np.flatnonzero(new)]
            v = np.where(have, v - np.nan_to_num(start), 0.0)
            have = have.astype(float)
            sums, squares = v.T @ have, (v * v).T @ have
            total += [have.T @ have, sums, sums.T, squares, squares.T, v.T @ v]
        start = np.nan_to_num(start)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(start[a]), pa.array(start[b]),
                                          *[pa.array(t[a, b]) for t in total]], names)

    partial = x.mapInArrow(run, "a int, b int, " + ", ".join(f"{c} double" for c in names[2:]))
    # every pair is there, also if no task had a row
    pairs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i, j in zip(a.tolist(), b.tolist())])
    every = df.sparkSession.range(1).select(F.inline(pairs)).select("a", "b", *[F.lit(0.0).alias(c) for c in names[2:]])
    # a window holds one row per task
    pair = Window.partitionBy("a", "b")
    mean = {k: F.try_divide(F.sum(F.col("n") * F.col(f"p{k}") + F.col(f"s{k}")).over(pair), F.sum("n").over(pair)) for k in "ab"}
    placed = partial.unionByName(every).select("*", *[F.coalesce(m, F.lit(0.0)).alias(f"m{k}") for k, m in mean.items()])
    n, (da, db) = F.col("n"), [F.col(f"m{k}") - F.col(f"p{k}") for k in "ab"]
    return placed.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.max("ma").alias("ma"), F.max("mb").alias("mb"),
        F.sum(F.col("saa") - 2 * da * F.col("sa") + n * da * da).alias("saa"),
        F.sum(F.col("sbb") - 2 * db * F.col("sb") + n * db * db).alias("sbb"),
        F.sum(F.col("sab") - db * F.col("sa") - da * F.col("sb") + n * da * db).alias("sab"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """feature_a, feature_b, r for every pair below the diagonal; r is NULL if
    fewer than two rows have both columns or one of them does not vary there."""
    n, saa, sbb = F.col("n"), F.col("saa"), F.col("sbb")
    varies = [x > NOTHING * n * F.col(m) * F.col(m) for x, m in ((saa, "ma"), (sbb, "mb"))]
    r = F.when((n > 1) & (saa > 0) & (sbb > 0) & varies[0] & varies[1], F.col("sab") / F.sqrt(saa) / F.sqrt(sbb))
    name = F.array(*[F.lit(c) for c in cols])
    return comoments(df, cols).select(F.element_at(name, F.col("a") + 1).alias("feature_a"),
                                      F.element_at(name, F.col("b") + 1).alias("feature_b"), r.alias("r"))
