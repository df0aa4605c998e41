"""Grouped order statistics and modes from counted values.

A per-group `median` buffers the values of a group in one task.  Here equal
values are counted first (map-side).  The medians of all columns of a group
are then found by bins: each group's values fall into `BINS` stretches of
equal width between its least and greatest value, a running count over at
most `BINS` bins tells which of them hold the middle, and only these are
ordered.  A hot group is counted by (group, value) and binned by (group,
bin), so it is spread over all tasks.  Everything is lazy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a group's range.  A bin is ordered in one task; what it holds are distinct values.
BINS = 1024


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def long_values(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """One narrow row per value: group, _c (the column's name), _v (as double)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.select(*group, F.expr(f"stack({len(cols)}, {pairs}) as (_c, _v)"))


def grouped_medians(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """One row per group: the exact median (mean of the two middle values) of
    the non-null values of each column; NULL if a group has none.  NaN counts
    as the greatest value, as the engine orders it.  ``group`` may be empty."""
    keys = [*group, "_c"]
    counts = (long_values(df, group, cols).where(F.col("_v").isNotNull()).groupBy(*keys, "_v")
              .agg(F.count(F.lit(1)).alias("_n")))
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < F.lit(float("inf"))), F.col("_v"))
    size = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    # halves keep the width of any two finite values finite
    share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    place = (F.when(F.isnan("_v") | (F.col("_v") == F.lit(float("inf"))), F.lit(BINS + 1))
             .when(F.col("_v") == F.lit(-float("inf")), F.lit(-1))
             .when(F.col("_high") > F.col("_low"), F.least(F.floor(share * BINS), F.lit(BINS))).otherwise(F.lit(0)))
    binned = (counts.alias("a").join(size.alias("b"), _same("a", "b", keys))
              .select("a.*", "b._total", place.cast("int").alias("_bin")))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_s"), F.first("_total").alias("_t"))
    per_bin = per_bin.withColumn("_before", F.coalesce(F.sum("_s").over(upto), F.lit(0)))
    low, high = F.floor((F.col("_t") - 1) / 2), F.ceil((F.col("_t") - 1) / 2)  # 0-based places of the middle
    after = F.col("_before") + F.col("_s")
    middle = per_bin.where((F.col("_before") <= high) & (after > low)).select(*keys, "_bin", "_before", "_t")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (binned.alias("a").join(middle.alias("b"), _same("a", "b", [*keys, "_bin"]))
          .select("a.*", "b._before", "b._t")
          .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)))

    def value_at(where: Column) -> Column:
        return F.max(F.when((F.col("_upto") > where) & (F.col("_upto") - F.col("_n") <= where), F.col("_v")))

    found = at.groupBy(*keys).agg(value_at(low).alias("_lo"), value_at(high).alias("_hi"))
    median = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * 0.5 + F.col("_hi") * 0.5)
    found = found.select(*group, "_c", median.alias("_m"))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(c) for c in cols])


def grouped_modes(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """One row per group: the most frequent non-null value of each column, the
    lowest of equally frequent ones.  Values are counted first and the best
    count kept by an aggregate, so no task holds a group's values."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in cols)
    counts = (df.select(*group, F.expr(f"stack({len(cols)}, {pairs}) as (_c, _v)"))
              .groupBy(*group, "_c", "_v").agg(F.count(F.lit(1)).alias("_n")))
    best = [F.min_by("_v", F.when((F.col("_c") == c) & F.col("_v").isNotNull(), F.struct(-F.col("_n"), F.col("_v"))))
            .alias(c) for c in cols]
    return counts.groupBy(*group).agg(*best)
