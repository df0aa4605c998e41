"""Running totals and exact order statistics over a global order.

A window without PARTITION BY puts every row in one task.  Here the rows are
range-partitioned by the order, written once to the shared checkpoint folder
(the range bounds come from a sample, so the partitions must not be made
twice), and summed per partition; the sums of the partitions - one row each -
give every partition its starting total, and the rest happens inside the
partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.session import ensure_checkpoint_dir


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """``df`` with ``{out: total of column up to and including the row}`` in the
    given order, within each ``group``.  Rows equal in the order must not exist."""
    group = group or []
    ranged = _ranged(df, [*[F.col(g) for g in group], *order])
    totals = ranged.groupBy(*group, "_pid").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    # one row for each group and partition that holds some of it
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_pid", *[
        F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    inside = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_l_{o}") for o, c in sums.items()])
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*group, "_pid"]]
    joined = local.alias("l").join(starts.alias("s"), reduce(lambda a, b: a & b, keys))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *[(F.col(f"_b_{o}") + F.col(f"_l_{o}")).alias(o) for o in sums])


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], group: list[str] | None = None) -> DataFrame:
    """One row per group: n and q0, q1, ... - exact quantiles with linear
    interpolation of the non-null values.  Equal values are counted first
    (map-side); no task holds the distinct values of a group."""
    group = group or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    run = running_totals(counts, [F.col("_v")], {"_upto": "_n"}, group)
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("n"))
    if group:
        same = reduce(lambda a, b: a & b, [F.col(f"r.{g}").eqNullSafe(F.col(f"z.{g}")) for g in group])
        placed = run.alias("r").join(sizes.alias("z"), same).select("r.*", "z.n")
    else:
        placed = run.select("*", sizes.select("n").scalar().alias("n"))

    def at(place: Column) -> Column:
        """The value at a 0-based place."""
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col("_v")))

    out = [F.max("n").alias("n")]
    for k, p in enumerate(probabilities):
        exact = (F.col("n") - 1) * F.lit(p)
        out += [at(F.floor(exact)).alias(f"_lo{k}"), at(F.ceil(exact)).alias(f"_hi{k}")]
    got = placed.groupBy(*group).agg(*out)
    for k, p in enumerate(probabilities):
        exact = (F.col("n") - 1) * F.lit(p)
        low, high = F.floor(exact), F.ceil(exact)
        got = got.withColumn(f"q{k}", F.when(low == high, F.col(f"_lo{k}")).otherwise(
            (high - exact) * F.col(f"_lo{k}") + (exact - low) * F.col(f"_hi{k}")))
    return got.select(*group, "n", *[f"q{k}" for k in range(len(probabilities))])
