"""Column statistics operators (A13 describe, A14 value_counts).

`describe` computes count, mean, sample std, min, exact quartiles (linear
interpolation, like pandas) and max of several columns.  The quartiles come
from counted values in range partitions (`exact_quantiles`): exact, unlike
`summary()`, and no task holds all distinct values of a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.prefix import exact_quantiles


def describe(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        q = exact_quantiles(df.select(x.alias("v")), "v", [0.25, 0.5, 0.75])
        stats = df.agg(F.count(x).cast("long").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                       F.min(x).alias("min"), F.max(x).alias("max"))
        parts.append(stats.select(
            F.lit(c).alias("column_name"), "count", F.round("mean", digits).alias("mean"),
            F.round("std", digits).alias("std"), "min",
            *[F.round(q.select(f"q{k}").scalar(), digits).alias(n) for k, n in enumerate(("p25", "p50", "p75"))], "max"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def value_counts(df: DataFrame, col: str, dropna: bool = True, top: int | None = None) -> DataFrame:
    """Counts per value (NULL kept as its own value when dropna=False); with
    `top`, the most frequent values (ties: lowest value first)."""
    x = df if not dropna else df.filter(F.col(col).isNotNull())
    g = x.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("count"))
    if top is not None:
        g = g.orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(top)
    return g
