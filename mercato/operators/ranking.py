"""Ranking operators over a total order.

NTILE over a whole table is the one global ordering in the analytics.  A
window without PARTITION BY puts every row in one task.  But the buckets are
known once the last row of each bucket is: `ntiles` finds these cut rows and
compares every row with them, which needs no sort and no shuffle.

The order columns of a row are written as one string whose byte order is the
order asked for.  The cut rows of all orders are then selected together:

1. count the rows by the next characters of their order string, among those
   that share the prefix of a cut (a few hundred groups, counted map-side);
2. the group that holds the cut's position gives a longer prefix, and the
   position inside it; the smallest and greatest string of the group skip what
   all of its strings share;
3. when few enough rows share the prefix, these strings are fetched.

The order must be total (append key columns as tie-breaks), otherwise NTILE
itself is not deterministic.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, StringType

#: Characters by which a prefix grows in one pass.
STEP = 2
#: Rows of one cut whose order strings are fetched at last.
FETCH = 2_000


@dataclass(frozen=True)
class By:
    """One column of an order.  Text can only be ascending."""

    column: str
    descending: bool = False
    nulls_last: bool = False


def ntile_window(df: DataFrame, k: int, order: list[Column], out: str) -> DataFrame:
    """Plain `ntile(k) over (order by ...)` (single partition; small inputs only)."""
    return df.withColumn(out, F.ntile(k).over(Window.orderBy(*order)))


def order_string(df: DataFrame, order: list[By]) -> Column:
    """The order columns as one string that sorts as the order does."""
    parts = []
    for by in order:
        c, kind = F.col(by.column), df.schema[by.column].dataType
        if isinstance(kind, StringType):
            if by.descending:
                raise ValueError("text is only ordered ascending")
            # the end of a text sorts before every character of a longer one
            text = F.concat(F.replace(c, F.lit("\0"), F.lit("\0\1")), F.lit("\0\0"))
        else:
            if isinstance(kind, DateType):
                n = F.unix_date(c).cast("long")
            elif isinstance(kind, DecimalType):
                n = (c * F.lit(10 ** kind.scale)).cast("long")
            elif isinstance(kind, IntegralType):
                n = c.cast("long")
            else:
                raise ValueError(f"no exact order string for {kind.simpleString()}")
            n = F.bitwise_not(n) if by.descending else n
            text = F.lpad(F.hex(n.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
        parts.append(F.when(c.isNull(), F.lit("2" if by.nulls_last else "0")).otherwise(F.concat(F.lit("1"), text)))
    return F.concat(*parts)


@dataclass
class _Cut:
    """The row at 1-based position ``place`` among those whose string begins with ``prefix``."""

    out: str
    place: int
    rows: int
    prefix: str = ""
    found: str | None = None

    def narrow(self, groups) -> None:
        """``groups``: (characters, rows, smallest, greatest) of the longer prefixes, in order."""
        for _, n, low, high in sorted(groups, key=lambda g: g[2]):
            if self.place <= n:
                if low == high:
                    self.found = low
                self.prefix, self.rows = os.path.commonprefix([low, high]), n
                return
            self.place -= n


def cut_strings(keys: DataFrame, cuts: list[_Cut]) -> None:
    """Find the order string of every cut; ``keys`` has a column of order strings for each ``out``."""
    while open_ := [c for c in cuts if c.found is None]:
        few = [c for c in open_ if c.rows <= FETCH]
        many = [c for c in open_ if c.rows > FETCH]
        asked = [F.when(F.col(c.out).startswith(c.prefix), F.struct(
            F.lit(k).alias("cut"),
            (F.substring(c.out, len(c.prefix) + 1, STEP) if c in many else F.col(c.out)).alias("next"),
            F.col(c.out).alias("key"))) for k, c in enumerate(cuts) if c in open_]
        hits = keys.select(F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("h"))
        # at most FETCH strings of every cut with few rows, and one group for each next characters of the others
        got = hits.groupBy("h.cut", "h.next").agg(
            F.count(F.lit(1)), F.min("h.key"), F.max("h.key")).collect()
        for k, c in enumerate(cuts):
            if c in open_:
                c.narrow([tuple(r)[1:] for r in got if r[0] == k])


def ntiles(df: DataFrame, k: int, orders: dict[str, list[By]]) -> DataFrame:
    """``df`` with an NTILE(k) column for each of ``orders``.  ``df`` is read
    several times: pass a stored table, not a long plan.

    Every pass reads the order columns only and shuffles counts; the driver
    holds the cut rows' prefixes.  An empty table has no buckets."""
    keyed = {out: order_string(df, order) for out, order in orders.items()}
    n = df.count()
    sizes = [n // k + (j < n % k) for j in range(k)]
    keys = df.select(*[c.alias(out) for out, c in keyed.items()])
    cuts = [_Cut(out, sum(sizes[:j]), n) for out in orders for j in range(1, k) if 0 < sum(sizes[:j]) < n]
    cut_strings(keys, cuts)
    result = df
    for out, key in keyed.items():
        beyond = [F.when(key > F.lit(c.found), 1).otherwise(0) for c in cuts if c.out == out]
        result = result.withColumn(out, sum(beyond, F.lit(1)).cast("int"))
    return result


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep one row per key: the smallest by `order` (nulls first), ties broken by
    the remaining columns.  An aggregate (map-side combine), not a window, so a hot
    key never sits whole in one task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order + rest]).select(df.columns)


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """ORDER BY ... LIMIT n (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Repeatable uniform sample of n rows: smallest n by hash(key, seed)."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")
