"""Exact rounding helpers.

The reference rounds NUMERIC values half away from zero.  Doing the division
in floating point and rounding afterwards flips the last digit on exact ties
(x.xx5), so ratios of integers are rounded with integer arithmetic only:

    round(n / d, k) = sign(n) * ((2 * |n| * 10^k + d) div (2 * d)) / 10^k
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Integers of sums and ratios: 38 digits, as wide as any table needs.
WIDE = "decimal(38,0)"


def idiv(a, b) -> Column:
    """Integral division of wide integers, truncating; NULL when b = 0.

    (a - a mod b) / b is exact in decimals, whose remainder has a's sign."""
    a, b = _col(a).cast(WIDE), _col(b).cast(WIDE)
    return F.when(b != 0, ((a - a % b).cast(WIDE) / b).cast(WIDE))


def round_ratio(num, den, digits: int) -> Column:
    """round(num / den, digits) half away from zero, for integral num and den.

    Returns a double (the nearest double to the exact decimal result); NULL
    when den is NULL or 0, which is the NULLIF guard of the SQL.
    """
    n = _col(num).cast(WIDE)
    d = _col(den).cast(WIDE)
    scale = 10**digits
    q = idiv((F.abs(n) * F.lit(2 * scale).cast("decimal(12,0)")).cast(WIDE) + d, (d * 2).cast(WIDE))
    signed = F.when(n < 0, -q).otherwise(q)
    # the quotient by a power of ten is exact in decimals (digits <= 6), so the double is the nearest one
    return F.when(d != 0, (signed / F.lit(scale).cast("decimal(7,0)")).cast("double"))


def unscaled(col, scale: int) -> Column:
    """Value with `scale` digits as an exact integer (value * 10^scale), wide
    enough to be summed over any table.

    Rounded before the cast: doubles such as 3.45 are 344.99999... * 100."""
    return F.round(_col(col) * F.lit(10**scale)).cast(WIDE)


def money(col) -> Column:
    """Money as DECIMAL(12,2)."""
    return _col(col).cast("decimal(12,2)")

