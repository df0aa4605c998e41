"""Date and time arithmetic with the reference's semantics.

Timestamps are zone-less (TIMESTAMP_NTZ); every difference is computed on the
wall-clock values, so the session time zone does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_HOUR = 3_600_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def floor_days(start, end) -> Column:
    """Whole days of end - start, floored toward minus infinity (pandas `.dt.days`).

    Half a day early gives -1, which `datediff` would report as 0.
    """
    m = micros_between(start, end)
    return F.floor(m / F.lit(float(MICROS_PER_DAY))).cast("long")


def hours_between(start, end) -> Column:
    """end - start in hours as DECIMAL(12,2) (NUMERIC(8,2) in the star)."""
    m = micros_between(start, end).cast("decimal(20,0)")
    return F.round(m / F.lit(MICROS_PER_HOUR).cast("decimal(20,0)"), 2).cast("decimal(12,2)")


def month_start(ts) -> Column:
    """DATE_TRUNC('month', ts)::DATE."""
    return F.trunc(_col(ts).cast("date"), "month")


def months_between_starts(later, earlier) -> Column:
    """Whole months between two month starts: year diff * 12 + month diff."""
    a, b = _col(later), _col(earlier)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def pg_dow(ts) -> Column:
    """Day of week with Sunday = 0 (PostgreSQL EXTRACT(DOW)); Spark's is 1-based."""
    return F.dayofweek(_col(ts)) - 1
