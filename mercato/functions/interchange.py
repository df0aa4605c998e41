"""Engine-neutral result types at the query boundary.

Calendar dates leave the jobs as midnight TIMESTAMP_NTZ: pandas, Arrow and
DuckDB consumers then all see the same datetime values instead of a mix of
`datetime.date` objects and timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def portable(df: DataFrame) -> DataFrame:
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, DateType)]
    if not dates:
        return df
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates})
