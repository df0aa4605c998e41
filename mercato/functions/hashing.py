"""Salted hashes of ids, equal in every SQL engine.

The text form of the id and a salt are hashed with MD5; the leading 52 bits
make an integer that any engine and a double hold exactly.  Integer and text
ids work alike, and different salts give independent values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52


def id_bits(col, salt) -> Column:
    """52 bits of the id's salted hash as a long (NULL id: NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    digest = F.md5(F.concat(c.cast("string"), F.lit(f":{salt}")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def id_unit(col, salt) -> Column:
    """The same hash as a uniform double in [0, 1)."""
    return id_bits(col, salt) / F.lit(float(1 << BITS))
