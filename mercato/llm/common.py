"""Helpers shared by the operators: table access, reliable intermediate
tables and column-appending Arrow maps that see whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from mercato.session import ensure_checkpoint_dir

#: Bytes of text handled at once inside a task (a longer single text is one slice).
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and a Python worker (a longer single row is one batch).
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder that the cluster
    names in ``spark.checkpoint.dir`` and read it back: later steps neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column, n: int):
    """crc32 of the value as text, modulo ``n`` (NULL stays NULL)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a
    NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, n + 1,
                            column.offset * (8 if wide else 4)).astype(np.int64)
    raw = column.buffers()[2]
    if raw is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes of text; every row is in
    exactly one range and a longer text is a range of its own."""
    _, offsets = text_buffer(column)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def append_columns(df: DataFrame, text_col: str, fields: list[StructField],
                   factory: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``df`` with columns computed from whole texts in Arrow batches.

    ``factory()`` runs once in each task and returns a function from a string
    array to one array per field.  A column of ``df`` whose name equals one
    of the new names is replaced, as ``withColumn`` does; a text column that
    is not a string is read as its string form.
    """
    taken = {f.name.lower() for f in fields} - {text_col.lower()}
    names = [c for c in df.columns if c.lower() not in taken]
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    base = df.select(*[(quoted(c).cast("string") if c == text_col else quoted(c)).alias(c) for c in names])
    schema = StructType(list(base.schema.fields) + fields)
    at, out_names = names.index(text_col), [f.name for f in schema.fields]

    def run(batches):
        made = factory()
        for batch in batches:
            for a, b in row_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *made(part.column(at))], out_names)

    return base.mapInArrow(run, schema)


# ------------------------------------------------------------ words as hashes
_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(kind: str, n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64 for the hash base or its inverse."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = _POWERS[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def byte_classes(groups: list[list[tuple[int, int]]], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, value of each byte in a hash); class 0 separates."""
    classes = np.zeros(256, np.uint8)
    for k, ranges in enumerate(groups, 1):
        for a, b in ranges:
            classes[a:b + 1] = k
    values = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    if lower:
        values[65:91] = values[97:123]
        classes[65:91] = classes[97:123]
    return classes, values


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, on UTF-8 bytes.
ITEM_WORDS = byte_classes([[(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)]], lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def hashed_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, values: np.ndarray):
    """Maximal runs of one byte class within each row.

    Returns (hash, start byte, end byte, row) of every run in order.  Equal
    runs have equal hashes in every task; users verify what a hash finds.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    kind = classes[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offsets] = True
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[data] * _powers("up", n), out=total[1:])
    h = mix((total[ends] - total[starts]) * _powers("down", n)[starts])
    rows = np.searchsorted(offsets, starts, "right") - 1
    return h, starts, ends, rows
