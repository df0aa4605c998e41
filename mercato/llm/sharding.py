"""Sharding by extendible hashing, in DataFrame functions only.

A row's hash is a string of bits.  A directory maps hash prefixes to
buckets; a bucket that holds more bytes than the limit is split on the next
bit, and only such buckets are, until every bucket fits or holds one row.
The directory is worked out eight bits a round: the bytes of the 256 cells
below every open bucket are summed (map-side first), summed again for all
shorter prefixes, and each cell points to the shortest prefix that fits.
Rows meet only the directory, never each other.

The bits come from the id first (56 bits of its MD5).  Rows that share an id
- a third of a table may - go on with the bits of a hash of their text, and
rows that are equal in both with those of a hash of their row number, so
every group can be split.  A single row above the limit is a shard of its
own and marked ``oversize``.  NULL ids hash like an empty id, NULL texts
have no bytes, an empty table has no shards.  If the whole table fits, its
one shard has the empty prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import materialise, quoted, read_table

#: Bytes of text that a shard holds at most.
BYTE_LIMIT = 16 << 20
#: Bits of one hash, and bits that a round decides.
HASH_BITS = 56
ROUND_BITS = 8
HASHES = ("__h_id", "__h_text", "__h_row")


def _bits(number, width):
    """The lowest ``width`` bits of a number as text."""
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(number), width, "0"))


def id_hash(column):
    """56 bits of the MD5 of an id's text form."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4),
                  16, 10).cast("long")


def _directory(cells: DataFrame, byte_limit: int, least: int) -> DataFrame:
    """(prefix, cell, depth, bucket, shard_bytes, shard_docs): where each cell
    of the open buckets points; depth is NULL if it must be split further."""
    levels = cells.select("*", F.explode(F.sequence(F.lit(least), F.lit(ROUND_BITS))).alias("depth")).withColumn(
        "bucket", F.expr(f"cast(floor(cell / power(2, {ROUND_BITS} - depth)) as bigint)"))
    sums = levels.groupBy("prefix", "depth", "bucket").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = sums.where((F.col("shard_bytes") <= byte_limit) | (F.col("shard_docs") == 1))
    first = (levels.select("prefix", "cell", "depth", "bucket").join(fits, ["prefix", "depth", "bucket"])
             .groupBy("prefix", "cell").agg(F.min(F.struct("depth", "bucket", "shard_bytes", "shard_docs")).alias("to")))
    return cells.select("prefix", "cell", "uniform").join(first, ["prefix", "cell"], "left").select(
        "prefix", "cell", "uniform", "to.depth", "to.bucket", "to.shard_bytes", "to.shard_docs")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_limit: int = BYTE_LIMIT,
           keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (the id by default) with n_bytes,
    shard_id (the bits of its prefix), depth, shard_bytes, shard_docs and
    oversize.  A kept column with one of these names is replaced."""
    made = {"n_bytes", "shard_id", "depth", "shard_bytes", "shard_docs", "oversize"}
    keep = [c for c in (keep if keep is not None else [id_col]) if c.lower() not in made]
    mask = F.lit((1 << HASH_BITS) - 1)
    row = F.monotonically_increasing_id()
    active = materialise(docs.select(
        F.struct(*[quoted(c) for c in keep]).alias("__row"),
        F.coalesce(F.octet_length(quoted(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"),
        id_hash(quoted(id_col)).alias(HASHES[0]),
        F.xxhash64(quoted(text_col).cast("string")).bitwiseAND(mask).alias(HASHES[1]),
        row.alias("__number"))
        .withColumn(HASHES[2], F.xxhash64("__number").bitwiseAND(mask)).drop("__number")
        .withColumn("prefix", F.lit("")))
    done: list[DataFrame] = []
    segment, used, least = 0, 0, 0
    while True:
        name = HASHES[segment]
        cell = F.shiftright(F.col(name), HASH_BITS - used - ROUND_BITS).bitwiseAND(F.lit((1 << ROUND_BITS) - 1))
        here = active.withColumn("cell", cell)
        cells = here.groupBy("prefix", "cell").agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"),
            (F.min(name) == F.max(name)).alias("uniform"))
        directory = materialise(_directory(materialise(cells), byte_limit, least))
        found = here.join(directory, ["prefix", "cell"])
        done.append(found.where(F.col("depth").isNotNull()).select(
            "__row", F.col("bytes").alias("n_bytes"),
            F.concat("prefix", _bits(F.col("bucket"), F.col("depth"))).alias("shard_id"), "shard_bytes", "shard_docs"))
        still = directory.where(F.col("depth").isNull()).agg(F.count(F.lit(1)), F.bool_and("uniform")).first()
        if not still[0]:
            break
        active = materialise(found.where(F.col("depth").isNull()).withColumn(
            "prefix", F.concat("prefix", _bits(F.col("cell"), F.lit(ROUND_BITS)))).select(
            "__row", "bytes", *HASHES, "prefix"))
        used, least = used + ROUND_BITS, 1
        if used >= HASH_BITS or still[1]:  # no bit of this hash can split what is left
            segment, used = segment + 1, 0
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[F.col("__row").getField(c).alias(c) for c in keep], "n_bytes", "shard_id",
                      F.length("shard_id").alias("depth"), "shard_bytes", "shard_docs",
                      (F.col("shard_bytes") > byte_limit).alias("oversize"))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
          byte_limit: int = BYTE_LIMIT) -> None:
    """Write the rows of ``docs`` as Parquet, one folder per shard; a shard's
    rows come from one task, which holds at most a shard at a time."""
    placed = assign(docs, id_col, text_col, byte_limit, keep=docs.columns)
    placed.withColumn("shard", F.concat(F.lit("s"), "shard_id")).repartition("shard").sortWithinPartitions(
        "shard").write.partitionBy("shard").parquet(path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))


def oracle(byte_limit: int = BYTE_LIMIT) -> str:
    """DuckDB SQL for ``op10`` on tables without repeated ids."""
    return f"""
with d as (select doc_id, coalesce(strlen(text), 0) as n_bytes,
             lpad(bin(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 14) as bigint)), 56, '0') as bits from documents),
p as (select doc_id, n_bytes, depth, left(bits, depth) as prefix from (select *, unnest(generate_series(0, 56)) as depth from d)),
s as (select prefix, sum(n_bytes) as shard_bytes, count(*) as shard_docs from p group by prefix having sum(n_bytes) <= {byte_limit} or count(*) = 1),
c as (select doc_id, n_bytes, prefix as shard_id, depth, shard_bytes, shard_docs,
             row_number() over (partition by doc_id order by depth) as nth from p join s using (prefix))
select doc_id, cast(n_bytes as bigint) as n_bytes, shard_id, cast(depth as integer) as depth, cast(shard_bytes as bigint) as shard_bytes,
       cast(shard_docs as bigint) as shard_docs, shard_bytes > {byte_limit} as oversize
from c where nth = 1
"""


ORACLE = oracle()
