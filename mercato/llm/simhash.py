"""SimHash near-duplicates.

Fingerprints: bit majority over the XXH64 of all word shingles.  Search by
the pigeonhole principle: the 64 bits are cut into six blocks; two
fingerprints that differ in at most three bits agree in at least three of
the blocks, so they meet in one of the 20 tables keyed by three blocks
(about 32 bits each).  Only distinct fingerprints enter the tables.  A
bucket larger than ``TILE`` is cut into tiles and every pair of tiles is a
task of its own; inside a task the exact Hamming distance is verified and a
spanning forest of the links leaves it, never all pairs.  Components are
found by alternating star contractions on those links, each round written
to the shared checkpoint folder.

NULL and empty texts have the fingerprint zero and link like any other.
Equal texts, repeated rows and ties fall together in one fingerprint.  A
NULL doc_id takes part; it is a component's id only if no member has one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from mercato.llm.common import append_columns, materialise, quoted, read_table

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints of a bucket that one task compares with each other.
TILE = 2048
#: Bit ranges of the six blocks.
BLOCKS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text as an unsigned integer."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones, total = np.zeros(64, np.int64), n
    a, b = starts[:n].tolist(), ends[shingle - 1:].tolist()
    for k in range(0, n, 8192):
        hashes = np.fromiter([digest(joined[i:j], seed) for i, j in zip(a[k:k + 8192], b[k:k + 8192])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", to: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of each text as a signed 64-bit integer."""

    def factory():
        def made(texts):
            prints = [fingerprint((t or "").encode("utf-8"), shingle) for t in texts.to_pylist()]
            return [pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())]

        return made

    return append_columns(df, text_col, [StructField(to, LongType())], factory)


def _bits(fp, a: int, b: int):
    return F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def _tables(fp):
    """The 20 keys of a fingerprint: three block values and the table's number."""
    keys = []
    for t, chosen in enumerate(itertools.combinations(BLOCKS, 3)):
        key, at = F.lit(t).cast("long"), 5
        for a, b in chosen:
            key = key.bitwiseOR(F.shiftleft(_bits(fp, a, b), at))
            at += b - a
        keys.append(key)
    return F.array(*keys)


def spanning_links(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of close fingerprints."""
    out, rest = [], prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                reached = rest[near]
                out.extend((int(x), int(y)) for y in reached)
                queue.extend(reached)
                rest = rest[~near]
    return out


def links(prints: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Spanning links (a, b) of all distinct fingerprints ``fp`` that differ in
    at most ``max_bits`` (three at most, by the six blocks) bits."""
    if max_bits > 3:
        raise ValueError("six blocks, three of them equal, find at most three differing bits")
    members = prints.select("fp", F.explode(_tables(F.col("fp"))).alias("key"))
    # written once, so that the join below shuffles both sides and adaptive execution can split a hot bucket
    shared = materialise(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    dealt = (members.join(shared, "key").withColumn("tiles", tiles).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []

        def close(block: np.ndarray):
            """Links of whole groups, rows of (key, i, j, fp)."""
            new = np.ones(len(block), bool)
            new[1:] = (block[1:, :3] != block[:-1, :3]).any(axis=1)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(block)))
            fps = block[:, 3].view(np.uint64) if block.flags.c_contiguous else np.ascontiguousarray(block[:, 3]).view(np.uint64)
            two = starts[sizes == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits
            pairs = [np.stack([fps[two[near]], fps[two[near] + 1]], axis=1)]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found = spanning_links(fps[s:s + n], max_bits)
                if found:
                    pairs.append(np.array(found, np.uint64))
            made = np.concatenate(pairs).view(np.int64)
            made = np.sort(made, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([*held, rows]) if held else rows
            differs = (rows[:, :3] != rows[-1, :3]).any(axis=1)
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut:
                yield close(np.ascontiguousarray(rows[:cut]))
            held = [rows[cut:]]
        if held and len(held[0]):
            yield close(np.ascontiguousarray(held[0]))

    return grouped.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): its component's
    smallest node.  Alternates large and small stars until nothing changes."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours hang on the smallest neighbour
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: smaller neighbours and the node itself hang on the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = materialise(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def labelled(prints: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id, root) for every distinct fingerprint of ``prints``
    (``id_col``, fp): the smallest id of its component."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(quoted(id_col)).alias("least_id")))
    linked = components(links(distinct.select("fp"), max_bits))
    linked = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return materialise(rooted.join(ids, "root").select("fp", "root", "component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) for every row of ``df``."""
    prints = materialise(with_fingerprint(df.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")),
                                          "text", "fp", shingle).drop("text"))
    found = labelled(prints, max_bits, "doc_id")
    return prints.join(found.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``df`` of each near-duplicate group: the one with the
    smallest id (of rows that repeat it with one fingerprint, the one with the
    smallest hash of its text, then of all its columns), with the columns of ``df``."""
    columns = df.columns
    tagged = df.select(F.struct(*[quoted(c) for c in columns]).alias("__llm_row"), quoted(id_col).alias("__llm_id"),
                       quoted(text_col).cast("string").alias("text"),
                       F.struct(F.xxhash64(quoted(text_col)).alias("a"), F.xxhash64(*[quoted(c) for c in columns]).alias("b"))
                       .alias("__llm_place"))
    printed = materialise(with_fingerprint(tagged, "text", "fp", shingle).drop("text"))
    found = labelled(printed.select("__llm_id", "fp"), max_bits, "__llm_id")
    ids = printed.select("__llm_id", "fp").distinct()
    # of the fingerprints of a component that carry its smallest id, the smallest one stays
    keep = (ids.join(found, "fp").where(F.col("__llm_id").eqNullSafe(F.col("component_id")))
            .groupBy("root", "component_id").agg(F.min("fp").alias("keep_fp")))
    chosen = printed.join(keep, (printed["fp"] == keep["keep_fp"])
                          & printed["__llm_id"].eqNullSafe(keep["component_id"]), "left_semi")
    return chosen.groupBy("fp", "__llm_id").agg(F.min_by("__llm_row", "__llm_place").alias("__llm_row")).select(
        *[F.col("__llm_row").getField(c).alias(c) for c in columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
