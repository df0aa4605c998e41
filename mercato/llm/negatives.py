"""Hard-negative mining with Four-Russians scoring.

Vectors of whole numbers are scored against anchors exactly.  A candidate is
kept as bit planes: plane b holds bit b of every component, packed eight
dimensions to a byte, the last plane the sign.  For each group of eight
dimensions an anchor has a table of its 256 subset sums, so a plane's part of
the inner product is one lookup per group, and the planes are shifted and
added from the sign down.  Candidates are packed in chunks where they lie;
anchors go out in blocks, and each (block, cell of chunks) is scored by one
task as a stream, which keeps only the best so far of each anchor.  Two
passes: the anchors' positives, then for each positive the best rows of
another label within its score window.

Rows with a null label, a null vector or a null or non-finite component take
no part.  Missing components of a shorter vector count as zero, as do all of
an empty one.  Scores are 64-bit numbers; a component whose scaled value
does not fit into 32 bits is taken as the nearest that does.  Higher scores
come first, ties by smaller id.  A row is never the partner of an anchor with
the same id; apart from that repeated rows each count, and a repeated anchor
is mined once per row.  An empty table gives an empty result; only the three
named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from mercato.llm.common import materialise, quoted, read_table

#: Candidates of one packed chunk, of one scoring step, and anchors of a block on average.
CHUNK_ROWS, STEP_ROWS, BLOCK_ANCHORS = 2048, 256, 256
#: Tasks that share the work of one pass, per core of the cluster.
TASKS_PER_CORE = 4
#: Largest magnitude of a component after scaling.
LARGEST = (1 << 31) - 1
NOWHERE = np.int64(-1) << 62

CHUNK = StructType([StructField("n", IntegerType()), StructField("planes", IntegerType()), StructField("groups", IntegerType()),
                    StructField("ids", BinaryType()), StructField("labels", BinaryType()), StructField("bits", BinaryType()),
                    StructField("largest", LongType())])


# ------------------------------------------------------------------- scoring
def pack_planes(q: np.ndarray) -> np.ndarray:
    """Bit planes of whole vectors (n, d) as bytes (planes, groups, n), sign plane first."""
    n, d = q.shape
    groups = -(-d // 8)
    spread = max(int(q.max(initial=0)), -int(q.min(initial=0)) - 1, 0).bit_length()
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :d] = q
    out = np.empty((spread + 1, groups, n), np.uint8)
    for k, b in enumerate(range(spread, -1, -1)):  # two's complement: bit ``spread`` is the sign
        bits = (wide >> b & 1).astype(np.uint8).reshape(n, groups, 8)
        out[k] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(anchors: np.ndarray, groups: int, dtype) -> np.ndarray:
    """Tables (groups, 256, n): the sum over the dimensions whose bit is set in the index."""
    n, d = anchors.shape
    wide = np.zeros((n, groups * 8), dtype)
    used = min(d, groups * 8)
    wide[:, :used] = anchors[:, :used]
    tables = np.zeros((groups, 256, n), dtype)
    for g in range(groups):
        for k in range(8):
            np.add(tables[g, :1 << k], wide[:, 8 * g + k], out=tables[g, 1 << k:2 << k])
    return tables


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) of packed candidates."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for k, plane in enumerate(planes):
        if k:
            total <<= 1
        for g, byte in enumerate(plane):
            part = tables[g].take(byte, axis=0)
            if k:
                total += part
            else:  # the sign plane counts negatively
                total -= part
    return total


class _Best:
    """The best ``k`` candidates so far in each of several lists."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score = np.full((lists, k), NOWHERE)
        self.id = np.zeros((lists, k), np.int64)

    @property
    def bar(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of lists ``which`` (none below its list's bar)."""
        if not len(which):
            return
        touched = np.unique(which)
        have = self.score[touched]
        a = np.concatenate([np.repeat(touched, self.k), which])
        s = np.concatenate([have.ravel(), score])
        i = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        place = np.arange(len(a)) - np.searchsorted(a, a, "left")
        best = place < self.k
        self.score[a[best], place[best]] = s[best]
        self.id[a[best], place[best]] = i[best]

    def found(self):
        """(list, score, id) of all that were found."""
        which, place = np.nonzero(self.score > NOWHERE)
        return which, self.score[which, place], self.id[which, place]


class _Block:
    """One block of anchors while chunks stream by."""

    def __init__(self, block: dict, wanted: int, windows: bool, percent: tuple[int, int]):
        self.anchors = block["anchors"]
        self.uid = np.array([x["uid"] for x in self.anchors], np.int64)
        self.id = np.array([x["id"] for x in self.anchors], np.int64)
        self.label = np.array([x["label"] for x in self.anchors], np.int64)
        size = max((len(x["q"]) for x in self.anchors), default=0)
        self.q = np.zeros((len(self.anchors), size), np.int64)
        for row, x in enumerate(self.anchors):
            self.q[row, :len(x["q"])] = x["q"]
        self.tables, self.percent = {}, percent
        if windows:
            self.owner = np.array([row for row, x in enumerate(self.anchors) for _ in x["positives"]], np.int64)
            self.positive = [(p["place"], p["id"]) for x in self.anchors for p in x["positives"]]
            self.target = np.array([p["score"] for x in self.anchors for p in x["positives"]], np.int64)
            self.best = _Best(len(self.owner), wanted)
        else:
            self.best = _Best(len(self.anchors), wanted)
        self.windows = windows

    def table(self, groups: int, largest: int) -> np.ndarray:
        bound = max(int(np.abs(self.q).max(initial=0)), 1) * max(largest, 1) * max(groups * 8, 1) * 4
        dtype = np.int32 if bound < 1 << 31 else np.int64
        key = (groups, dtype)
        if key not in self.tables:
            self.tables[key] = subset_sums(self.q, groups, dtype)
        return self.tables[key]

    def score(self, chunk: dict) -> None:
        n = chunk["n"]
        planes = np.frombuffer(chunk["bits"], np.uint8).reshape(chunk["planes"], chunk["groups"], n)
        ids, labels = np.frombuffer(chunk["ids"], np.int64), np.frombuffer(chunk["labels"], np.int64)
        tables = self.table(chunk["groups"], chunk["largest"])
        for a in range(0, n, STEP_ROWS):
            got = scores(planes[:, :, a:a + STEP_ROWS], tables).astype(np.int64, copy=False)
            here, label = ids[a:a + STEP_ROWS], labels[a:a + STEP_ROWS]
            if self.windows:
                self._negatives(got, here, label)
            else:
                take = (label[:, None] == self.label) & (here[:, None] != self.id) & (got >= self.best.bar)
                row, anchor = np.nonzero(take)
                self.best.add(anchor, got[row, anchor], here[row])

    def _negatives(self, got: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        if not len(self.owner):
            return
        low, high = self.percent
        # smallest whole score with 100 * score >= low * target, largest with 100 * score <= high * target
        least = np.maximum(-(-low * self.target // 100), self.best.bar)
        most = high * self.target // 100
        mine = got[:, self.owner]
        take = (mine >= least) & (mine <= most)
        row, which = np.nonzero(take)
        other = labels[row] != self.label[self.owner[which]]
        other &= ids[row] != self.id[self.owner[which]]
        row, which = row[other], which[other]
        self.best.add(which, mine[row, which], ids[row])

    def result(self) -> list[dict]:
        which, score, ids = self.best.found()
        if self.windows:
            return [{"uid": int(self.uid[self.owner[w]]), "anchor_id": int(self.id[self.owner[w]]),
                     "place": self.positive[w][0], "positive_id": self.positive[w][1], "positive_score": int(self.target[w]), "id": int(i), "score": int(s)}
                    for w, s, i in zip(which.tolist(), score.tolist(), ids.tolist())]
        return [{"uid": int(self.uid[w]), "id": int(i), "score": int(s)}
                for w, s, i in zip(which.tolist(), score.tolist(), ids.tolist())]


# --------------------------------------------------------------------- Spark
def whole_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label and q, the vector of floor(scale * component), of the rows that take part."""
    v = quoted(vector_col)
    scaled = F.transform(v, lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return (df.filter(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & v.isNotNull() & ~bad)
            .select(quoted(id_col).cast("long").alias("id"), quoted(label_col).cast("long").alias("label"), scaled.alias("q")))


def _chunks(rows: DataFrame) -> DataFrame:
    """Packed candidates: one row per chunk."""
    names = CHUNK.names

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(a, CHUNK_ROWS)
                q = part.column(2)
                offsets = np.asarray(q.offsets)
                sizes = np.diff(offsets)
                width = int(sizes.max(initial=0))
                wide = np.zeros((part.num_rows, width), np.int64)
                wide[np.arange(width) < sizes[:, None]] = np.asarray(q.flatten())
                planes = pack_planes(wide)
                cells = [part.num_rows, planes.shape[0], planes.shape[1], np.asarray(part.column(0)).tobytes(),
                         np.asarray(part.column(1)).tobytes(), planes.tobytes(), int(np.abs(wide).max(initial=0))]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names)

    return rows.mapInArrow(run, CHUNK)


def _pass(chunks: DataFrame, blocks: DataFrame, n_blocks: int, cells: int, wanted: int, windows: bool,
          percent: tuple[int, int], schema: StructType) -> DataFrame:
    """Best candidates of each anchor and cell.  Every (block, cell) is the
    work of one task, which reads the block once and the cell's chunks one by one."""
    spread = (chunks.withColumn("cell", F.pmod(F.xxhash64("chunk"), F.lit(cells)))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    copies = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    # the anchors of a (block, cell) come before its chunks: one sorted stream, no join of wide rows
    both = (copies.withColumn("kind", F.lit(0)).unionByName(spread.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .repartition(max(1, n_blocks * cells), "block", "cell").sortWithinPartitions("block", "cell", "kind"))
    kinds = pa.schema([pa.field(f.name, pa.int64()) for f in schema.fields])

    def run(batches):
        block, key = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                item = batch.slice(row, 1).to_pylist()[0]
                if item["kind"] == 0:
                    if block is not None:
                        yield pa.RecordBatch.from_pylist(block.result(), kinds)
                    block, key = _Block(item, wanted, windows, percent), (item["block"], item["cell"])
                elif key == (item["block"], item["cell"]):  # a block may have got no anchors
                    block.score(item)
        if block is not None:
            yield pa.RecordBatch.from_pylist(block.result(), kinds)

    return both.mapInArrow(run, schema)


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id, label and q as
    ``whole_rows`` gives them; ``is_anchor`` is a condition on them).

    For each anchor and each of its first ``positives`` other rows of the
    same label, the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    chunks = materialise(_chunks(rows).withColumn("chunk", F.monotonically_increasing_id()))
    anchors = materialise(rows.filter(is_anchor).withColumn("uid", F.monotonically_increasing_id()))
    n_blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    cells = max(1, -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // n_blocks))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int"))
    of_block = F.sort_array(F.collect_list(F.struct("uid", "id", "label", "q"))).alias("anchors")
    first = _pass(chunks, anchors.groupBy("block").agg(of_block), n_blocks, cells, positives, False, (low, high),
                  _longs("uid", "id", "score"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    chosen = (first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
              .groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives")))
    with_positives = materialise(anchors.join(chosen, "uid"))
    of_block = F.sort_array(F.collect_list(F.struct("uid", "id", "label", "q", "positives"))).alias("anchors")
    second = _pass(chunks, with_positives.groupBy("block").agg(of_block), n_blocks, cells, negatives, True, (low, high),
                   _longs("uid", "anchor_id", "place", "positive_id", "positive_score", "id", "score"))
    order = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "id")
    return (second.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_rows(read_table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 256)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


ORACLE = """
WITH rows_in AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM rows_in a JOIN rows_in c ON c.vec_id <> a.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
