"""Packing documents into sequences by cutting-stock column generation.

A document's ids and a closing id are cut into full pieces of ``size`` ids
and a rest.  The lengths of all rests form a histogram.  A linear program
chooses how often each pattern, a set of lengths that go into one sequence,
is used; a sequence is padded to ``size`` unless its length is a power of
two, and leaving a rest over to be cut costs as much as ``CUT_COST`` padded
ids.  New patterns are priced by a knapsack dynamic program over the duals.
The rounded patterns take the documents of each length by their rank; what
is left over is laid end to end and cut where a sequence is full, the last
part into powers of two, so that it needs no padding.

Ranks come from counts per (input part, length), so no length is ever sorted
or collected.  The driver holds the histogram and the patterns only, at most
``size`` lengths.  NULL and empty texts have the closing id alone.  A
repeated row is a document of its own; ids may be NULL or repeat; only the
two named columns are read.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from mercato.llm.bpe import MAX_RANK_BYTES
from mercato.llm.common import BATCH_BYTES, materialise, quoted, read_table, row_slices
from mercato.llm.merges import MergeEncoder

#: Padded ids that leaving a rest over to be cut is worth.
CUT_COST = 1.0
#: Runs of the dynamic program at most, and the gain of a run, as a share of
#: the cost of all rests, below which the program ends.
RUNS, LEAST_GAIN = 12, 5e-3
#: Pieces that are cut are found by a broadcast of their keys up to this number (16 bytes each), else by a join.
BROADCAST_KEYS = 1 << 20
EPS = 1e-9


# ----------------------------------------------------------- linear program
def padding(size: int) -> np.ndarray:
    """Padded ids of a sequence of each length 0..size."""
    n = np.arange(size + 1)
    return np.where((n > 0) & (n & (n - 1) == 0), 0, size - n)


def price(duals: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Unbounded knapsack: for every total 0..size the largest sum of duals of lengths that add up to it."""
    best = np.full(size + 1, -np.inf)
    best[0] = 0.0
    for total in range(int(lengths[0]), size + 1):
        fitting = int(np.searchsorted(lengths, total, "right"))
        best[total] = (duals[:fitting] + best[total - lengths[:fitting]]).max()
    return best


def trace(total: int, best: np.ndarray, duals: np.ndarray, lengths: np.ndarray, left: np.ndarray, rng) -> list[int]:
    """Lengths (as indices) of a best set for ``total``; of equally good ones
    drawn in proportion to the ids of that length that are left over."""
    found = []
    while total:
        fitting = int(np.searchsorted(lengths, total, "right"))
        good = np.flatnonzero(duals[:fitting] + best[total - lengths[:fitting]] >= best[total] - EPS)
        weight = np.cumsum(left[good] * lengths[good])
        k = int(good[np.searchsorted(weight, rng.random() * weight[-1], "right")]) if weight[-1] > 0 else int(good[-1])
        found.append(k)
        total -= int(lengths[k])
    return found


def patterns_for(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (copies of each length, one row per pattern) and how often the
    linear program uses each (not whole).

    Simplex with an explicit inverse.  One run of the dynamic program prices
    the best pattern of every total; patterns are traced from it, for every
    length that is left over, and those that still pay enter the basis.
    """
    rng, m, pad = np.random.default_rng(1), len(lengths), padding(size)
    rest_cost = CUT_COST * lengths / size
    inverse, level, cost, duals = np.eye(m), demand.astype(float), rest_cost.copy(), rest_cost.copy()
    over = np.arange(m)  # the length that a row of the basis leaves over; -1 if it uses a pattern
    used_by: list[np.ndarray | None] = [None] * m

    def enter(used: np.ndarray, copies: np.ndarray, price_of: float, rest: int) -> bool:
        """Bring a column into the basis if it pays."""
        nonlocal duals
        worth = float(duals[used] @ copies) - price_of
        if worth <= EPS:
            return False
        step = inverse[:, used] @ copies
        up = np.flatnonzero(step > EPS)
        if not len(up):
            return False
        row = up[(level[up] / step[up]).argmin()]
        amount = level[row] / step[row]
        np.maximum(level - amount * step, 0, out=level)
        level[row] = amount
        pivot = inverse[row] / step[row]
        touched = np.flatnonzero(np.abs(step) > EPS)
        inverse[touched] -= np.outer(step[touched], pivot)
        inverse[row] = pivot
        duals = duals - worth * pivot
        cost[row], over[row] = price_of, rest
        used_by[row] = None
        if rest < 0:
            used_by[row] = np.zeros(m, np.int64)
            used_by[row][used] = copies
        return True

    def left_over() -> np.ndarray:
        left = np.zeros(m)
        rows = over >= 0
        left[over[rows]] = level[rows]
        return left

    total = float(cost @ level)
    least = total * LEAST_GAIN
    for _ in range(RUNS):
        known, best = duals.copy(), price(duals, lengths, size)
        gain, left = best - pad, left_over()
        for k in np.argsort(-left * lengths).tolist():
            ends = np.flatnonzero(gain[lengths[k]:] > EPS) + lengths[k]
            if left[k] <= EPS or not len(ends):
                continue
            # the total at which a pattern with this length pays most
            value = known[k] + best[ends - lengths[k]] - pad[ends]
            if value.max() <= EPS:
                continue
            end = int(ends[::-1][value[::-1].argmax()])
            found = [k, *trace(end - int(lengths[k]), best, known, lengths, left, rng)]
            if enter(*np.unique(found, return_counts=True), float(pad[end]), -1):
                while True:  # a length whose dual is above the cost of leaving it over is left over again
                    worst = int((duals - rest_cost).argmax())
                    if duals[worst] - rest_cost[worst] <= EPS or not enter(
                            np.array([worst]), np.ones(1), float(rest_cost[worst]), worst):
                        break
                left = left_over()
        now = float(cost @ level)
        if total - now < least:
            break
        total = now
    rows = [k for k in range(m) if over[k] < 0 and level[k] > EPS]
    return np.array([used_by[k] for k in rows], np.int64).reshape(-1, m), level[rows]


def rounded(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """(Patterns with whole counts, rests of each length that stay over)."""
    chosen: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    if not len(lengths):
        return chosen, left
    patterns, level = patterns_for(lengths, demand, size)
    for k in np.argsort(-level, kind="stable").tolist():
        used = np.flatnonzero(patterns[k])
        n = min(int(np.ceil(level[k] - EPS)), int((left[used] // patterns[k][used]).min()))
        if n > 0:
            chosen.append((patterns[k], n))
            left[used] -= n * patterns[k][used]
    return chosen, left


class Plan:
    """Where the piece with a given length and rank goes.

    ``slots`` are stretches of ranks of one length: rank r of a slot goes to
    sequence ``sequence + r - rank`` at ``offset``, or, for what is left over
    (sequence -1), to place ``offset + (r - rank) * length`` of the line that is cut.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, size: int):
        self.size = size
        rest = lengths < size
        chosen, left = rounded(lengths[rest], counts[rest], size)
        own = lengths[rest]
        taken, slots, sequence = np.zeros(len(own), np.int64), [], 0
        for pattern, n in chosen:
            offset = 0
            for k in np.flatnonzero(pattern).tolist():
                for _ in range(int(pattern[k])):
                    slots.append((int(own[k]), int(taken[k]), sequence, offset))
                    taken[k] += n
                    offset += int(own[k])
            sequence += n
        full = int(counts[~rest].sum())
        if full:
            slots.append((size, 0, sequence, 0))
            sequence += full
        self.line_sequence, line = sequence, 0
        for k in np.flatnonzero(left).tolist():
            slots.append((int(own[k]), int(taken[k]), -1, line))
            line += int(left[k]) * int(own[k])
        self.line, self.whole = line, line // size * size
        # the end of the line: one sequence for each power of two in what is left
        tail = [1 << b for b in range(size.bit_length(), -1, -1) if (line - self.whole) >> b & 1]
        self.tail_ends = self.whole + np.cumsum(np.array(tail, np.int64))
        slots.sort()
        table = np.array(slots, np.int64).reshape(-1, 4)
        self.length, self.rank, self.sequence, self.offset = table.T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces; sequence -1 with the place in the line for what is cut."""
        wide = np.int64(1) << 40
        slot = np.searchsorted(self.length * wide + self.rank, length * wide + rank, "right") - 1
        ahead = rank - self.rank[slot]
        line = self.sequence[slot] < 0
        return (np.where(line, -1, self.sequence[slot] + ahead),
                self.offset[slot] + np.where(line, ahead * length, 0))

    def bounds(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, where it begins, where it ends) of places in the line."""
        k = np.searchsorted(self.tail_ends, place, "right")
        late = place >= self.whole
        begins = np.append(self.whole, self.tail_ends)
        number = np.where(late, self.whole // self.size + k, place // self.size)
        begin = np.where(late, begins[k], place // self.size * self.size)
        end = np.where(late, np.append(self.tail_ends, self.line)[k], begin + self.size)
        return self.line_sequence + number, begin, end

    def cut(self, place: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of the parts of a piece of the line."""
        parts, at = [], 0
        while at < length:
            sequence, begin, end = (int(x[0]) for x in self.bounds(np.array([place + at])))
            n = min(length - at, end - place - at)
            parts.append((at, n, sequence, place + at - begin))
            at += n
        return parts


# --------------------------------------------------------------------- Spark
_LOADED: dict[int, MergeEncoder] = {}


def _encoder(spec: bytes) -> MergeEncoder:
    """One encoder per Python worker and vocabulary."""
    key = zlib.crc32(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = MergeEncoder(spec)
    return _LOADED[key]


def _field(name: str, kind=None) -> StructField:
    return StructField(name, kind or LongType())


def pieces(df: DataFrame, tokenizer_path: str, size: int, closing: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece of ``size`` ids or less: id, start, length, ids_crc32,
    doc_tokens, part (the task), local (its rank among the part's pieces of
    its length), uid, and ids, of rests only."""
    with open(tokenizer_path, "rb") as f:
        spec = f.read(MAX_RANK_BYTES + 1)
    if len(spec) > MAX_RANK_BYTES:
        raise ValueError("the vocabulary file is larger than MAX_RANK_BYTES")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sent = df.sparkSession.sparkContext.broadcast(spec)
    base = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    schema = StructType([base.schema.fields[0], *map(_field, ("start", "length", "ids_crc32", "doc_tokens", "part", "local", "uid")),
                         _field("ids", BinaryType())])

    def run(batches):
        encoder, part = _encoder(sent.value), TaskContext.get().partitionId()
        seen, total = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for a, b in row_slices(batch.column(1), BATCH_BYTES):
                ids, at = encoder.encode_column(batch.column(1).slice(a, b - a))
                counts = np.diff(at) + 1
                ids = np.insert(ids.astype("<u4", copy=False), at[1:], closing)
                n = -(-counts // size)
                doc = np.repeat(np.arange(b - a), n)
                order = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = order * size
                length = np.minimum(size, counts[doc] - start)
                begin = (np.cumsum(counts) - counts)[doc] + start
                raw = memoryview(ids.tobytes())
                spans = [raw[4 * x:4 * y] for x, y in zip(begin.tolist(), (begin + length).tolist())]
                # rank of each piece among those of its length so far
                by_length = np.argsort(length, kind="stable")
                sorted_length = length[by_length]
                local = np.empty(len(doc), np.int64)
                local[by_length] = np.arange(len(doc)) - np.searchsorted(sorted_length, sorted_length, "left")
                local += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(counts[doc]),
                    pa.array(np.full(len(doc), part)), pa.array(local),
                    pa.array((np.int64(part) << 36) + total + np.arange(len(doc))),
                    pa.array([None if k == size else bytes(s) for k, s in zip(length.tolist(), spans)], pa.binary())], schema.names)
                total += len(doc)

    return base.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_path: str, size: int = 2048, closing: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and the offset in it."""
    made = materialise(pieces(df, tokenizer_path, size, closing, id_col, text_col))
    counts = materialise(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # at most ``size`` rows
    plan = Plan(np.array([r.length for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    narrow = made.drop("ids").join(offsets, ["part", "length"]).withColumn("rank", F.col("_base") + F.col("local"))
    kept = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    narrow = narrow.select(*kept, "uid", "rank")
    placed_schema = StructType([*narrow.select(*kept, "uid").schema.fields, *map(_field, ("sequence_id", "offset", "line"))])
    names = placed_schema.names

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = plan.place(length, rank)
            in_line = sequence < 0
            at = np.where(in_line, offset, 0)
            number, begin, end = plan.bounds(at)
            cut = in_line & (at + length > end)
            uncut = in_line & ~cut
            sequence = np.where(uncut, number, sequence)
            offset = np.where(uncut, at - begin, offset)
            cells = [batch.column(batch.schema.get_field_index(c)) for c in names[:6]]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(sequence), pa.array(offset), pa.array(at, mask=~cut)], names)

    placed = materialise(narrow.mapInArrow(place, placed_schema))
    result = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.filter(F.col("line").isNull()).select(*result)
    keys = placed.filter(F.col("line").isNotNull()).select("uid", "line")
    n_cut = plan.line // size + len(plan.tail_ends)  # every end of a sequence cuts one piece at most
    if n_cut <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    wide = made.select("id", "start", "doc_tokens", "uid", "ids").join(keys, "uid")
    out_schema = placed.select(*result).schema

    def split(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw = r["ids"]
                for at, n, sequence, offset in plan.cut(r["line"], len(raw) // 4):
                    rows.append((r["id"], r["start"] + at, n, zlib.crc32(raw[4 * at:4 * (at + n)]), r["doc_tokens"], sequence, offset))
            if rows:
                kinds = [batch.schema.field("id").type] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], result)

    return whole.unionByName(wide.mapInArrow(split, out_schema))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")
