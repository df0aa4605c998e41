"""Periodic run detection by recompression.

The words of the texts become numbers.  A run is a maximal stretch of words
with smallest period q and at least max(least, 3 * q) words.  Candidates lie
on a harmonic grid: for every q, grid places so dense that every run of
period q has one whose word and the word q later begin equal stretches of
more than q words.  Of the grid only places where the first such words are
equal are kept.  For the texts that keep one, alternate block compression
(equal neighbours become one symbol) and pair compression (a left symbol and
a right symbol after it become one) build a run-length grammar.  Equal
stretches are parsed alike but for one symbol or block at their ends on each
level, so the longest common extension of two places climbs the levels while
symbols agree and goes down again where they differ, in one step a level;
all candidates walk together.  The reversed grammar gives the extension to
the left.

NULL and empty texts have no words and no runs.  Every text is handled by
itself, so ties and repeated rows need no special care; a column of the
input whose name equals a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from mercato.llm.common import append_columns, quoted, read_table, text_buffer

#: Words a run has at least, and how often its period fits into it at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Grid places that are compared at once.
GRID_BLOCK = 1 << 20
#: White space: every other byte belongs to a word.
SPACES = b"\t\n\x0b\x0c\r "

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


# ------------------------------------------------------------------- words
def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the n + 1 places where each text's words begin."""
    data, offsets = text_buffer(texts)
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    mark = np.zeros(len(data) + 2, bool)
    mark[1:-1] = inside[data]
    starts_here = mark[1:-1] & ~mark[:-2]
    ends_here = mark[1:-1] & ~mark[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]  # a word ends where its text ends
    starts_here[edge] |= mark[1:-1][edge]
    ends_here[edge - 1] |= mark[1:-1][edge - 1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    letters = data[mark[1:-1]]
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return words, np.searchsorted(starts, offsets, "left")


# ----------------------------------------------------------------- grammar
def _spread(symbols: np.ndarray, level: int) -> np.ndarray:
    """A fixed bit per symbol and level: is it a left symbol?"""
    h = (symbols.astype(np.uint64) + np.uint64(level * 0x51ED2701 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)) & np.uint64(1) == 1


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number per distinct pair."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    names = np.empty(len(a), np.int64)
    names[order] = np.cumsum(fresh) - 1
    return names


class Grammar:
    """Levels of a run-length grammar over ``symbols``, whose first and last
    symbol must each occur once.

    ``levels[h]`` has the symbols of level h; ``bounds[h]`` the places of
    level h - 1 where each of them begins, with the end behind the last.
    Odd levels are blocks, even ones pairs.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels, self.bounds = [np.asarray(symbols, np.int64)], [np.zeros(0, np.int64)]
        while len(self.levels[-1]) > 1:
            self._blocks()
            if len(self.levels[-1]) > 1:
                self._pairs(len(self.levels))
        self._link()

    def _add(self, heads: np.ndarray, names: np.ndarray) -> None:
        self.bounds.append(np.append(heads, len(self.levels[-1])))
        self.levels.append(names)

    def _blocks(self) -> None:
        low = self.levels[-1]
        heads = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        sizes = np.diff(np.append(heads, len(low)))
        self._add(heads, _named(low[heads], sizes))

    def _pairs(self, level: int) -> None:
        low = self.levels[-1]
        left = _spread(low, level)
        joined = left[:-1] & ~left[1:]  # no symbol is in two pairs: it is left or right
        if not joined.any():  # every level must shrink: join at the first border of a right and a left symbol
            left = ~left
            joined = left[:-1] & ~left[1:]
            if not joined.any():  # all on one side: tell them apart by rank
                left = low <= np.median(low) if len(low) > 2 else low == low[0]
                joined = left[:-1] & ~left[1:]
        head = np.append(True, ~joined)
        heads = np.flatnonzero(head)
        second = np.full(len(heads), -1, np.int64)
        has = np.append(joined, False)[heads]
        second[has] = low[heads[has] + 1]
        self._add(heads, _named(low[heads], second))

    def _link(self) -> None:
        """The node of the next level that each place belongs to."""
        self.above = [np.repeat(np.arange(len(b) - 1), np.diff(b)) for b in self.bounds[1:]]

    def mirror(self) -> "Grammar":
        """The grammar of the reversed sequence."""
        other = object.__new__(Grammar)
        other.levels = [s[::-1] for s in self.levels]
        other.bounds = [self.bounds[0]] + [b[-1] - b[::-1] for b in self.bounds[1:]]
        other._link()
        return other

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from each place ``a`` and its place ``b`` on (a != b)."""
        start, top = a, len(self.levels) - 1
        a, b = a.copy(), b.copy()
        parted = np.zeros(len(a), np.int64)  # the level on which a and b were found to differ
        live = np.arange(len(a))
        for h in range(top + 1):
            symbols = self.levels[h]
            if h == top:
                parted[live] = top
                break
            x, y = a[live], b[live]
            up, heads = self.above[h], self.bounds[h + 1]
            begin = (heads[up[x]] == x) & (heads[up[y]] == y)
            step = ~begin & (symbols[x] == symbols[y])
            s = np.flatnonzero(step)
            if len(s):
                n = self._stride(h, x[s], y[s])
                x[s] += n
                y[s] += n
                begin[s] = (heads[up[x[s]]] == x[s]) & (heads[up[y[s]]] == y[s])
                a[live], b[live] = x, y
            parted[live[~begin]] = h
            live, x, y = live[begin], x[begin], y[begin]
            if not len(live):
                break
            a[live], b[live] = up[x], up[y]
        for h in range(int(parted.max(initial=0)), 0, -1):
            q = np.flatnonzero(parted >= h)
            x, y = self.bounds[h][a[q]], self.bounds[h][b[q]]
            s = np.flatnonzero(self.levels[h - 1][x] == self.levels[h - 1][y])
            if len(s):
                n = self._stride(h - 1, x[s], y[s])
                x[s] += n
                y[s] += n
            a[q], b[q] = x, y
        return a - start

    def _stride(self, h: int, x: np.ndarray, y: np.ndarray):
        """Symbols of level h that two equal places may skip: one, or the shorter rest of their blocks."""
        if h % 2:
            return 1
        up, heads = self.above[h], self.bounds[h + 1]
        return np.minimum(heads[up[x] + 1] - x, heads[up[y] + 1] - y)


# -------------------------------------------------------------------- runs
def _grid(starts: np.ndarray, sizes: np.ndarray, least: int):
    """Blocks of (place, period) on the harmonic grid of texts that begin at
    ``starts`` with ``sizes`` words each."""
    most = np.where(sizes >= least, sizes // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    gap = np.maximum(least, LEAST_PERIODS * q) - 2 * q
    n = -(-(sizes[text] - 2 * q) // gap)
    total = np.append(0, np.cumsum(n))
    a = 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(total, total[a] + GRID_BLOCK, "right")) - 1)
        k = n[a:b]
        row = np.repeat(np.arange(a, b), k)
        place = (np.arange(len(row)) - np.repeat(total[a:b] - total[a], k)) * gap[row] + starts[text[row]]
        yield place, q[row]
        a = b


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS):
    """Runs of all texts: arrays (text, start within it, length, period) in the
    order of text, start and period.  ``words`` numbers the words of all
    texts, ``bounds`` has the n + 1 places where each text begins."""
    sizes = np.diff(bounds)
    places, periods = [], []
    for i, q in _grid(bounds[:-1], sizes, least):
        here = words[i]
        keep = np.flatnonzero(here == words[i + q])
        i, q = i[keep], q[keep]
        keep = (words[i + 1] == words[i + q + 1]) & (words[i + q] == words[i + 2 * q])
        places.append(i[keep])
        periods.append(q[keep])
    none = np.zeros(0, np.int64)
    i = np.concatenate(places) if places else none
    if not len(i):
        return none, none, none, none
    q = np.concatenate(periods)
    owner = np.searchsorted(bounds, i, "right") - 1
    # one sequence of the texts with candidates, each closed by a symbol of its own
    used = np.unique(owner)
    moved = np.zeros(len(sizes), np.int64)
    moved[used] = np.append(0, np.cumsum(sizes[used] + 1)[:-1]) + 1
    total = int((sizes[used] + 1).sum()) + 1
    top = int(words.max()) + 1
    sequence = np.empty(total, np.int64)
    sequence[0] = top
    ends = moved[used] + sizes[used]
    sequence[ends] = top + 1 + np.arange(len(used))
    inside = np.ones(total, bool)
    inside[0] = False
    inside[ends] = False
    row = np.repeat(used, sizes[used])
    sequence[inside] = words[np.arange(len(row)) - np.repeat(np.cumsum(sizes[used]) - sizes[used], sizes[used])
                             + bounds[row]]
    at = i - bounds[owner] + moved[owner]
    grammar, step = Grammar(sequence), GRID_BLOCK // 4
    right = np.concatenate([grammar.extension(at[k:k + step], at[k:k + step] + q[k:k + step])
                            for k in range(0, len(at), step)])
    near = np.flatnonzero(right > q)  # a run of three periods reaches further than one period from a grid place
    at, q, owner, right = at[near], q[near], owner[near], right[near]
    if not len(at):
        return none, none, none, none
    back, last = grammar.mirror(), total - 1
    left = np.concatenate([back.extension(last - at[k:k + step], last - at[k:k + step] - q[k:k + step])
                           for k in range(0, len(at), step)]) - 1
    start, length = at - left, left + q + right
    keep = length >= np.maximum(least, LEAST_PERIODS * q)
    start, length, q, owner = start[keep], length[keep], q[keep], owner[keep]
    order = np.lexsort((q, length, start))  # places of different texts differ
    start, length, q, owner = start[order], length[order], q[order], owner[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # the smallest period of a stretch
    start, length, q, owner = start[fresh], length[fresh], q[fresh], owner[fresh]
    order = np.lexsort((q, start))
    return owner[order], (start - moved[owner])[order], length[order], q[order]


def _collapsed(words: pa.Array, bounds: np.ndarray, runs) -> pa.Array:
    """Texts of the words that no run repeats, joined by one space."""
    owner, start, length, period = runs
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, bounds[owner] + start + period, 1)
    np.add.at(depth, bounds[owner] + start + length, -1)
    keep = np.cumsum(depth[:-1]) == 0
    kept = np.append(0, np.cumsum(keep))[bounds]
    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep)))
    return pc.binary_join(lists, " ")


def detect(df: DataFrame, text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``df`` with n_words, runs (an array of start, length, period in words)
    and collapsed: the text without what its runs repeat, white space between
    words being one space."""
    fields = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN, False)),
              StructField("collapsed", StringType())]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def factory():
        def made(texts):
            words, bounds = split_words(texts)
            numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs = find_runs(numbers, bounds, least)
            owner, start, length, period = runs
            at = np.searchsorted(owner, np.arange(len(bounds)))
            rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)],
                                              fields=list(run_type))
            return [pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows, type=pa.list_(pa.field("element", run_type, False))),
                    _collapsed(words, bounds, runs)]

        return made

    return append_columns(df, text_col, fields, factory)


def strongest(runs):
    """The run with the greatest length / period, exactly; of ties the one
    with the smallest start, then period.  NULL if there is none."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with periodic ends: of the texts whose id has a crc32
    divisible by ten, the words from place a on repeat with period p."""
    h = F.crc32(quoted(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(quoted(text_col), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    n = F.size("_w").cast("long")
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    changed = F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda i: F.element_at("_w", (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))))
    own = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    chosen = (h % 10 == 0)
    return (own.withColumn("_g", g).withColumn("_w", F.when(chosen, words))
            .select("doc_id", F.when(F.size(F.coalesce("_w", F.array())) > 0, changed)
                    .otherwise(F.col("text")).alias("text")))


def run_digests(docs: DataFrame) -> DataFrame:
    found = detect(docs)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n"))))
    return (found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("_r"),
                         F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                         F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", F.col("_r.start").alias("start"), F.col("_r.length").alias("length"),
                    F.col("_r.period").alias("period"),
                    F.floor(1000 * F.col("_r.length") / F.col("_r.period")).cast("long").alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256", "n_words"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(planted(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
