"""Benchmark decontamination with suffix arrays over the training texts.

Texts become sequences of word numbers.  Each slice of documents is a shard:
its suffixes that begin with a benchmark word are sorted (the suffix array;
other suffixes cannot begin any match), and every benchmark suffix that is
long enough for a window is looked up by binary search.  The range found
holds all places where the window stands.  A longest verbatim match begins at
a pair of places whose words before differ and ends at one whose words after
differ; only these pairs are listed, by leaving out of each range the places
with the same neighbouring word, so repeated words do not multiply.  Words
that matched through their hashes are compared before they count.

The benchmark is cut into blocks of bounded size; each block is sent to the
tasks and takes one narrow pass over the documents, whatever the number of
blocks, so nothing is shuffled and a passage that many documents share costs
only its own documents.

NULL or empty texts have no words and match nothing.  Items without words
match nothing; an item with a NULL id counts as a hit but is not listed.
Repeated documents are judged each by itself; repeated items are one id.
A column whose name equals a result column is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from mercato.llm.common import ITEM_WORDS, append_columns, hashed_words, materialise, read_table, text_buffer

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in one block; a block is what is sent to the tasks.
BLOCK_BYTES = 16 << 20

#: What stands for the neighbour of an item's or a text's outermost word.
OUTSIDE_ITEM, OUTSIDE_TEXT = -1, -2

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

MATCH = StructType([StructField("item_id", StringType()), StructField("doc_word", IntegerType()),
                    StructField("item_word", IntegerType()), StructField("n_words", IntegerType())])


def words_of(text: bytes) -> list[bytes]:
    return WORDS.findall(text.translate(LOWER))


class TestBlock:
    """The suffixes of some benchmark items, ready for binary search."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        self.ids, self.words = [], []
        for item_id, text in items:
            words = words_of((text or "").encode("utf-8"))
            if words:
                self.ids.append(item_id)
                self.words.append(words)
        joined = pa.array([b" ".join(w).decode("utf-8", "surrogateescape") for w in self.words], pa.string())
        data, offsets = text_buffer(joined)
        hashes, begin, end, rows = hashed_words(data, offsets, *ITEM_WORDS)
        self.vocabulary, first_seen = np.unique(hashes, return_index=True)
        raw = data.tobytes()
        #: the words by their numbers
        self.spelled = [b""] + [raw[begin[k]:end[k]] for k in first_seen.tolist()]
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per_key = max(1, 63 // self.bits)
        self.n_keys = -(-window // self.per_key)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[hashes & np.uint64((1 << 20) - 1)] = True
        numbers = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
        counts = np.bincount(rows, minlength=len(self.ids)) if len(self.ids) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        # one test suffix for each place where a window (or a whole short item) begins
        item, place, size = [], [], []
        for k, n in enumerate(counts):
            for j in range(max(1, n - window + 1)):
                item.append(k)
                place.append(j)
                size.append(min(n, window))
        self.item, self.place, self.size = (np.array(x, np.int64) for x in (item, place, size))
        ends = first[1:]
        starts = first[self.item] + self.place if len(item) else np.zeros(0, np.int64)
        stop = np.minimum(starts + self.size, ends[self.item]) if len(item) else starts
        # the words before and after each window; none outside the item
        around = np.concatenate([[0], numbers, [0]])
        self.before = np.where(starts > first[self.item], around[starts], OUTSIDE_ITEM) if len(item) else starts
        self.after = np.where(stop < ends[self.item], around[np.minimum(stop + 1, len(around) - 1)], OUTSIDE_ITEM) if len(item) else stop
        self.low = self.keys(numbers, starts, stop, 0)
        self.high = self.keys(numbers, starts, stop, (1 << self.bits) - 1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in this block's vocabulary, 0 for other words."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[hashes & np.uint64((1 << 20) - 1)])
        if len(maybe) and len(self.vocabulary):
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == h, at + 1, 0)
        return out

    def keys(self, numbers: np.ndarray, starts: np.ndarray, stops: np.ndarray, fill: int) -> list[np.ndarray]:
        """The next ``window`` words from each start packed into a few integers
        that sort as the words do; places from ``stops`` on hold ``fill``."""
        out = []
        padded = np.concatenate([numbers, np.zeros(self.window + 1, np.int64)])
        for k in range(self.n_keys):
            key = np.zeros(len(starts), np.int64)
            for j in range(k * self.per_key, min(self.window, (k + 1) * self.per_key)):
                at = starts + j
                key = (key << self.bits) | np.where(at < stops, padded[np.minimum(at, len(padded) - 1)], fill)
            out.append(key)
        return out

    def suffix_array(self, numbers: np.ndarray, row_ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of the suffixes that begin with a benchmark word, in the
        order of their first ``window`` words, and their sorted keys."""
        starts = np.flatnonzero(numbers)
        stops = row_ends[starts]
        first = self.keys_at(numbers, starts, stops, 0)
        order = np.argsort(first, kind="stable")
        starts, first = starts[order], first[order]
        keys = [first]
        if self.n_keys > 1:
            tied = np.zeros(len(first), bool)
            same = first[1:] == first[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            who = np.flatnonzero(tied)
            rest = [np.zeros(len(first), np.int64) for _ in range(self.n_keys - 1)]
            if len(who):
                deep = [self.keys_at(numbers, starts[who], row_ends[starts[who]], k) for k in range(1, self.n_keys)]
                again = np.lexsort([*deep[::-1], first[who]])
                starts[who] = starts[who][again]
                for r, d in zip(rest, deep):
                    r[who] = d[again]
            lone = np.flatnonzero(~tied)
            for k in range(1, self.n_keys):
                rest[k - 1][lone] = self.keys_at(numbers, starts[lone], row_ends[starts[lone]], k)
            keys += rest
        return starts, keys

    def keys_at(self, numbers, starts, stops, k):
        padded_end = len(numbers) - 1
        key = np.zeros(len(starts), np.int64)
        for j in range(k * self.per_key, min(self.window, (k + 1) * self.per_key)):
            at = starts + j
            key = (key << self.bits) | np.where(at < stops, numbers[np.minimum(at, padded_end)], 0)
        return key

    def search(self, keys: list[np.ndarray], targets: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of every test suffix at once; ``after``: past equal ones."""
        n = len(keys[0])
        lo = np.searchsorted(keys[0], targets[0], "left")
        hi = np.searchsorted(keys[0], targets[0], "right")
        if self.n_keys == 1:
            return hi if after else lo
        open_ = np.flatnonzero(lo < hi)
        a, b = lo[open_], hi[open_]
        wanted = [t[open_] for t in targets[1:]]
        while len(open_) and (a < b).any():
            mid = np.minimum((a + b) // 2, n - 1)
            less = np.zeros(len(mid), bool)
            equal = np.ones(len(mid), bool)
            for have, want in zip(keys[1:], wanted):
                less |= equal & (have[mid] < want)
                equal &= have[mid] == want
            right = (a < b) & (less | equal if after else less)
            left = (a < b) & ~right
            a = np.where(right, mid + 1, a)
            b = np.where(left, mid, b)
        lo[open_] = a
        return lo


def other_neighbours(low: np.ndarray, high: np.ndarray, wanted: np.ndarray, group: np.ndarray,
                     neighbour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(search, place in the suffix array) of all places in the ranges [low,
    high) whose neighbouring word is not the wanted one.  ``group`` numbers the
    equal suffixes, in their order; a range is one group, or several if its
    wanted word is outside every text."""
    order = np.lexsort((neighbour, group))
    shift = OUTSIDE_TEXT
    span = int(max(neighbour.max(initial=0), wanted.max(initial=0))) - shift + 1
    key = group[order] * span + (neighbour[order] - shift)
    mine = group[low] * span + (wanted - shift)
    same_from = np.clip(np.searchsorted(key, mine, "left"), low, high)
    same_to = np.clip(np.searchsorted(key, mine, "right"), same_from, high)
    begin, size = np.concatenate([low, same_to]), np.concatenate([same_from - low, high - same_to])
    who = np.repeat(np.concatenate([np.arange(len(low))] * 2), size)
    at = np.arange(len(who)) - np.repeat(np.cumsum(size) - size - begin, size)
    return who, order[at]


def find_matches(block: TestBlock, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]]]:
    """Number of words of each text, and its longest matches with the block as
    (item number, first word in the text, first word in the item, words)."""
    data, offsets = text_buffer(texts)
    hashes, starts, ends, rows = hashed_words(data, offsets, *ITEM_WORDS)
    n_words = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(texts))]
    if not len(hashes) or not len(block.item):
        return n_words, found
    first = np.concatenate([[0], np.cumsum(n_words)])
    numbers, raw = block.numbers(hashes), data.tobytes()
    while numbers.any():
        item, row_place, item_place, size = _diagonals(block, numbers, first, rows)
        if not len(item):
            break
        # every word that lies in a match is compared once
        depth = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(depth, row_place, 1)
        np.add.at(depth, row_place + size, -1)
        inside = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
        wrong = [k for k, a, b, w in zip(inside.tolist(), starts[inside].tolist(), ends[inside].tolist(), numbers[inside].tolist())
                 if raw[a:b].translate(LOWER) != block.spelled[w]]
        if wrong:  # another word with the same hash: it is no benchmark word
            numbers[wrong] = 0
            continue
        row = rows[row_place]
        for r, k, w, p, n in zip(row.tolist(), item.tolist(), (row_place - first[row]).tolist(), item_place.tolist(), size.tolist()):
            found[r].append((k, w, p, n))
        break
    return n_words, found


def _diagonals(block: TestBlock, numbers: np.ndarray, first: np.ndarray, rows: np.ndarray):
    """Longest matches: (item, word among all texts, word in the item, words), by item and diagonal."""
    places, keys = block.suffix_array(numbers, first[1:][rows])
    low = block.search(keys, block.low, after=False)
    high = block.search(keys, block.high, after=True)
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return hit, hit, hit, hit
    low, high, size = low[hit], high[hit], block.size[hit]
    fresh = np.zeros(len(places), bool)
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    group = np.cumsum(fresh)
    before = np.where(places > first[rows[places]], numbers[places - 1], OUTSIDE_TEXT)
    after_at = places + block.window
    after = np.where(after_at < first[rows[places] + 1], numbers[np.minimum(after_at, len(numbers) - 1)], OUTSIDE_TEXT)
    ends = []
    for wanted, neighbour in ((block.before[hit], before), (block.after[hit], after)):
        who, at = other_neighbours(low, high, wanted, group, neighbour)
        where, place = places[at], block.place[hit][who]
        item, diagonal = block.item[hit][who], where - place
        order = np.lexsort((where, diagonal, item))
        ends.append((item[order], diagonal[order], where[order], size[who][order]))
    # on a diagonal of an item the first and the last windows of its matches take turns
    (item, diagonal, begin, _), (_, _, last, width) = ends
    return item, begin, begin - diagonal, last + width - begin


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text, one at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r.item, r.text) for r in items.where(part == b).toLocalIterator()]


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id",
            item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words and matches: the longest verbatim matches of at
    least ``window`` words (or of a whole shorter item) with their places."""
    spark = docs.sparkSession
    out = docs
    fields = [StructField("n_words", LongType()), StructField("matches", ArrayType(MATCH))]
    for k, items in enumerate(benchmark_blocks(benchmark, id_col, item_text_col, block_bytes)):
        sent = spark.sparkContext.broadcast(TestBlock(items, window))

        def factory(sent=sent):
            block = sent.value

            def made(texts):
                counts, found = find_matches(block, texts)
                listed = [[{"item_id": block.ids[i], "doc_word": d, "item_word": w, "n_words": n}
                           for i, d, w, n in row] for row in found]
                return [pa.array(counts, pa.int64()), pa.array(listed, MATCH_ARROW)]

            return made

        if k == 0:
            out = append_columns(out, text_col, fields, factory)
        else:  # a further block: its matches join those found before, one block in memory at a time
            held = materialise(out.withColumnRenamed("matches", "__llm_before"))
            out = append_columns(held, text_col, fields, factory)
            out = out.withColumn("matches", F.concat("__llm_before", "matches")).drop("__llm_before")
    return out


MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()),
                                  ("n_words", pa.int32())]))


def hit_words(column):
    """Number of words of a text that lie in some match: the spans in order,
    each counted from where the one before ended."""
    spans = F.array_sort(F.transform(column, lambda m: F.struct(
        m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["to"], s["b"]).alias("to"),
        (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["to"], s["a"]))).alias("n")),
        lambda acc: acc["n"].cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and longest_match."""
    out = matches(docs, benchmark, **options)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    out = out.withColumn("n_hit", hit_words(F.col("matches"))).withColumn("__llm_items", items)
    return out.withColumns({
        "n_items": F.size("__llm_items").cast("long"),
        "items_sha256": F.sha2(F.array_join("__llm_items", ",").cast("binary"), 256),
        "contaminated": F.col("n_hit") > 0,
        "longest_match": F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long"),
    }).drop("__llm_items", "matches")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any match, with their own columns only."""
    columns = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__llm_row"),
                         F.col("text").cast("string").alias("text"))
    kept = matches(tagged, benchmark, **options).where(F.size("matches") == 0)
    return kept.select(*[F.col("__llm_row").getField(c).alias(c) for c in columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, w[i : i + least(len(w), 10) - 1] as win
       from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, w[i : i + n - 1] as win
       from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
hits as (select dw.doc_id, bw.item_id, dw.i, dw.n from dw join bw on dw.n = bw.n and dw.win = bw.win),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
          from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id),
diag as (select doc_id, item_id, ii - i as diag, i, n, i - row_number() over (partition by doc_id, item_id, ii - i order by i) as run
         from (select distinct h.doc_id, p.item_id, h.i, p.j as ii, h.n from dw h
               join (select item_id, j, least(len(w), 10) as n, w[j : j + least(len(w), 10) - 1] as win
                     from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as j from b where len(w) > 0)) p
               on p.n = h.n and p.win = h.win)),
longest as (select doc_id, max(len) as longest_match from (select doc_id, max(i) - min(i) + max(n) as len from diag group by doc_id, item_id, diag, run) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(words.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(items.n_items, 0) as bigint) as n_items, sha256(coalesce(items.listed, '')) as items_sha256,
       coalesce(words.n_hit, 0) > 0 as contaminated, cast(coalesce(longest.longest_match, 0) as bigint) as longest_match
from d left join words using (doc_id) left join items using (doc_id) left join longest using (doc_id)
"""
