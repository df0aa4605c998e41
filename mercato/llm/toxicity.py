"""Toxicity from a learned lexicon with misspellings and context.

Lexicon: whole words, and stems (word beginnings), that labelled toxic
documents hold far more often than others, by a one-sided likelihood ratio
that allows for the number of candidates; each entry weighs its log odds.
The entries form a trie.  A word that is no entry runs as a Levenshtein
automaton against the trie, which finds all whole-word entries within one
edit (two for long ones), and all stems within as many of its beginning,
without comparing with each; words that clean labelled documents use are
never taken for misspellings.

Context: a hit inside quotation marks with a word of reporting nearby counts
a quarter, one near a form of address a quarter more.  A document's evidence
(sum, largest hit, share of its words) gives the score by logistic
regression.  Lexicon and regression learn from at most ``SAMPLE`` documents
per class, chosen by a hash of their id.

NULL and empty texts have no evidence and get the score of a text without
any.  A NULL doc_id is never learned from; without labels of both classes
the score is the share of label 1.  Repeated rows (of an id the text with the smallest
hash is learned) and repeated labels are harmless: a document's label is the largest it has.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from mercato.llm.common import append_columns, crc_mod, materialise, read_table
from mercato.llm.quality import label_sample

SAMPLE = 4000
THRESHOLD = 0.7
#: Least log odds of an entry, entries kept, and lengths of stems.
LEAST_ODDS = math.log(4)
MAX_ENTRIES = 4000
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Letters from which one edit, and two edits, are allowed; weight of such a hit.
ONE_EDIT, TWO_EDITS, MISSPELLED = 5, 9, 0.8
#: Words on each side of a hit that are its context.
CONTEXT = 8
QUOTED, ADDRESSED = 0.25, 1.25
MEMO_WORDS = 400_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
QUOTES = "\"“”„«»"
# Words of reporting and of address.
REPORTING = {"said", "says", "wrote", "quoted", "quote", "called", "term", "word", "dit", "mot", "sagte", "wort",
             "schrieb", "dijo", "palabra"}
ADDRESS = {"you", "your", "du", "dich", "ihr", "tu", "toi", "vous", "usted"}


class Levenshtein:
    """Automaton of all strings within ``edits`` of ``word``; a state is a
    tuple of (place in the word, edits so far)."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self):
        return tuple((i, i) for i in range(min(self.edits, len(self.word)) + 1))

    def step(self, state, letter: str):
        best: dict[int, int] = {}
        n, word, most = len(self.word), self.word, self.edits
        for i, e in state:
            if i < n:  # the letter matches or replaces the next one
                cost = e + (word[i] != letter)
                if cost <= most and best.get(i + 1, most + 1) > cost:
                    best[i + 1] = cost
            if e < most and best.get(i, most + 1) > e + 1:  # the letter is extra
                best[i] = e + 1
        for i in sorted(best):  # letters of the word may be left out
            e, j = best[i], i
            while e < most and j < n:
                e, j = e + 1, j + 1
                if best.get(j, most + 1) > e:
                    best[j] = e
                else:
                    break
        return tuple(sorted(best.items()))

    def accepts(self, state) -> int | None:
        """Edits of the best accepting place, None if there is none."""
        n = len(self.word)
        found = [e for i, e in state if i == n]
        return min(found) if found else None

    def begins(self, state) -> int | None:
        """Edits of the word's best beginning."""
        return min((e for _, e in state), default=None)


@dataclass
class Lexicon:
    """Weights of whole words and of stems, and words that are known to be clean."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset = frozenset()


class Matcher:
    """The lexicon's trie; remembers the weight of words it has seen."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.root: dict = {}
        for kind, entries in (("word", lexicon.words), ("stem", lexicon.stems)):
            for entry, weight in entries.items():
                node = self.root
                for letter in entry:
                    node = node.setdefault(letter, {})
                node[kind] = weight
        # a misspelt entry keeps its first or second half, with two edits its beginning, middle or end; its
        # length and its set of letters change by as much at most.  A part is looked up at its place, or at the
        # end; places move by the edits.
        self.near: dict[str, dict] = {"word": {}, "stem": {}}
        for kind, entries in (("word", lexicon.words), ("stem", lexicon.stems)):
            for w in sorted(entries):
                if len(w) < ONE_EDIT:
                    continue
                edits = 2 if len(w) >= TWO_EDITS else 1
                k = len(w) // (edits + 1)
                sketch = (len(w), edits, frozenset(w), len(set(w)) - edits)
                last = len(w) - k
                places = {0: [0], last: range(last - edits, last + edits + 1) if kind == "stem" else [-k]}
                if edits == 2:
                    places[k] = range(k - edits, k + edits + 1)
                for at, moved in places.items():
                    for i in moved:
                        self.near[kind].setdefault((i, k), {}).setdefault(w[at:at + k], []).append(sketch)
        self.memo: dict[str, float] = {}

    def _near(self, word: str, kind: str) -> bool:
        """Whether a word may be a misspelt entry, or begin with a misspelt stem: a necessary condition."""
        n, letters = len(word), {}
        for (i, k), table in self.near[kind].items():
            for size, edits, own, least in table.get(word[i:i + k] if i >= 0 else word[i:], ()):
                if size - edits <= n and (kind == "stem" or n <= size + edits):
                    end = size + edits
                    if end not in letters:
                        letters[end] = set(word[:end])
                    if len(letters[end] & own) >= least:
                        return True
        return False

    def weight(self, word: str) -> float:
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            known = self.memo[word] = self._exact(word) or self._misspelt(word)
        return known

    def _exact(self, word: str) -> float:
        node, best = self.root, 0.0
        for letter in word:
            node = node.get(letter)
            if node is None:
                return best
            best = max(best, node.get("stem", 0.0))
        return max(best, node.get("word", 0.0))

    def _misspelt(self, word: str) -> float:
        best = 0.0
        if word in self.lexicon.clean:
            return best
        for kind, entries in (("word", self.lexicon.words), ("stem", self.lexicon.stems)):
            if self._near(word, kind):
                automaton = Levenshtein(word, 2 if len(word) >= TWO_EDITS - 2 else 1)
                for entry, edits in within(self.root, automaton, kind):
                    if edits and (edits == 1 and len(entry) >= ONE_EDIT or edits == 2 and len(entry) >= TWO_EDITS):
                        best = max(best, MISSPELLED * entries[entry])
        return best

    def evidence(self, text: str) -> tuple[float, float, float, int]:
        """(sum, largest hit, sum per hundred words, hits) of a text."""
        low = text.lower()
        words = WORD.findall(low)
        weights = {w: self.memo.get(w) for w in set(words)}
        known = {w: x for w, x in weights.items() if x}
        for w, x in weights.items():
            if x is None and (x := self.weight(w)):
                known[w] = x
        if not known:
            return 0.0, 0.0, 0.0, 0
        total = largest = 0.0
        hits = 0
        places = list(WORD.finditer(low))
        for i, w in enumerate(words):
            if w in known:
                a, b = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
                near = set(words[a:b])
                before, after = low[places[a].start():places[i].start()], low[places[i].end():places[b - 1].end() + 1]
                x = known[w]
                if near & REPORTING and any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
                    x *= QUOTED
                elif near & ADDRESS:
                    x *= ADDRESSED
                total += x
                largest = max(largest, x)
                hits += 1
        return total, largest, 100 * total / len(words), hits


def within(root: dict, automaton: Levenshtein, kind: str = "word"):
    """(entry, edits) of every whole-word entry of a trie that the automaton
    accepts, or of every stem that one of its beginnings is near to."""
    accepts = automaton.accepts if kind == "word" else automaton.begins
    stack = [(root, "", automaton.start())]
    while stack:
        node, path, state = stack.pop()
        for letter, child in node.items():
            if len(letter) > 1:
                continue
            after = automaton.step(state, letter)
            if after:
                if kind in child:
                    edits = accepts(after)
                    if edits is not None:
                        yield path + letter, edits
                stack.append((child, path + letter, after))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        z = (_shaped(x) - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _shaped(x: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(x[:, 0]), np.minimum(x[:, 1], 8), np.log1p(x[:, 2])], axis=1) if len(x) else np.zeros((0, 3))


def _likelihood(pos, neg, n_pos: float, n_neg: float):
    """One-sided log likelihood ratio of pos against the classes' sizes, in SQL."""
    both = pos + neg
    expected = both * (n_pos / (n_pos + n_neg))
    rest = F.when(neg > 0, neg * F.log(neg / (both - expected))).otherwise(0.0)
    return pos * F.log(pos / expected) + rest


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Entries from labelled texts (doc_id, label, text): a bounded sample."""
    ws = F.array_remove(F.split(F.lower("text"), NOT_WORD), "")
    places = F.when(F.size("ws") >= 3, F.sequence(F.lit(0), F.size("ws") - 3)).otherwise(F.array().cast("array<int>"))
    least = F.array_min(F.transform(places, lambda i: F.xxhash64(*[F.get(F.col("ws"), i + k) for k in range(3)])))
    # copies and near copies are one witness: texts are counted by their smallest shingle hash
    seen = texts.select("label", "text", ws.alias("ws")).select(
        "label", "ws", F.coalesce(least, F.xxhash64("text")).alias("witness"))
    n = {r.label: r.n for r in seen.groupBy("label").agg(F.count_distinct("witness").alias("n")).collect()}
    n_pos, n_neg = float(n.get(1, 0)), float(n.get(0, 0))
    if not n_pos or not n_neg:
        return Lexicon()
    words = seen.select("label", "witness", F.explode(F.array_distinct("ws")).alias("w")).distinct()
    counts = materialise(words.groupBy("w").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")))

    def entries(table: DataFrame) -> DataFrame:
        odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
        size = table.count()
        return (table.where("pos >= 3").withColumn("odds", odds)
                .withColumn("ratio", _likelihood(F.col("pos"), F.col("neg"), n_pos, n_neg))
                .where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= math.log(size + 1) + 4))
                .orderBy(F.desc("ratio"), "w").limit(MAX_ENTRIES))

    starts = (counts.select("pos", "neg", "w", F.explode(F.array(*map(F.lit, STEM_LENGTHS))).alias("k"))
              .where("char_length(w) >= k").groupBy(F.expr("substring(w, 1, k)").alias("w"))
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("forms"))
              .where("forms >= 3"))
    found = {r.w: float(r.odds) for r in entries(counts).collect()}
    stems = {r.w: float(r.odds) for r in entries(materialise(starts)).collect()}
    lexicon = Lexicon(found, stems)
    # words of clean texts that look like a misspelling are not one
    def near(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            ws = [w for w in batch.column(0).to_pylist() if matcher._misspelt(w)]
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string())], ["w"])

    clean = counts.where("neg > 0").select("w").mapInArrow(near, "w string").collect()
    lexicon.clean = frozenset(r.w for r in clean if r.w not in found)
    return lexicon


def _evidence_column(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    def factory():
        matcher = Matcher(lexicon)
        kind = pa.list_(pa.float64())
        return lambda texts: [pa.array([list(map(float, matcher.evidence(t or ""))) for t in texts.to_pylist()], kind)]

    return append_columns(df, "text", [StructField("x", ArrayType(DoubleType()))], factory)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from rows whose id checksum mod 3 is not 1."""
    chosen, share = label_sample(labels, crc_mod(F.col("doc_id"), 3) != 1, "toxic", per_class=SAMPLE)
    # two classes of at most SAMPLE ids each: small enough for every task
    texts = docs.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    # an id that many rows repeat is one document, the one whose text has the smallest hash
    least = F.min(F.struct(F.xxhash64("text").alias("digest"), F.col("label"), F.col("text")))
    texts = materialise(texts.groupBy("doc_id").agg(least.alias("least")).select("doc_id", "least.label", "least.text"))
    lexicon = learn_lexicon(texts)
    rows = sorted((r.doc_id, r.label, r.x) for r in _evidence_column(texts, lexicon).drop("text").collect())
    y = np.array([r[1] for r in rows], np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(lexicon, None, None, None, share)
    x = _shaped(np.array([r[2] for r in rows]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    # classes weigh as in all learning rows
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(a.shape[1])
    for _ in range(40):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (weight * (y - p)) - 0.05 * np.r_[0, w[1:]]
        hessian = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Model(lexicon, w, mean, scale, share)


def scored(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score, predicted and n_hits of each whole text."""

    def factory():
        matcher = Matcher(model.lexicon)

        def made(texts):
            x = np.array([matcher.evidence(t or "") for t in texts.to_pylist()], np.float64).reshape(-1, 4)
            p = model.score(x)
            return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)),
                    pa.array(x[:, 3].astype(np.int32))]

        return made

    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()),
              StructField("n_hits", IntegerType())]
    return append_columns(df, text_col, fields, factory)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, read_table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted", "n_hits")
