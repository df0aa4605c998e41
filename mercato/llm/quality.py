"""Quality classifier: random-indexing word vectors and a small network.

Random indexing: every word has a fixed sparse vector of +1 and -1 drawn
from its hash; a word's context vector is the sum of the index vectors of
the words up to ``REACH`` places away, over all texts.  Words share
``BUCKETS`` hashed rows, so the table has a fixed size whatever the corpus;
tasks add up their texts and Spark adds the tasks.  A document is pooled to
the mean of its words' normalised context vectors and, per dimension, the
mean squared step from one word to the next; with its length these feed a
two-layer network in numpy.  Its probabilities are calibrated with a
temperature fitted on a part of the learning rows that the network does not
see, and corrected for the class balance of the sample.

Labels come from at most ``SAMPLE`` documents per class, chosen by a hash of
their id; the context vectors come from all texts.

NULL and empty texts have no words: they get a score from their (zero)
features like any other.  A NULL doc_id is never learned from.  Without
labels, or with one class only, the score is that class's share (0.5 without
any).  Repeated rows (of an id the text with the smallest
hash is learned) and repeated labels are harmless: a document's label is
the largest it has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField

from mercato.llm.common import append_columns, byte_classes, crc_mod, hashed_words, quoted, read_table, row_slices, text_buffer

DIMS = 24
NONZERO = 6
BUCKETS = 1 << 14
REACH = 2
SAMPLE = 3000
HIDDEN = 16
EPOCHS = 60
THRESHOLD = 0.3
#: Bytes of text whose words are held as vectors at once.
PART_BYTES = 1 << 20

#: A word is a run of letters, of digits, or of other signs; a line break is a sign.
TOKENS = byte_classes([
    [(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)],
    [(0x30, 0x39)],
    [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)],
    [(0x0A, 0x0A)],
], lower=False)


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS, nonzero: int = NONZERO) -> np.ndarray:
    """The fixed sparse +1/-1 vectors; the last row, for no word, is zero."""
    rng = np.random.default_rng(20)
    out = np.zeros((buckets + 1, dims), np.int8)
    for k in range(buckets):
        at = rng.choice(dims, nonzero, replace=False)
        out[k, at] = np.where(rng.random(nonzero) < 0.5, -1, 1)
    return out


def _buckets_with_gaps(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word, with REACH empty places after each row."""
    data, offsets = text_buffer(texts)
    hashes, _, _, rows = hashed_words(data, offsets, *TOKENS)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
    n = len(bucket) + REACH * (len(texts) + 1)
    out = np.full(n, BUCKETS, np.int64)
    at = np.arange(len(bucket)) + REACH * (rows + 1)
    out[at] = bucket
    owner = np.full(n, -1, np.int64)
    owner[at] = rows
    return out, owner


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all texts, each of length 1 (or 0)."""
    fields = ", ".join(["bucket int", *[f"c{k} long" for k in range(DIMS)]])
    base = docs.select(quoted(text_col).cast("string").alias("text"))

    def run(batches):
        index = index_vectors()
        total = np.zeros((BUCKETS + 1, DIMS), np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in row_slices(column, PART_BYTES):
                bucket, _ = _buckets_with_gaps(column.slice(a, b - a))
                own = index[bucket]
                context = np.zeros_like(own)
                for k in range(1, REACH + 1):
                    context[k:] += own[:-k]
                    context[:-k] += own[k:]
                order = np.argsort(bucket.astype(np.uint16), kind="stable")
                values, first = np.unique(bucket[order], return_index=True)
                total[values] += np.add.reduceat(context[order], first, axis=0, dtype=np.int32)
        seen = np.flatnonzero(total[:BUCKETS].any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), *[pa.array(total[seen, k]) for k in range(DIMS)]],
            ["bucket", *[f"c{k}" for k in range(DIMS)]])

    # at most BUCKETS rows reach the driver, whatever the corpus
    sums = base.mapInArrow(run, fields).groupBy("bucket").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(DIMS)])
    table = np.zeros((BUCKETS + 1, DIMS), np.float32)
    got = sums.toPandas()
    if len(got):
        table[got["bucket"].to_numpy()] = got[[f"c{k}" for k in range(DIMS)]].to_numpy(np.float32)
    used = table.any(axis=1)
    if used.any():
        table[used] /= np.linalg.norm(table[used], axis=1, keepdims=True)
        table[used] -= table[used].mean(axis=0)
    return table


def features(table: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Pooled features of each text: mean word vector, mean squared step, length."""
    out = np.zeros((len(texts), 2 * DIMS + 2), np.float32)
    for a, b in row_slices(texts, PART_BYTES):
        bucket, owner = _buckets_with_gaps(texts.slice(a, b - a))
        place = np.flatnonzero(owner >= 0)
        if not len(place):
            continue
        rows = owner[place]
        vectors = table[bucket[place]]
        found, first = np.unique(rows, return_index=True)
        counts = np.diff(np.append(first, len(rows)))[:, None]
        out[a + found, :DIMS] = np.add.reduceat(vectors, first, axis=0) / counts
        step = np.zeros_like(vectors)
        np.subtract(vectors[1:], vectors[:-1], out=step[1:])
        step[first] = 0
        step *= step
        out[a + found, DIMS:2 * DIMS] = np.add.reduceat(step, first, axis=0) / counts
        out[a + found, 2 * DIMS] = np.log1p(counts[:, 0])
        out[a + found, 2 * DIMS + 1] = 1
    return out


@dataclass
class Network:
    """Two layers on standardised features, with temperature and prior shift."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float
    shift: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x) / self.temperature + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, share: float, seed: int = 3) -> Network | float:
    """A calibrated network; ``share`` is the share of label 1 among all
    learning rows.  With one class only: that share."""
    if len(y) == 0 or y.min() == y.max():
        return float(share)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[:len(y) // 5]
    seen = order[len(y) // 5:]
    if len(np.unique(y[seen])) < 2 or len(np.unique(y[held])) < 2:
        held = seen = order
    mean, scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-3
    w1 = rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1])
    parts = [w1, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    standard = (x - mean) / scale
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(seen)
        for k in range(0, len(shuffled), 128):
            who = shuffled[k:k + 128]
            a, target = standard[who], y[who]
            hidden = np.tanh(a @ parts[0] + parts[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ parts[2] + parts[3][0], -40, 40)))
            d = (p - target) / len(who)
            dh = np.outer(d, parts[2]) * (1 - hidden * hidden)
            grads = [a.T @ dh + 1e-4 * parts[0], dh.sum(axis=0), hidden.T @ d + 1e-4 * parts[2], np.array([d.sum()])]
            step += 1
            for part, grad, (m, s) in zip(parts, grads, moments):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                part -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, parts[0], parts[1], parts[2], float(parts[3][0]), 1.0, 0.0)
    z, target = net.logits(x[held]), y[held]

    def loss(t: float) -> float:
        q = z / t
        return float(np.mean(np.logaddexp(0, q) - target * q))

    net.temperature = float(min(np.geomspace(0.2, 20, 60), key=loss))
    own = y.mean()
    share = min(max(share, 1e-6), 1 - 1e-6)
    net.shift = float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return net


def label_sample(labels: DataFrame, learn, label_col: str, id_col: str = "doc_id",
                 per_class: int = SAMPLE) -> tuple[DataFrame, float]:
    """At most ``per_class`` ids of each class, by a hash of the id, and the
    share of label 1 among all rows where ``learn`` holds."""
    known = (labels.where(learn & quoted(label_col).isNotNull())
             .groupBy(quoted(id_col).alias("doc_id")).agg(F.max(quoted(label_col)).cast("int").alias("label")))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return known, 0.5
    share = counts.get(1, 0) / sum(counts.values())
    # a share of each class, drawn by the id's hash, that holds about twice the rows wanted
    part = F.element_at(F.create_map(*[F.lit(x) for label, n in sorted(counts.items())
                                       for x in (label, min(1.0, 2.0 * per_class / n))]), F.col("label"))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 40)) < part * F.lit(float(1 << 40)))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id"))
    chosen = known.withColumn("nth", nth).where(F.col("nth") <= per_class).select("doc_id", "label")
    return chosen, float(share)


def learned(docs: DataFrame, labels: DataFrame, table: np.ndarray) -> Network | float:
    """The network, from rows whose id checksum mod 5 is not 0."""
    chosen, share = label_sample(labels, crc_mod(F.col("doc_id"), 5) != 0, "quality")
    # two classes of at most SAMPLE ids each: small enough for every task
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text",
                                                            F.xxhash64("text").alias("digest"))

    def factory():
        return lambda t: [pa.array(list(features(table, t)), pa.list_(pa.float32()))]

    got = append_columns(texts, "text", [StructField("x", ArrayType(FloatType()))], factory)
    # an id that many rows repeat is one document, the one whose text has the smallest hash
    one = got.groupBy("doc_id").agg(F.min(F.struct("digest", "label", "x")).alias("least"))
    rows = sorted(one.select("doc_id", "least.label", "least.x").collect(), key=lambda r: (r.doc_id, r.x))
    if not rows:
        return share
    return fit(np.array([r.x for r in rows]), np.array([r.label for r in rows], np.float64), share)


def scored(df: DataFrame, table: np.ndarray, network: Network | float, text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score and predicted of each whole text."""

    def factory():
        def made(texts):
            if isinstance(network, float):
                p = np.full(len(texts), network)
            else:
                p = network.probability(features(table, texts))
            return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]

        return made

    return append_columns(df, text_col, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], factory)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    table = context_table(docs)
    network = learned(docs, read_table(spark, sf_dir, "labels"), table)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored(docs.withColumn("held_out", held), table, network).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as label 1, with their columns."""
    columns = docs.columns
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    table = context_table(plain)
    network = learned(plain, labels, table)
    tagged = docs.select(F.struct(*[quoted(c) for c in columns]).alias("__llm_row"),
                         F.col("text").cast("string").alias("text"))
    good = scored(tagged, table, network).where("predicted = 1")
    return good.select(*[F.col("__llm_row").getField(c).alias(c) for c in columns])
