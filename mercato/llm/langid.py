"""Language identification with a bidirectional gated recurrent network.

The network reads bytes.  Each direction is one GRU layer; their states
together give language probabilities at every byte of a text, and the mean
over all its bytes is the document's distribution.  Texts are read in
windows of ``WINDOW`` bytes, side by side in one batch; every byte of every
text is in exactly one window, so long texts cost no more per byte.

Training is backpropagation through time with Adam, in numpy, on the driver,
from a bounded sample: at most ``SAMPLE`` documents of each language, chosen
by a hash of their id, and of each one passage of ``PASSAGE`` characters
starting at a hashed place.  Prediction always reads whole texts.

NULL texts and texts without a letter are ``und`` with score 0.  Without any
labelled row every text is ``und``.  Rows with a NULL lang teach nothing;
repeated rows and ties need no care: equal texts get equal results, equal
probabilities go to the first language in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, StringType, StructField, StructType)

from mercato.llm.common import append_columns, crc_mod, quoted, read_table, text_buffer

#: Labelled documents of each language that training sees, and characters of each.
SAMPLE = 300
PASSAGE = 2048
#: Units of each direction, bytes of a window when predicting, windows side by side.
HIDDEN = 8
WINDOW = 96
BATCH = 2048
#: Training: bytes of a window, windows of a step, steps, step size.
TRAIN_WINDOW = 64
TRAIN_BATCH = 192
STEPS = 260
RATE = 0.02
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Direction:
    """One GRU layer: input rows by byte, recurrent matrix and bias; gate order z, r, n."""

    w: np.ndarray
    u: np.ndarray
    b: np.ndarray


@dataclass
class Model:
    langs: list[str]
    forward: Direction
    backward: Direction
    v: np.ndarray
    c: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.forward.w, self.forward.u, self.forward.b, self.backward.w, self.backward.u, self.backward.b,
                self.v, self.c]


def new_model(langs: list[str], hidden: int, rng: np.random.Generator) -> Model:
    def draw(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    def layer():
        return Direction(draw(256, 3 * hidden, scale=0.3), draw(hidden, 3 * hidden, scale=0.3),
                         np.zeros(3 * hidden, np.float32))

    return Model(langs, layer(), layer(), draw(2 * hidden, len(langs), scale=0.3), np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _states(layer: Direction, x: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States after each row of ``x`` (steps x windows).  ``mask`` holds the
    state at zero outside a text.  ``keep`` collects what training needs."""
    steps, width = x.shape
    size = layer.u.shape[0]
    out = np.empty((steps, width, size), np.float32)
    h = np.zeros((width, size), np.float32)
    for t in range(steps):
        gx = layer.w[x[t]]
        gh = h @ layer.u
        gh += layer.b
        zr = _sigmoid(gx[:, :2 * size] + gh[:, :2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(gx[:, 2 * size:] + r * gh[:, 2 * size:])
        new = n + z * (h - n)
        if mask is not None:
            new *= mask[t][:, None]
        if keep is not None:
            keep.append((h, z, r, n, gh[:, 2 * size:]))
        h = out[t] = new
    return out


def _probabilities(model: Model, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Language probabilities at every place: steps x windows x languages."""
    states = np.concatenate([
        _states(model.forward, x, mask, None),
        _states(model.backward, x[::-1], None if mask is None else mask[::-1], None)[::-1]], axis=2)
    logits = states.reshape(-1, states.shape[2]) @ model.v + model.c
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.reshape(*x.shape, -1)


def _back(layer: Direction, x: np.ndarray, mask: np.ndarray, kept: list, dout: np.ndarray) -> list[np.ndarray]:
    """Gradients of one direction: backpropagation through time."""
    size = layer.u.shape[0]
    du, db = np.zeros_like(layer.u), np.zeros_like(layer.b)
    dgx_all = np.empty((*x.shape, 3 * size), np.float32)
    dh = np.zeros((x.shape[1], size), np.float32)
    for t in range(len(kept) - 1, -1, -1):
        before, z, r, n, ghn = kept[t]
        d = (dh + dout[t]) * mask[t][:, None]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (before - n) * z * (1 - z)
        dr = dn * ghn * r * (1 - r)
        dgx_all[t] = np.concatenate([dz, dr, dn], axis=1)
        dgh = np.concatenate([dz, dr, dn * r], axis=1)
        du += before.T @ dgh
        db += dgh.sum(axis=0)
        dh = d * z + dgh @ layer.u.T
    flat, rows = x.reshape(-1), dgx_all.reshape(-1, 3 * size)
    order = np.argsort(flat, kind="stable")
    values, first = np.unique(flat[order], return_index=True)
    dw = np.zeros_like(layer.w)
    dw[values] = np.add.reduceat(rows[order], first, axis=0)
    return [dw, du, db]


def train(texts: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> Model | None:
    """A model of the languages in ``langs``, one entry per text; None without text."""
    names = sorted(set(langs))
    usable = [(np.frombuffer(t, np.uint8), names.index(g)) for t, g in zip(texts, langs) if t]
    if not usable:
        return None
    rng = np.random.default_rng(seed)
    model = new_model(names, hidden, rng)
    by_lang = [[t for t, g in usable if g == k] for k in range(len(names))]
    present = [k for k, group in enumerate(by_lang) if group]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in model.parts()]
    for step in range(1, steps + 1):
        x = np.zeros((TRAIN_WINDOW, TRAIN_BATCH), np.uint8)
        mask = np.zeros(x.shape, np.float32)
        y = np.empty(TRAIN_BATCH, np.int64)
        for j in range(TRAIN_BATCH):
            y[j] = present[j % len(present)]
            group = by_lang[y[j]]
            text = group[rng.integers(len(group))]
            at = rng.integers(max(1, len(text) - TRAIN_WINDOW + 1))
            piece = text[at:at + TRAIN_WINDOW]
            x[:len(piece), j] = piece
            mask[:len(piece), j] = 1
        kept_f: list = []
        kept_b: list = []
        forward = _states(model.forward, x, mask, kept_f)
        backward = _states(model.backward, x[::-1], mask[::-1], kept_b)[::-1]
        states = np.concatenate([forward, backward], axis=2)
        logits = states @ model.v + model.c
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(TRAIN_BATCH), y] -= 1
        p *= (mask / mask.sum())[:, :, None]
        flat = p.reshape(-1, p.shape[2])
        dv = states.reshape(-1, states.shape[2]).T @ flat
        dc = flat.sum(axis=0)
        ds = p @ model.v.T
        size = hidden
        gradients = [*_back(model.forward, x, mask, kept_f, ds[:, :, :size]),
                     *_back(model.backward, x[::-1], mask[::-1], kept_b, ds[::-1, :, size:]), dv, dc]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for part, grad, (m, s) in zip(model.parts(), gradients, moments):
            np.clip(grad, -1, 1, out=grad)
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            part -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def windows_of(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the windows that cover every byte of every row once."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + nth * size
    return row, start, np.minimum(size, offsets[row + 1] - start)


def pooled(model: Model, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Mean language probabilities of each row; ``labels`` receives the most
    likely language of every byte."""
    n = len(offsets) - 1
    total = np.zeros((n, len(model.langs)))
    row, start, length = windows_of(offsets, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    steps = np.arange(WINDOW)
    for k in range(0, len(row), BATCH):
        s, size = start[k:k + BATCH], length[k:k + BATCH]
        whole = bool((size == WINDOW).all())
        x = padded[s[None, :] + steps[:, None]]
        mask = None if whole else (steps[:, None] < size[None, :]).astype(np.float32)
        p = _probabilities(model, x, mask)
        if labels is not None:
            valid = steps[:, None] < size[None, :]
            labels[(s[None, :] + steps[:, None])[valid]] = p.argmax(axis=2)[valid]
        sums = p.sum(axis=0) if whole else (p * mask[:, :, None]).sum(axis=0)
        np.add.at(total, row[k:k + BATCH], sums)
    return total / np.maximum(1, np.diff(offsets))[:, None]


def sample(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           per_lang: int = SAMPLE, passage: int = PASSAGE) -> list[tuple[str, bytes]]:
    """The bounded training sample: (language, passage) of at most ``per_lang``
    documents of each language among the rows where ``learn`` holds."""
    place = F.xxhash64(quoted(id_col), F.lit(11))
    text = quoted(text_col).cast("string")
    known = docs.where(learn & quoted(lang_col).isNotNull())
    # a share of each language's ids, drawn by their hash, that holds about twice the rows wanted: what meets
    # in one task to be ordered does not grow with the corpus
    counts = {r.lang: r.n for r in known.groupBy(quoted(lang_col).cast("string").alias("lang")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items())
                                        for x in (lang, min(1.0, 2.0 * per_lang / n))]), quoted(lang_col).cast("string"))
    drawn = known.where(F.pmod(place, F.lit(1 << 40)) < share * F.lit(float(1 << 40))).where(F.length(text) > 0)
    rows = (drawn
            .select(quoted(lang_col).cast("string").alias("lang"), place.alias("place"),
                    F.substring(text, (F.pmod(place, F.greatest(F.lit(1), F.length(text) - passage)) + 1).cast("int"),
                                F.lit(passage)).alias("text")))
    # an id that many rows repeat is one document, the one whose passage has the smallest hash
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text")))
    rows = rows.groupBy("lang", "place").agg(least.alias("least")).select("lang", "place", "least.text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    chosen = rows.withColumn("nth", nth).where(F.col("nth") <= per_lang).select("lang", "text", "place")
    return [(r.lang, r.text.encode("utf-8")) for r in
            sorted(chosen.collect(), key=lambda r: (r.lang, r.place, r.text))]


SPAN = StructType([StructField("lang", StringType()), StructField("start", IntegerType()),
                   StructField("end", IntegerType())])
SPAN_ARROW = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def identify(df: DataFrame, model: Model | None, text_col: str = "text", spans: bool = False) -> DataFrame:
    """``df`` with lang_pred and score of each whole text and, if asked for,
    the byte ranges [start, end) of equal labels of its places."""
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    if spans:
        fields.append(StructField("lang_spans", ArrayType(SPAN)))

    def factory():
        def made(texts):
            data, offsets = text_buffer(texts)
            lettered = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            n = len(texts)
            labels = np.zeros(len(data), np.int16) if spans else None
            if model is None:
                lettered[:] = False
                best, score = np.zeros(n, np.int64), np.zeros(n)
            else:
                p = pooled(model, data, offsets, labels)
                best, score = p.argmax(axis=1), p.max(axis=1)
            names = model.langs if model is not None else []
            pred = [names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
            out = [pa.array(pred, pa.string()), pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0), pa.float64())]
            if spans:
                out.append(pa.array([_runs(labels[a:b], names) if ok else [] for a, b, ok in
                                     zip(offsets[:-1], offsets[1:], lettered)], SPAN_ARROW))
            return out

        return made

    return append_columns(df, text_col, fields, factory)


def _runs(labels: np.ndarray, names: list[str]) -> list[dict]:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *cuts.tolist(), len(labels)]
    return [{"lang": names[labels[a]], "start": a, "end": b} for a, b in zip(edges, edges[1:])]


def learned(docs: DataFrame) -> Model | None:
    """The model of ``documents``, from rows whose id checksum mod 4 is not 2."""
    rows = sample(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return train([t for _, t in rows], [g for g, _ in rows])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learned(docs.select("doc_id", "text", "lang"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


#: A text stays in the pipeline if its language is this many times likelier than an even guess.
LEAST_LIFT = 1.1


def accepted(docs: DataFrame, least_lift: float = LEAST_LIFT) -> DataFrame:
    """The rows of ``docs`` with a language that stands out; those without a
    letter, or without any language likelier than ``least_lift`` times an
    even guess, go.  Columns as they came."""
    columns = docs.columns
    model = learned(docs)
    least = least_lift / len(model.langs) if model and len(model.langs) > 1 else 0.0
    tagged = docs.select(F.struct(*[quoted(c) for c in columns]).alias("__llm_row"),
                         F.col("text").cast("string").alias("text"))
    good = identify(tagged, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return good.select(*[F.col("__llm_row").getField(c).alias(c) for c in columns])
