"""Periodic runs against a plain search over all periods."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mercato.llm import periodic
from mercato.llm.periodic import Grammar, find_runs, split_words

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_runs(words, least):
    """(start, length, period) of every run, by comparing word by word."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def of_batch(texts, least):
    numbers = np.array([w for t in texts for w in t], np.int64)
    owner, *runs = find_runs(numbers, np.append(0, np.cumsum([len(t) for t in texts])), least)
    rows = list(zip(*(c.tolist() for c in runs)))
    return [[r for o, r in zip(owner.tolist(), rows) if o == k] for k in range(len(texts))]


@st.composite
def periodic_text(draw):
    words = draw(st.lists(st.integers(0, 2), max_size=70))
    if len(words) > 5 and draw(st.booleans()):
        a, p = draw(st.integers(0, len(words) // 3)), draw(st.integers(1, len(words) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    return words


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(periodic_text(), min_size=1, max_size=5), least=st.sampled_from([3, 8, 24]))
def test_runs_equal_brute_force(texts, least):
    assert of_batch(texts, least) == [plain_runs(t, least) for t in texts]


@settings(max_examples=150, deadline=None)
@given(words=st.lists(st.integers(0, 1), min_size=1, max_size=60))
def test_extensions_in_both_directions(words):
    closed = np.array([7, *words, 8])
    grammar = Grammar(closed)
    back = grammar.mirror()
    n = len(closed)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    a, b = a[a < b], b[a < b]
    for g, seq in ((grammar, closed), (back, closed[::-1])):
        got = g.extension(a, b)
        for x, y, k in zip(a.tolist(), b.tolist(), got.tolist()):
            e = 0
            while y + e < n and seq[x + e] == seq[y + e]:
                e += 1
            assert k == e


def test_long_text_of_one_word_and_of_a_long_period():
    assert of_batch([[5] * 200_000], 24) == [[(0, 200_000, 1)]]
    rng = np.random.default_rng(3)
    block = rng.integers(0, 1000, 20_000).tolist()
    assert of_batch([block * 4], 24) == [[(0, 80_000, 20_000)]]


def test_words_of_texts_that_touch():
    words, bounds = split_words(pa.array(["ab c", None, "", "d\x0b e", " ", "f g"]))
    assert words.to_pylist() == ["ab", "c", "d", "e", "f g"]
    assert bounds.tolist() == [0, 2, 2, 2, 4, 4, 5]


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 24)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def digests(df):
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return [(r.doc_id, tuple(r[n] for n in names)) for r in df.collect()]


def test_query_equals_plain_version_on_short_texts(spark, sf_llm):
    docs = spark.read.parquet(f"{sf_llm}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = digests(periodic.op11(spark, sf_llm))
    assert len(got) == len(texts)
    short = [(i, row) for i, row in got if len((texts[i] or "").split()) <= 900]
    assert len(short) > 100 and sum(row[0] > 0 for _, row in short) >= 8
    for i, row in short:
        assert row == plain_row(i, texts[i])


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, None, 3), (1, "", 3), (None, "a b " * 40, 3), (2, "  x\n" * 30, 3), (2, "  x\n" * 30, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = periodic.detect(df).collect()
    assert sorted(r.n_words for r in found) == [0, 0, 30, 30, 80]
    assert sorted((tuple(x) for r in found for x in r.runs)) == [(0, 30, 1), (0, 30, 1), (0, 80, 2)]
    assert sorted(r.collapsed for r in found) == ["", "", "a b", "x", "x"]
    got = digests(periodic.run_digests(periodic.planted(df)))
    key = lambda r: (r[0] is None, str(r))
    assert sorted(got, key=key) == sorted(((i, plain_row(i, t)) for i, t, _ in rows), key=key)
    assert periodic.run_digests(periodic.planted(df.limit(0))).count() == 0


@pytest.mark.parametrize("least", [24])
def test_edges_between_texts_hold_no_run(least):
    assert of_batch([[1] * 20, [1] * 20], least) == [[], []]
