"""Packing: every id in one piece, no gaps, little padding; ids as the library's."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mercato.llm import packing
from mercato.llm.merges import MergeEncoder
from mercato.llm.packing import Plan, pack, padding, rounded

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return MergeEncoder(f.read()), Tokenizer.from_file(PATH)


@settings(max_examples=250, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="abe th'\n .9é中 ", max_size=90)), max_size=5))
def test_ids_equal_the_library(both, texts):
    mine, theirs = both
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, at = mine.encode_column(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == theirs.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" * 20_000, "ab" * 9_000, "é" * 4_000, "a<|endoftext|>b <|endoftext|>", "aaaa " * 3_000,
                                  "abcdefghij" * 12 + " " + "Donaudampfschifffahrtsgesellschaft" * 3])
def test_long_pieces_and_added_tokens(both, text):
    mine, theirs = both
    ids, _ = mine.encode_column(pa.array(["q", text, "q"]))
    assert ids.tolist() == [80, *theirs.encode(text, add_special_tokens=False).ids, 80]


def check(rows, ids_of, size):
    """rows: (doc, start, length, crc, doc_tokens, sequence, offset); returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append(r)
    assert by_doc.keys() == ids_of.keys()
    for doc, parts in by_doc.items():
        ids, at = ids_of[doc], 0
        for _, start, length, crc, total, _, _ in sorted(parts, key=lambda r: r[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    lost = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= size
        lost += int(padding(size)[at])
    return lost


def rows_of(df):
    return [tuple(r) for r in df.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]


def test_query_packs_every_id_without_padding(spark, sf_llm, both):
    docs = spark.read.parquet(f"{sf_llm}/documents.parquet").collect()
    ids = {d.doc_id: [*both[1].encode(d.text or "", add_special_tokens=False).ids, 1] for d in docs}
    got = rows_of(packing.op13(spark, sf_llm).withColumnRenamed("doc_id", "id"))
    tokens = sum(map(len, ids.values()))
    assert check(got, ids, 2048) <= tokens // 1000


@pytest.mark.parametrize("broadcast", [True, False])
def test_hot_length_long_text_nulls_and_clashing_columns(spark, both, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(packing, "BROADCAST_KEYS", 0)
    texts = [None, "", "word " * 700, *["one two three four five six"] * 400, *["a b c"] * 5]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, length int")
    ids = {k: [*both[1].encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    assert check(rows_of(pack(df.repartition(5), PATH, size=64)), ids, 64) == 0


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e f g")] * 9 + [(None, "a")], "doc_id long, text string")
    got = rows_of(pack(df, PATH, size=16))
    assert sum(r[2] for r in got if r[0] == 7) == 9 * 8 and sum(r[2] for r in got if r[0] is None) == 2
    assert rows_of(pack(df.limit(0), PATH)) == []


@settings(max_examples=120, deadline=None)
@given(lengths=st.lists(st.integers(1, 31), max_size=200))
def test_plan_places_every_rank_once(lengths):
    own, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
    plan = Plan(own, counts, 32)
    taken = defaultdict(list)
    for length, n in zip(own.tolist(), counts.tolist()):
        sequence, offset = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            parts = [(0, length, s, o)] if s >= 0 else plan.cut(o, length)
            assert sum(p[1] for p in parts) == length
            for _, k, q, f in parts:
                taken[q].append((f, k))
    for parts in taken.values():
        at = 0
        for f, k in sorted(parts):
            assert f == at
            at += k
        assert at <= 32
    assert sorted(taken) == list(range(len(taken)))


def test_program_packs_whole_documents():
    rng = np.random.default_rng(2)
    rest = rng.integers(1, 128, 20_000)
    lengths, demand = np.unique(rest, return_counts=True)
    chosen, left = rounded(lengths, demand, 128)
    used = sum(n * p for p, n in chosen)
    assert (used + left == demand).all()
    assert all(padding(128)[int(p @ lengths)] <= 2 for p, _ in chosen)
    assert (left @ lengths) / (demand @ lengths) < 0.3
