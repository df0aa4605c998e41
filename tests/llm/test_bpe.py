"""Byte-level BPE against the tiktoken library and exact round trips."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercato.llm import bpe
from mercato.llm.bpe import Bpe, rank_bytes, vocabulary

PATH, PATTERN = vocabulary()


@pytest.fixture(scope="module")
def both():
    raw = rank_bytes(PATH)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return Bpe(raw, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text_equals_tiktoken_and_round_trips(both, text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    mine, theirs = both
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert mine.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="abcth eing\n\t.,'s  é<|", max_size=120))
def test_spaces_and_common_letters(both, text):
    mine, theirs = both
    assert mine.encode(text) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "a \n b", "x" * 20_000, "é" * 5_000, " " * 9_999, "<|endoftext|>",
                                  "it's  we'll\r\n\r\n", "ab" * 10_000])
def test_edges(both, text):
    mine, theirs = both
    assert mine.encode(text) == theirs.encode_ordinary(text)


def test_query_equals_library_on_all_rows(spark, both, sf_llm):
    _, theirs = both
    got = {r.doc_id: r for r in bpe.op1(spark, sf_llm).collect()}
    docs = spark.read.parquet(f"{sf_llm}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = theirs.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id long, text string, ids int")
    ids = bpe.encode(df, PATH, PATTERN)
    rows = bpe.decode(ids, PATH, PATTERN).collect()
    assert ids.columns == ["doc_id", "text", "ids"]
    assert sorted(bytes(r.decoded) for r in rows) == [b"", b"", b"a b"]
    assert bpe.digest_table(df.where(F.lit(False))).count() == 0


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="ab z 9'.,s\n  　\x85\x1c\x7f×÷éßдΩŋ中🙂", max_size=40)),
                      max_size=6))
def test_batches_with_unusual_spaces_and_scripts(both, texts):
    mine, theirs = both
    got = bpe.texts_ids(mine, pa.array(texts, pa.string()))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [theirs.encode_ordinary(t or "") for t in texts]


def test_unknown_ids_raise(both):
    with pytest.raises(ValueError):
        both[0].decode([len(both[0].words)])
