"""Hard negatives against exact arithmetic over all pairs."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercato.llm import negatives as N


@settings(max_examples=150, deadline=None)
@given(seed=st.integers(0, 10**6), d=st.integers(0, 20), size=st.sampled_from([1, 2, 300, 10**6, N.LARGEST]))
def test_scores_are_inner_products(seed, d, size):
    rng = np.random.default_rng(seed)
    c, a = rng.integers(-size, size + 1, (7, d)), rng.integers(-size, size + 1, (4, d + int(rng.integers(0, 9))))
    planes = N.pack_planes(c)
    got = N.scores(planes, N.subset_sums(a, planes.shape[1], np.int64))
    expected = [[sum(int(x) * int(y) for x, y in zip(row, anchor)) for anchor in a] for row in c]
    wrapped = [[(v + 2**63) % 2**64 - 2**63 for v in row] for row in expected]
    assert got.tolist() == wrapped


def plain(rows, positives=5, negatives=5):
    """rows: (id, label, whole vector); the query's rows."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for aid, alabel, av in rows:
        if aid % 100:
            continue
        scored = [(-dot(av, v), i, label) for i, label, v in rows if i != aid]
        for s, pid, _ in sorted(x for x in scored if x[2] == alabel)[:positives]:
            inside = sorted((t, i) for t, i, label in scored if label != alabel and -80 * s <= -100 * t <= -100 * s)
            out += [(aid, pid, k, nid, -s, -t) for k, (t, nid) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def taken(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def whole(rows):
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in kept]


def write(spark, tmp_path, rows):
    schema = "vec_id long, embedding array<float>, label int, n int, place string"
    spark.createDataFrame([(i, v, label, 1, "x") for i, label, v in rows], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return N.op12(spark, str(tmp_path))


def test_query_equals_sql_and_brute_force(spark, sf_llm):
    got = taken(N.op12(spark, sf_llm))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_llm}/embeddings.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert got == sorted(con.execute(f"SELECT {names} FROM ({N.ORACLE})").fetchall())
    rows = spark.read.parquet(f"{sf_llm}/embeddings.parquet").collect()
    assert got == plain(whole([(r.vec_id, r.label, r.embedding) for r in rows]))


def test_ties_nulls_and_vectors_of_other_lengths(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.choice([0.0, 0.25, 0.5, -0.25], 6).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, [0.5] * 6) for i in range(300)]  # one common vector
    rows += [(2000, None, [0.5] * 6), (2001, 1, None), (2002, 1, [None, 0.5]), (2003, 1, [float("nan")]),
             (2004, 1, [float("inf"), 1.0]), (2005, 1, []), (2006, 2, [0.5, 0.5]), (2007, 2, [0.5] * 11), (None, 1, [0.5])]
    assert taken(write(spark, tmp_path, rows)) == plain(whole(rows))


def test_few_rows_and_an_empty_table(spark, tmp_path):
    assert taken(write(spark, tmp_path / "a", [(0, 3, [0.5])])) == []
    assert taken(write(spark, tmp_path / "b", [])) == []
    rows = [(100, 1, [0.5, 0.25]), (1, 1, [0.5, 0.25]), (2, 2, [0.5, 0.25])]
    assert taken(write(spark, tmp_path / "c", rows)) == plain(whole(rows)) != []


def test_repeated_rows_each_count(spark):
    rows = [(100, 1, [3, 4]), (1, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [3, 4]), (2, 2, [3, 4])]
    df = spark.createDataFrame(rows, "id long, label long, q array<long>")
    got = taken(N.mine(df, F.col("id") == 100))
    assert got == sorted([(100, 1, k, 2, 25, 25) for k in (1, 2)] * 2)


@pytest.mark.parametrize("blocks", [1, 7])
def test_many_blocks_of_anchors(spark, sf_llm, monkeypatch, blocks):
    monkeypatch.setattr(N, "BLOCK_ANCHORS", blocks)
    rows = N.whole_rows(spark.read.parquet(f"{sf_llm}/embeddings.parquet"), "vec_id", "label", "embedding", 256)
    got = taken(N.mine(rows, F.col("id") % 25 == 0, positives=2, negatives=3))
    monkeypatch.undo()
    assert got == taken(N.mine(rows, F.col("id") % 25 == 0, positives=2, negatives=3)) != []
