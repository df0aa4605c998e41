"""SimHash fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

from mercato.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab É\n\t.x") for _ in range(rng.randint(0, 80)))
        assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_every_link_of_random_fingerprints_is_kept(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    rows = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            rows.add(x - (1 << 64) if x >= 1 << 63 else x)
    signed = sorted(rows)
    df = spark.createDataFrame([(k, f) for k, f in enumerate(signed)], "doc_id long, fp long")
    unsigned = [f % (1 << 64) for f in signed]
    roots = brute_components(unsigned)
    least = {}
    for k, f in enumerate(unsigned):
        least[roots[f]] = min(k, least.get(roots[f], k))
    for tile in (S.TILE, 3):  # small tiles cut every bucket into pairs of tiles
        S_links = S.links(df.select("fp"), tile=tile)
        assert all(bin((a ^ b) % (1 << 64)).count("1") <= 3 for a, b in S_links.collect())
        old, S.TILE = S.TILE, tile
        try:
            got = {r.fp % (1 << 64): r.component_id for r in S.labelled(df).collect()}
        finally:
            S.TILE = old
        assert got == {f: least[roots[f]] for f in unsigned}


def test_query_against_brute_force(spark, sf_llm):
    docs = spark.read.parquet(f"{sf_llm}/documents.parquet").select("doc_id", "text").collect()
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    roots = brute_components(sorted(set(prints.values())))
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    got = S.op7(spark, sf_llm).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, format(f, "016x"), least[roots[f]]) for i, f in prints.items()}
    assert len(got) == len(docs)


def test_chain_of_links_is_one_component(spark):
    chain = [(1 << k) - 1 for k in range(0, 60, 3)]
    edges = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:])], "a long, b long")
    assert {r.root for r in S.components(edges).collect()} == {0}
    assert S.components(edges.limit(0)).count() == 0


def test_one_per_group_with_nulls_and_repeats(spark):
    rows = [(5, "one two three four", "b"), (2, "one two three four", "a"), (2, "one two three four", "a"),
            (None, "one two three four", "n"), (None, "other words stand here", "n"), (None, "other words stand here", "n"),
            (9, None, "e"), (8, "", "e"), (7, "quite some different text", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = S.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [
        (-1, "other words stand here"), (2, "one two three four"), (7, "quite some different text"), (8, "")]
    assert S.one_per_group(df.limit(0)).count() == 0


def test_of_rows_with_one_id_the_same_stays_however_they_are_dealt(spark):
    texts = ["one two three four five six", "one two three four five six", "One two three four five six"]
    rows = [(4, t, lang) for t in texts for lang in ("x", "y")] + [(9, texts[0], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {tuple(S.one_per_group(df.repartition(n).orderBy(F.rand(n))).collect()) for n in (1, 3, 7)}
    assert len(kept) == 1 and [r.doc_id for r in next(iter(kept))] == [4]
