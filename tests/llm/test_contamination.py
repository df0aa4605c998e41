"""Suffix-array decontamination against brute force and its SQL."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from mercato.llm import contamination as C
from mercato.llm.contamination import TestBlock, find_matches, words_of


def brute(text, items, window=10):
    words = C.words_of((text or "").encode())
    hit, found = set(), set()
    for item_id, item in items:
        other = C.words_of((item or "").encode())
        n = min(len(other), window)
        if n:
            for j in range(len(other) - n + 1):
                for i in range(len(words) - n + 1):
                    if words[i:i + n] == other[j:j + n]:
                        hit.update(range(i, i + n))
                        found.add(item_id)
    return len(words), len(hit), found


def longest(text, item, window=10):
    a, b = C.words_of(text.encode()), C.words_of(item.encode())
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best if best >= min(window, len(b)) else 0


def random_case(rng):
    letters = ["a", "b", "é", "x1"][: rng.randint(1, 4)]
    items = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))) for k in range(rng.randint(1, 6))]
    texts = [None, "", "!!! --"]
    for _ in range(8):
        words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            item = rng.choice(items)[1].split()
            at = rng.randint(0, len(words))
            words[at:at] = item[rng.randint(0, len(item)):]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words).replace("a", rng.choice("aA")))
    return items, texts


def test_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        items, texts = random_case(rng)
        block = C.TestBlock(items, 10)
        counts, found = C.find_matches(block, pa.array(texts, pa.string()))
        for text, n, matches in zip(texts, counts, found):
            spans = [(d, d + k) for _, d, _, k in matches]
            hit = {w for a, b in spans for w in range(a, b)}
            assert (n, len(hit), {block.ids[i] for i, *_ in matches}) == brute(text, items)


def test_longest_match_is_maximal():
    rng = random.Random(9)
    for _ in range(60):
        items, texts = random_case(rng)
        for item_id, item in items:
            block = C.TestBlock([(item_id, item)], 10)
            _, found = C.find_matches(block, pa.array(texts, pa.string()))
            for text, matches in zip(texts, found):
                assert max((k for *_, k in matches), default=0) == longest(text or "", item)


def test_blocks_agree_and_edges(spark):
    docs = spark.createDataFrame(
        [(1, "one two three", "x"), (1, "one two three", "x"), (None, None, None), (3, "", "y"), (4, "ONE, two!", "z")],
        "doc_id long, text string, matches string")
    items = spark.createDataFrame([(7, "two three", 1), (8, None, 2), (9, "ONE two", 3), (None, "three", 4), (9, "ONE two", 3)],
                                  "item_id long, text string, n_hit int")
    one = C.report(docs, items)
    many = C.report(docs, items, block_bytes=4)
    key = lambda r: (r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest_match)
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
    by = {(r.doc_id, r.n_hit, r.n_items) for r in one.collect()}
    assert by == {(1, 3, 2), (None, 0, 0), (3, 0, 0), (4, 2, 1)}
    kept = C.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, 3}
    assert C.report(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in C.report(docs, items.limit(0)).collect()} == {0}


def plain_matches(items, texts, window):
    """All longest diagonal matches by comparing every pair of places."""
    out = []
    for t in texts:
        w, found = words_of((t or "").encode()), set()
        for item, x in items:
            v = words_of((x or "").encode())
            n = min(window, len(v))
            hits = {(a, b) for a in range(len(w) - n + 1) for b in range(len(v) - n + 1) if n and w[a:a + n] == v[b:b + n]}
            for a, b in hits:
                if (a - 1, b - 1) not in hits:
                    k = 0
                    while (a + k, b + k) in hits:
                        k += 1
                    found.add((item, a, b, k + n - 1))
        out.append(found)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_longest_matches_of_repeated_words_equal_brute_force(seed):
    rnd = random.Random(seed)
    letters, window = rnd.choice(["a", "ab", "abc"]), rnd.choice([2, 3, 10])
    text = lambda most: " ".join(rnd.choice(letters) * rnd.choice([1, 1, 2]) for _ in range(rnd.randint(0, most)))
    items = [(str(k), rnd.choice([None, text(14), text(30)])) for k in range(rnd.randint(0, 4))]
    texts = [rnd.choice([None, text(40), text(40) + " zz " + text(10)]) for _ in range(4)]
    block = TestBlock(items, window)
    _, found = find_matches(block, pa.array(texts, pa.string()))
    got = [[(block.ids[k], w, p, n) for k, w, p, n in row] for row in found]
    assert [set(g) for g in got] == plain_matches(items, texts, window)
    assert all(len(g) == len(set(g)) for g in got)


def test_a_long_text_of_one_word_is_linear_in_time_and_memory():
    block = TestBlock([("x", "same " * 2_000)], 10)
    tracemalloc.start()
    try:
        _, found = find_matches(block, pa.array(["same " * 200_000]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found[0]) == 200_000 + 2_000 - 19 and max(m[3] for m in found[0]) == 2_000
    assert peak < 300 << 20
