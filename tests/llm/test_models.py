"""Learned operators: gradients, exact parts, held-out accuracy, edges."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mercato.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.1"


# ------------------------------------------------------------------ language
def test_backpropagation_equals_numeric_gradient(monkeypatch):
    rng = np.random.default_rng(0)
    layer = langid.Direction(*[rng.standard_normal(s) * 0.5 for s in ((256, 9), (3, 9), (9,))])
    x = rng.integers(0, 256, (5, 4)).astype(np.uint8)
    mask = np.ones((5, 4), np.float32)
    mask[3:, 1] = 0
    target = rng.standard_normal((5, 4, 3)).astype(np.float32)

    def loss():
        return float((langid._states(layer, x, mask, None) * target).sum())

    kept = []
    langid._states(layer, x, mask, kept)
    grads = langid._back(layer, x, mask, kept, target)
    for part, grad in zip((layer.w, layer.u, layer.b), grads):
        for at in [tuple(rng.integers(0, s) for s in part.shape) for _ in range(12)]:
            old = part[at]
            part[at] = old + 1e-2
            up = loss()
            part[at] = old - 1e-2
            down = loss()
            part[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_windows_cover_every_byte_once():
    offsets = np.array([0, 0, 5, 201, 201, 300])
    row, start, length = langid.windows_of(offsets, 96)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(start, length)])
    assert sorted(covered) == list(range(300))
    assert all(offsets[r] <= s and s + n <= offsets[r + 1] for r, s, n in zip(row, start, length))


def test_languages_held_out(spark):
    got = langid.op5(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got.merge(lang, on="doc_id").query("held_out")
    assert len(held) > 2000 and (held.lang_pred == held.lang).mean() > 0.99
    assert got.score.between(0, 1).all() and len(got) == len(lang)


def test_language_edges(spark):
    model = langid.train([b"the cat and the dog " * 20, "le été où ça là ".encode() * 20], ["en", "fr"], steps=60)
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "123 !? ²", 1.0), (4, "the dog", 1.0), (4, "the dog", 1.0),
                                (5, "where the dog and the cat are " * 5000, 1.0)], "doc_id long, text string, score double")
    rows = langid.identify(df, model, spans=True).collect()
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0.0
    assert by[4].lang_pred == by[5].lang_pred == "en"
    assert [s.start for s in by[5].lang_spans][1:] == [s.end for s in by[5].lang_spans][:-1]
    assert by[5].lang_spans[-1].end == len("where the dog and the cat are " * 5000)
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.train([], []) is None
    assert langid.identify(df.limit(0), model).count() == 0
    docs = df.withColumnRenamed("score", "lang").selectExpr("doc_id", "text", "cast(null as string) lang", "1 as lang_pred")
    assert langid.accepted(docs).count() == 0  # nothing to learn from
    assert langid.accepted(docs).columns == docs.columns


# ------------------------------------------------------------------ quality
def test_context_table_is_the_plain_sum(spark):
    texts = ["a b c a", None, "", "b!! 12\nc", "b!! 12\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    index = quality.index_vectors()
    plain = np.zeros((quality.BUCKETS + 1, quality.DIMS))
    for t in texts:
        bucket, owner = quality._buckets_with_gaps(pa.array([t], pa.string()))
        words = bucket[owner >= 0]
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if j != i:
                    plain[w] += index[words[j]]
    used = plain.any(axis=1)
    plain[used] /= np.linalg.norm(plain[used], axis=1, keepdims=True)
    plain[used] -= plain[used].mean(axis=0)
    assert np.allclose(quality.context_table(df), plain, atol=1e-5)
    assert not quality.context_table(df.limit(0)).any()


def test_features_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    table = rng.standard_normal((quality.BUCKETS + 1, quality.DIMS)).astype(np.float32)
    texts = ["a b c", None, "x", "", "long words " * 300, "a b c"]
    together = quality.features(table, pa.array(texts, pa.string()))
    for t, row in zip(texts, together):
        assert np.allclose(quality.features(table, pa.array([t], pa.string()))[0], row, atol=1e-4)


def test_quality_held_out(spark):
    got = quality.op6(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert len(held) > 500 and ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.98
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "k"), (None, None, "k"), (1, "a b", "k")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = quality.context_table(docs)
    assert quality.learned(docs, none, table) == 0.5
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.learned(docs, one, table) == 1.0
    assert quality.accepted(docs, one).count() == 3 and quality.accepted(docs, one).columns == docs.columns


def test_temperature_and_shift():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 4))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(2000) < p).astype(float)
    net = quality.fit(x, y, y.mean())
    assert abs(net.probability(x).mean() - y.mean()) < 0.06
    assert quality.fit(x, np.ones(2000), 0.9) == 0.9


# ------------------------------------------------------------------ toxicity
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def test_automaton_finds_all_near_entries():
    rng = random.Random(5)
    entries = {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 11))): 4.0 for _ in range(40)}
    matcher = toxicity.Matcher(toxicity.Lexicon(entries))
    for _ in range(3000):
        word = list(rng.choice(sorted(entries)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "e"])
        word = "".join(word)
        found = dict(toxicity.within(matcher.root, toxicity.Levenshtein(word, 2)))
        assert found == {e: d for e in entries if (d := distance(word, e)) <= 2}
        near = any(0 < d and (d == 1 and len(e) >= toxicity.ONE_EDIT or d == 2 and len(e) >= toxicity.TWO_EDITS)
                   for e in entries for d in [distance(word, e)])
        assert (matcher._misspelt(word) > 0) == near


def test_misspellings_of_stems_and_of_light_entries():
    rng = random.Random(6)

    def some(least, most):
        return {"".join(rng.choice("abcd") for _ in range(rng.randint(least, most))): rng.uniform(1.4, 5) for _ in range(25)}

    words, stems = some(4, 12), some(4, 10)
    words |= {s + "ab": 1.5 for s in sorted(stems)[:10]}  # words that a stem covers
    matcher = toxicity.Matcher(toxicity.Lexicon(words, stems))
    hits = 0
    for _ in range(400):
        word = list(rng.choice(sorted(words) + [s + "".join(rng.choice("abe") for _ in range(rng.randint(0, 5))) for s in sorted(stems)]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "e"])
        word = "".join(word)
        near = [(e, x, distance(word, e)) for e, x in words.items()]
        near += [(e, x, min(distance(word[:n], e) for n in range(len(word) + 1))) for e, x in stems.items()]
        best = max((x for e, x, d in near if d == 1 and len(e) >= toxicity.ONE_EDIT
                    or d == 2 and len(e) >= toxicity.TWO_EDITS), default=0.0)
        assert matcher._misspelt(word) == toxicity.MISSPELLED * best
        hits += best > 0
    assert 40 < hits < 400
    stem = toxicity.Matcher(toxicity.Lexicon({"scoundrelly": 1.5}, {"scoundr": 4.0}))
    assert {w: stem.weight(w) for w in ("koundrelish", "xcoundrels", "scuondr", "scondrel", "sscoundrel", "soup")} == {
        "koundrelish": 0.0, "xcoundrels": 3.2, "scuondr": 0.0, "scondrel": 3.2, "sscoundrel": 3.2, "soup": 0.0}


def test_context_tells_quotation_from_abuse():
    matcher = toxicity.Matcher(toxicity.Lexicon({"scoundrel": 4.0}))
    plain = matcher.evidence("the scoundrel went home")[0]
    assert matcher.evidence('she said "scoundrel" was the word')[0] == plain * toxicity.QUOTED
    assert matcher.evidence("you scoundrel")[0] == plain * toxicity.ADDRESSED
    assert matcher.evidence("the scoundrl went home")[0] == plain * toxicity.MISSPELLED
    assert matcher.evidence("") == (0.0, 0.0, 0.0, 0)


def test_toxicity_held_out(spark):
    got = toxicity.op9(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    said, true = held.predicted == 1, held.toxic == 1
    assert (said & true).sum() > 0.85 * true.sum() and (said & ~true).sum() < 0.01 * (~true).sum()
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "k"), (None, None, "k")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, none)
    assert {r.score for r in toxicity.scored(docs, model).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model).count() == 0


# ------------------------------------------------------------------ repeated ids
def test_an_id_that_holds_a_third_of_all_rows_is_learned_once(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for model, fits in ((langid, "crc32(cast(doc_id as string)) % 4 <> 2 and lang is not null"),
                        (quality, "crc32(cast(doc_id as string)) % 5 <> 0"),
                        (toxicity, "crc32(cast(doc_id as string)) % 3 <> 1")):
        hot = docs.join(labels.where("quality is not null and toxic is not null"), "doc_id", "left_semi").where(fits)
        hot = hot.where("length(text) > 0").orderBy("doc_id").limit(1)
        many = docs.unionByName(hot.crossJoin(spark.range(100)).drop("id"))
        if model is langid:
            learn = langid.crc_mod(docs.doc_id, 4) != 2
            once, again = langid.sample(docs, learn), langid.sample(many, learn)
            assert len(once) > 20 and once == again
        elif model is quality:
            table = quality.context_table(docs.select("doc_id", "text"))
            texts = pa.array([r.text for r in docs.limit(20).collect()])
            once, again = (quality.learned(d.select("doc_id", "text"), labels, table) for d in (docs, many))
            x = quality.features(table, texts)
            assert np.array_equal(once.probability(x), again.probability(x))
        else:
            once, again = (toxicity.learned(d.select("doc_id", "text"), labels) for d in (docs, many))
            assert once.lexicon == again.lexicon and np.array_equal(once.weights, again.weights)
