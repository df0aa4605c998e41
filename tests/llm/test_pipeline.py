"""The pipeline, stage by stage, against brute force on each stage's input."""

import corpus_pipeline
from mercato.llm import contamination
from mercato.llm.common import materialise, read_table
from tests.llm.test_bpe import PATH, PATTERN
from tests.llm.test_contamination import brute
from tests.llm.test_simhash import brute_components, plain_fingerprint


def test_stages(spark, sf_llm):
    assert len(corpus_pipeline.STAGES) == 5
    docs = read_table(spark, sf_llm, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf_llm))
        seen[name] = (before.collect(), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            kept = {r.doc_id: r for r in seen[name][1]}
            given = {r.doc_id: r for r in seen[name][0]}
            assert all(given[k] == r for k, r in kept.items()) and len(kept) == len(seen[name][1])
    before, after = seen["simhash_near_dedup"]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in before}
    roots = brute_components(sorted(set(prints.values())))
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {r.doc_id for r in after} == set(least.values())
    before, after = seen["benchmark_decontamination"]
    items = [(str(r.item_id), r.text) for r in read_table(spark, sf_llm, "benchmark").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not brute(r.text, items)[1]}
    assert len(after) < len(before)
    assert PATH and PATTERN and contamination.WINDOW == 10
    rows = {tuple(r) for r in corpus_pipeline.run(spark, sf_llm).collect()}
    assert rows == {tuple(r) for r in seen["byte_bpe"][1]}


def test_empty_and_odd_rows(spark, sf_llm):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 0, "k"), (None, "the cat and the dog are here", "en", None, 1, "k"), (2, "", None, "s", 0, "k"),
         (3, "the cat and the dog are here", "en", "s", 1, "k"), (3, "the cat and the dog are here", "en", "s", 1, "k")],
        "doc_id long, text string, lang string, source string, n_chars int, score string")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_llm)
            assert out.columns == docs.columns
            assert out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf_llm).count() == table.count()
