"""Licence scans against a plain search, and the expression parser."""

import re
import time

import pytest

from mercato.llm import licenses as L


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_on_all_rows(spark, sf_llm):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_llm}/documents.parquet").collect()}
    for r in L.op8(spark, sf_llm).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize("text", ["CC-BY cc by, cc BY-NC 4.0", "GNU General\nPublic LICENSE! mit license mit license",
                                  "xmit license", "éapache license", "apache licenses", "", "cc by cc by"])
def test_base_edges(text):
    r = L.Scanner().scan(text)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(text)


@pytest.mark.parametrize("expression, families, level", [
    ("MIT", {"mit"}, 1),
    ("MIT OR Apache-2.0", {"mit", "apache"}, 1),
    ("MIT AND GPL-2.0-only", {"mit", "gpl"}, 3),
    ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, 2),
    ("MIT OR GPL-3.0-or-later AND CC-BY-NC-4.0", {"mit", "gpl", "cc-by-nc"}, 1),
    ("(MIT OR GPL-3.0-or-later) AND CC-BY-NC-4.0", {"mit", "gpl", "cc-by-nc"}, 4),
    ("LicenseRef-own or mpl-2.0", {"mpl", "unknown"}, 2),
    ("lgpl-2.1+ */", {"lgpl"}, 2),
])
def test_expressions(expression, families, level):
    assert L.read_tag(expression) == (families, level, True)


@pytest.mark.parametrize("expression", ["", "OR MIT", "(MIT", "MIT)", "MIT AND", "()", "MIT (GPL-2.0)"])
def test_broken_expressions(expression):
    assert L.read_tag(expression)[2] is False


def test_postfix_order():
    assert L.to_postfix("a OR b AND c WITH d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert L.to_postfix(L.tokens_of("(a OR b)AND c")) == ["a", "b", "or", "c", "and"]


def test_tags_add_labels_and_keep_base():
    r = L.Scanner().scan("// SPDX-License-Identifier: (BSD-3-Clause OR MPL-2.0)\nMIT License")
    assert (r["base_labels"], r["labels"], r["tag_strictness"]) == ("mit", "bsd,mit,mpl", "permissive")
    assert r["score"] > 0.95


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "MIT License", "b"), (1, "MIT License", "b")], "doc_id long, text string, score string")
    rows = L.scan(df).collect()
    assert sorted((r.labels, r.first_word is None) for r in rows) == [("", True), ("mit", False), ("mit", False)]
    assert L.scan(df.limit(0)).count() == 0


def test_long_text_of_phrases_and_tags():
    text = "x mit license " * 150_000 + "\n" + "SPDX-License-Identifier: MIT OR Apache-2.0 é\n" * 20_000
    began = time.process_time()
    got = L.Scanner().scan(text)
    assert time.process_time() - began < 60  # seconds; a quadratic scan takes many minutes
    assert (got["n_base"], got["first_word"], got["last_word"]) == (150_000, 1, 449_998)
    tags = [f["first_word"] for f in got["findings"] if f["kind"] == "tag" and f["label"] == "mit"]
    assert tags[:3] == [450_000, 450_009, 450_018] and len(tags) == 20_000


def test_unknown_identifiers():
    assert L.read_tag("MIT AND Proprietary-Foo") == ({"mit", "unknown"}, None, True)
    assert L.read_tag("CDDL-1.0 OR WTFPL") == ({"unknown"}, None, True)
    assert L.read_tag("Artistic-2.0 OR MIT") == ({"mit", "unknown"}, 1, True)
