"""Line rules against a plain version, on limits that bite."""

import random
import re
from collections import Counter

from mercato.llm import lines as L
from mercato.llm.registry import ORACLE_SQL, QUERIES
from tools.oracle_check import duck, frame_hash


def plain(rows, max_docs):
    def words_of(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def normal(line):
        return " ".join(words_of(re.sub("[0-9]", "0", line.lower())))

    seen = Counter()
    for _, text, host in rows:
        for line in {normal(x) for x in (text or "").split("\n") if words_of(x)}:
            seen[host, line] += 1
    out = []
    for doc_id, text, host in rows:
        words = words_of(text)
        ls = [x for x in (text or "").split("\n") if words_of(x)]
        windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        covered = {p for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for p in range(i, i + 5)}
        gone = [x for x in ls if seen[host, normal(x)] > max_docs]
        left = len(words) - sum(len(words_of(x)) for x in gone)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
                    len(ls) - len(set(ls)), len(covered), failed,
                    not failed and left >= 10 and left >= 0.3 * len(words), len(gone), left))
    return out


def test_against_plain_version(spark):
    rng = random.Random(2)
    shared = ["read more 12", "Read  MORE 99", "all rights reserved", "\t \x0b", "a b c d e f g h"]
    rows = []
    for k in range(300):
        lines = [rng.choice(shared) if rng.random() < 0.4 else
                 " ".join(rng.choice("a b c dé ## <x> yy".split()) for _ in range(rng.randint(0, 14)))
                 for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([k, k, None]), rng.choice(["\n", "\r\n", "\n\n"]).join(lines), rng.choice(["h1", "h1", "h1", "h2", None])))
    rows += [(1, None, "h1"), (2, "", None), (3, "word " * 9000 + "end", "h2"), (3, "word " * 9000 + "end", "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for max_docs in (3, 20, 90):
        got = [tuple(r) for r in L.judged(df.withColumn("line", df.doc_id).withColumn("row", df.doc_id), max_docs=max_docs).collect()]
        key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
        assert sorted(got, key=key) == sorted(plain(rows, max_docs), key=key)
    assert L.judged(df.limit(0)).count() == 0


def test_a_hot_host_has_the_limit_of_any_other(spark):
    """A line that 100 of a host's 50,000 documents share goes, and one that 20 of them share stays."""
    own = "concat_ws(' ', transform(sequence(1, 12), k -> concat(translate(id, '0123456789', 'abcdefghij'), chr(96 + k))))"
    docs = spark.range(50_000).selectExpr(
        "id as doc_id", "'hot' as source",
        f"concat({own}, case when id < 100 then '\\nsubscribe to our letter' when id < 120 then '\\nprinted on paper' else '' end) as text")
    got = L.judged(docs).where("n_lines_removed > 0")
    assert {(r.doc_id, r.n_lines_removed, r.words_left, r.kept) for r in got.collect()} == {(k, 1, 12, True) for k in range(100)}


def test_query_equals_its_sql(spark, sf_llm):
    con = duck(sf_llm)
    for key in sorted(ORACLE_SQL):
        assert frame_hash(QUERIES[key](spark, sf_llm).toPandas()) == frame_hash(con.execute(ORACLE_SQL[key]).df()), key


def test_no_python_in_the_plan(spark, sf_llm):
    for key in ("op4_line_rules", "op10_extendible_shards"):
        plan = QUERIES[key](spark, sf_llm)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
