"""Quality rules with cross-document line frequency, in DataFrame functions only.

Every line is normalised (lower case, digits to 0, white space to one space,
trimmed) and hashed.  A host is the document's source.  The number of
distinct documents of a host that hold a line is counted with map-side
partial sums; a line that more than ``MAX_DOCS`` documents of a host hold is
removed from them.  The limit is the same for every host, however large, and
a line's verdict does not change with rows that do not hold it.  A document that is left with fewer than ``MIN_WORDS`` words, or with
less than ``MIN_LEFT`` of its words, is depleted and rejected.  A document
also fails by the base rules: too few words, or too many words in repeated
five-word windows.

NULL texts have no words and fail the base rules; a NULL source is a host of
its own.  Rows that repeat a doc_id are separate documents (each gets its
own row number).  Lines without a word do not count.  Only (host, line)
counts above the limit meet the documents again, in a join whose hot keys
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import materialise, quoted, read_table

#: Documents of a host that may hold a line.
MAX_DOCS = 20
#: Least words a document must have, also after removal, and share that must be left.
MIN_WORDS = 10
MIN_LEFT = 0.3
#: Repeated-window rule: words of a window, and percent of the words it may cover.
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20

SPACE = r"[\x20\x09-\x0D]+"


HAS_WORD = r"[^\x20\x09-\x0D]"


def normal_line(line):
    """A line in the form that is counted: lower case, digits as 0, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " "))


def measured(docs: DataFrame, text_col: str = "text", window: int = REPEAT_WINDOW) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words, and in ``line_keys`` the hash and number of words of every
    line that has a word.  Intermediate arrays stay inside one row."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({
        "__words": F.array_remove(F.split(text, SPACE, -1), ""),
        "__lines": F.filter(F.split(text, "\n", -1), lambda s: F.rlike(s, F.lit(HAS_WORD))),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__normal": F.transform("__lines", normal_line),
        "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
    })
    places = F.when(F.size("__hash") >= window, F.sequence(F.lit(0), F.size("__hash") - window)).otherwise(
        F.array().cast("array<int>"))
    out = out.withColumns({
        "line_keys": F.transform("__normal", lambda s: F.struct(
            F.xxhash64(s).alias("line"), (F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1).alias("words"))),
        "__windows": F.transform(places, lambda i: F.xxhash64(*[F.get(F.col("__hash"), i + k) for k in range(window)])),
    }).drop("__words", "__lines", "__normal", "__hash")
    # only a text with two equal windows is sorted, by (window, place)
    out = out.withColumn("__sorted", F.when(
        F.size("__windows") > F.size(F.array_distinct("__windows")),
        F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("__equal", F.zip_with(
        "__sorted", F.slice("__sorted", F.lit(2), F.size("__sorted")),
        lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))).drop("__windows")
    # places of windows that equal a neighbour in that order, back in text order
    twice = F.sort_array(F.transform(
        F.filter(F.zip_with("__sorted", F.zip_with(
            "__equal", F.concat(F.array(F.lit(False)), "__equal"), lambda a, b: F.coalesce(a, F.lit(False)) | b),
            lambda x, e: F.struct(x["i"].alias("i"), e.alias("e"))), lambda x: x["e"] & x["i"].isNotNull()),
        lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    covered = F.aggregate(twice, start, lambda acc, i: F.struct(
        (i + window).alias("to"), (acc["n"] + i + window - F.greatest(acc["to"], i)).alias("n")), lambda acc: acc["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__sorted", "__equal")


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line) of every line that more than ``max_docs`` documents of its
    host hold; ``rows`` has host and line_keys, one row per document."""
    lines = rows.select("host", F.explode(F.array_distinct(F.transform("line_keys", lambda k: k["line"]))).alias("line"))
    return lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("host", "line")


def judged(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
           max_docs: int = MAX_DOCS) -> DataFrame:
    """(id, base figures, base_failed, n_lines_removed, words_left, kept) of every row of ``docs``."""
    base = docs.select(quoted(id_col).alias("doc_id"),
                       F.coalesce(F.concat(F.lit("="), quoted(host_col).cast("string")), F.lit("")).alias("host"),
                       quoted(text_col).cast("string").alias("text"))
    rows = materialise(measured(base).drop("text").withColumn("row", F.monotonically_increasing_id()))
    frequent = materialise(frequent_lines(rows, max_docs))
    lines = rows.select("row", "host", F.explode("line_keys").alias("k")).select("row", "host", "k.line", "k.words")
    removed = lines.join(frequent, ["host", "line"]).groupBy("row").agg(
        F.count(F.lit(1)).alias("n_lines_removed"), F.sum("words").alias("words_removed"))
    none = F.lit(0).cast("long")
    out = rows.drop("line_keys", "host").join(removed, "row", "left").withColumns({
        "n_lines_removed": F.coalesce("n_lines_removed", none),
        "words_left": F.col("n_words") - F.coalesce("words_removed", none),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
    })
    depleted = (F.col("words_left") < MIN_WORDS) | (F.col("words_left") < F.col("n_words") * F.lit(MIN_LEFT))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", "words_left")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, row_number() over () as r, coalesce('=' || source, '') as host, coalesce(text, '') as text from documents),
w as (select r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, i, words[i : i + 4] as win from (select r, words, unnest(generate_series(1, len(words) - 4)) as i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, win) as n from win) where n > 1),
repw as (select r, count(distinct p) as n_repeat_words from (select r, unnest(generate_series(i, i + 4)) as p from rep) group by r),
ln as (select r, unnest(lines) as line from w),
nl as (select r, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as line from ln join d using (r)),
freq as (select host, line from nl group by host, line having count(distinct r) > 20),
rem as (select r, count(*) as n_lines_removed, sum(len(string_split(line, ' '))) as words_removed from nl join freq using (host, line) group by r),
f as (select d.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines_removed, 0) as n_lines_removed, len(words) - coalesce(words_removed, 0) as words_left
      from d join w using (r) left join repw using (r) left join rem using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and words_left >= 10 and words_left >= n_words * 0.3 as kept,
  cast(n_lines_removed as bigint) as n_lines_removed, cast(words_left as bigint) as words_left
from f
"""
