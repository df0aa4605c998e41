"""Licence scans: identifier tags and notice phrases.

One Aho-Corasick automaton finds all phrases, and the words of the identifier
tag, in a text's words.  What follows a tag is read as a licence expression:
a shunting-yard parser turns identifiers, parentheses, AND, OR and WITH into
postfix form, which is evaluated to the licence families named, and to how
strict the whole expression is (the mildest branch of OR, the strictest part
of AND; an exception makes copyleft one step milder).

The score is 1 minus the product of the doubts of each distinct finding: a
well-formed tag leaves little doubt, a phrase more, a malformed tag most.

NULL and empty texts have no words and no labels; their first and last word
are NULL and the score is 0.  Rows are scanned one by one, so repeated rows
and ties get equal results.  Added columns replace columns of their name.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from mercato.llm.common import append_columns, read_table

# The base phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "all rights reserved": "all-rights-reserved",
    "apache software license": "apache",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "the unlicense": "unlicense",
    "zlib license": "zlib",
}

# Identifier prefixes, their families and how strict they are
# (0 public domain, 1 permissive, 2 weak copyleft, 3 copyleft, 4 use limits).
FAMILIES = {
    "0bsd": ("bsd", 0),
    "agpl": ("agpl", 3),
    "apache": ("apache", 1),
    "bsd": ("bsd", 1),
    "bsl": ("bsl", 1),
    "cc-by": ("cc-by", 1),
    "cc-by-nc": ("cc-by-nc", 4),
    "cc-by-nd": ("cc-by-nd", 4),
    "cc-by-sa": ("cc-by-sa", 3),
    "cc0": ("cc0", 0),
    "epl": ("epl", 2),
    "gpl": ("gpl", 3),
    "isc": ("isc", 1),
    "lgpl": ("lgpl", 2),
    "mit": ("mit", 1),
    "mpl": ("mpl", 2),
    "unlicense": ("unlicense", 0),
    "zlib": ("zlib", 1),
}
STRICTNESS = ("public-domain", "permissive", "weak-copyleft", "copyleft", "restricted")

#: Family of an identifier that no prefix is known for.
UNKNOWN = "unknown"

TAG_WORDS = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:\-]+)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Doubt that a finding leaves.
DOUBT_PHRASE, DOUBT_TAG, DOUBT_BROKEN_TAG = 0.35, 0.05, 0.6

#: Bytes of words, in lower case; all others become spaces.
AS_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32
                 for c in range(256))


class ExpressionError(ValueError):
    pass


def tokens_of(expression: str) -> list[str]:
    """Tokens up to the first sign that no expression can hold."""
    out, at = [], 0
    while match := TOKEN.match(expression, at):
        out.append(match.group(1))
        at = match.end()
    return out


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators in order of WITH, AND, OR, each from the left."""
    out: list[str] = []
    stack: list[str] = []
    wants_operand = True
    for token in tokens:
        low = token.lower()
        if low in PRECEDENCE:
            if wants_operand:
                raise ExpressionError(f"an operand is missing before {token}")
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            wants_operand = True
        elif token == "(":
            if not wants_operand:
                raise ExpressionError("an operator is missing before (")
            stack.append(token)
        elif token == ")":
            if wants_operand:
                raise ExpressionError("an operand is missing before )")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError("an opening parenthesis is missing")
            stack.pop()
        else:
            if not wants_operand:
                break  # prose after the expression
            out.append(token)
            wants_operand = False
    if wants_operand:
        raise ExpressionError("an operand is missing at the end")
    while stack:
        if stack[-1] == "(":
            raise ExpressionError("a closing parenthesis is missing")
        out.append(stack.pop())
    return out


def family(identifier: str) -> tuple[str, int] | None:
    """Family and strictness of the longest known prefix of an identifier."""
    low = identifier.lower()
    best = max((p for p in FAMILIES if low == p or low.startswith((p + "-", p + "+"))), key=len, default=None)
    return FAMILIES[best] if best else None


def evaluate(postfix: list[str]) -> tuple[set[str], int | None]:
    """(families named, strictness) of an expression in postfix form.  An
    unknown identifier names the family ``unknown`` and has no strictness; with
    AND nothing is known of the whole then, with OR the known side may be chosen."""
    stack: list[tuple[set[str], int | None]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            known = family(token)
            stack.append(({known[0]}, known[1]) if known else ({UNKNOWN}, None))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            level = left[1]
            stack.append((left[0], level - 1 if level in (2, 3) else level))
            continue
        levels = [x for x in (left[1], right[1]) if x is not None]
        if token == "and":
            level = max(levels) if len(levels) == 2 else None
        else:
            level = min(levels, default=None)
        stack.append((left[0] | right[0], level))
    return stack[-1]


def read_tag(expression: str) -> tuple[set[str], int | None, bool]:
    """(families, strictness, whether well formed) of what follows a tag."""
    tokens = tokens_of(expression)
    try:
        return (*evaluate(to_postfix(tokens)), True)
    except ExpressionError:
        named = [family(t) for t in tokens if t.lower() not in PRECEDENCE and t not in "()"]
        return {k[0] for k in named if k}, None, False


def word_starts(data: bytes) -> np.ndarray:
    """Places of a text in lower-case words and spaces where a word begins."""
    inside = np.frombuffer(data, np.uint8) != 32
    return np.flatnonzero(inside & ~np.append(False, inside[:-1])) if len(inside) else np.zeros(0, np.int64)


class Scanner:
    """All phrases in one automaton over a text's words."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        entries = [(p, ("base", label)) for p, label in BASE_PHRASES.items()]
        entries += [(p, ("notice", label)) for p, label in NOTICE_PHRASES.items()]
        for phrase, (kind, label) in [*entries, (TAG_WORDS, ("tag", ""))]:
            key = f" {phrase} "
            self.automaton.add_word(key, (kind, label, len(key)))
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        words = text.encode("utf-8").translate(AS_WORDS).split()
        joined = b" " + b" ".join(words) + b" "
        begins = word_starts(joined)
        doubts: dict[tuple[str, str], float] = {}
        base, notices, tagged, starts, findings = set(), set(), False, [], []
        for end, (kind, label, size) in self.automaton.iter(joined.decode("latin-1")):
            if kind == "tag":
                tagged = True
                continue
            at = int(np.searchsorted(begins, end + 2 - size))  # the phrase's own space stands before its word
            findings.append({"kind": kind, "label": label, "first_word": at})
            doubts[kind, label] = DOUBT_PHRASE
            if kind == "base":
                base.add(label)
                starts.append(at)
            else:
                notices.add(label)
        strictest = None
        if tagged:
            own, seen, upto = word_starts(text.encode("utf-8").translate(AS_WORDS)), 0, 0
            for match in TAG.finditer(text):
                seen += len(text[upto:match.start()].encode("utf-8"))  # bytes before the tag, each counted once
                upto = match.start()
                places = int(np.searchsorted(own, seen))
                families, level, whole = read_tag(match.group(1))
                notices |= families
                for label in families:
                    doubts["tag", label] = min(doubts.get(("tag", label), 1.0), DOUBT_TAG if whole else DOUBT_BROKEN_TAG)
                    findings.append({"kind": "tag", "label": label, "first_word": places})
                if level is not None:
                    strictest = level if strictest is None else max(strictest, level)
        doubt = 1.0
        for key in sorted(doubts):
            doubt *= doubts[key]
        return {
            "n_words": len(words), "n_base": len(starts),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | notices)), "score": 1.0 - doubt,
            "tag_strictness": None if strictest is None else STRICTNESS[strictest], "findings": findings,
        }


FINDING = StructType([StructField("kind", StringType()), StructField("label", StringType()),
                      StructField("first_word", IntegerType())])
FIELDS = [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
          StructField("last_word", LongType()), StructField("base_labels", StringType()),
          StructField("labels", StringType()), StructField("score", DoubleType()),
          StructField("tag_strictness", StringType()), StructField("findings", ArrayType(FINDING))]
ARROW = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
         "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "tag_strictness": pa.string(),
         "findings": pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int32())]))}


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the figures, labels, score and findings of each whole text."""

    def factory():
        scanner = Scanner()

        def made(texts):
            rows = [scanner.scan(t or "") for t in texts.to_pylist()]
            return [pa.array([r[name] for r in rows], kind) for name, kind in ARROW.items()]

        return made

    return append_columns(df, text_col, FIELDS, factory)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "tag_strictness")
