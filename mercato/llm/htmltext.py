"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text nodes, each with its tag path from root to
leaf.  Per path: the text length and the punctuation of all its nodes over
their number, and the share of its text inside links.  Every node takes its
path's ratios; along the page they are smoothed with a Gaussian, fused (the
geometric mean of both, less the link share) and compared with a multiple of
their standard deviation; paths whose nodes exceed it on average are content
paths.  The article is the deepest container that holds all nodes of content
paths (the article or main element around it, if there is one; several
articles if each such node is in one), and its text is every node in it that
is not part of a menu, header, footer, sidebar, notice, advert, form or
comment section.  Such parts are known by their element, role or name; a name
counts only as a whole, never for headings and paragraphs of an article, and
for its sections only if it has no second meaning.

Everything inside the article stays, short blocks too.  NULL and empty pages,
and pages without such text, give the empty text; broken mark-up (unclosed
or crossed elements, a page that ends early) is read as far as it goes: an
unclosed head ends at the first thing that cannot be in one, other skipped
elements at their parent's end, and only scripts, styles, text areas and
comments run to the end of the page.  Text of formulas and of objects stays.
Pages are read one by one: repeated rows and ties get equal results.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructField

from mercato.llm.common import append_columns, read_table

#: Gaussian weights of a node's neighbours, and the threshold in standard deviations.
SIGMA, RADIUS = 1.0, 2
THRESHOLD = 0.8

# Element names by their part in a page.
RAW = "script|style|textarea"
SKIPPED = set("head iframe noscript select svg template title".split())
HEAD_CONTENT = set("base link meta noscript script style template title".split())
#: Skipped elements that cannot hold a block, and elements in which a block does not end them.
ENDED_BY_BLOCK = SKIPPED - {"noscript", "template"}
BLOCKS_INSIDE = {"foreignobject", "noscript", "template"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("article body center div html main section table tbody td tr".split())
BLOCKS = CONTAINERS | set(
    "address aside blockquote caption dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li menu nav ol p pre summary tfoot th thead ul".split())
CLOSES_PARAGRAPH = BLOCKS - {"td", "tr", "tbody", "thead", "tfoot", "th", "caption"}
ITEM_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
               "td": {"tr", "table"}, "th": {"tr", "table"}}
ITEM_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
INLINE_SCOPE_END = BLOCKS - {"p"}
BOILERPLATE = set("nav footer aside form button menu dialog fieldset input label".split())
BOILERPLATE_ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
# Words of class and id names that mark what is no article text, those of them that may as well name a
# part of an article, and words of layout that may stand beside either.
CLEAR_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notification pagination popup promo promos promoted promotion recommended sidebar signup skip sponsor "
    "sponsored sponsors subscribe toolbar topbar widget".split())
UNCLEAR_NAMES = set("discussion header notice notices related replies respond responses search share sharing social".split())
LAYOUT_NAMES = set(
    "articles area bar block bottom box btn button buttons byline container content count entry feed form fixed global "
    "group holder icon icons inner item items left link links list main media more nav outer overlay page panel post posts "
    "primary right row secondary section side site slot small sticky stories strip tags thread title tool tools top unit "
    "us wrap wrapper".split())
NAME_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: Elements that are part of a text whatever their name, and one of which only a clear name counts in an article.
TEXT_ELEMENTS, SECTIONS = set("h1 h2 h3 h4 h5 h6 p".split()), {"section"}
NEVER_BY_NAME = {"html", "body", "article", "main"}

MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    # a skipped element with its end tag; one without, or with another of its kind inside, is read as an element
    rf"|<(?P<skip>{'|'.join(sorted(SKIPPED - {'head'}))})(?=[\s/>])[^>]*+>[^<]*+"
    r"(?:<(?!/?(?:article|body|head|main|(?P=skip))[\s/>])[^<]*+)*+</(?P=skip)\s*>"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:\-]*)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>"""
    r"|</?[a-zA-Z][^<>]*>|<[!?][^>]*>", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：¿¡]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Element:
    tag: str
    parent: int
    path: int
    boilerplate: bool
    in_article: bool
    in_link: bool
    skipped: bool = False


@dataclass
class Node:
    text: str
    element: int
    block: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)


@lru_cache(1 << 16)
def named(value: str) -> int:
    """What a class or id attribute tells: 2 that this is no article text, 1
    that it may be none, 0 nothing.  A name counts if all its parts are listed
    words or words of layout, at least one of them the former, so that
    ``related-work`` or ``market-share`` do not."""
    best = 0
    for name in value.split():
        parts = {w.lower() for w in NAME_PARTS.split(name) if w and not w.isdigit()}
        if parts <= CLEAR_NAMES | UNCLEAR_NAMES | LAYOUT_NAMES:
            best = max(best, 2 if parts & CLEAR_NAMES else 1 if parts & UNCLEAR_NAMES else 0)
    return best


def _is_boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return True
    for name, value in ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id") and tag not in NEVER_BY_NAME and value:
            least = 3 if tag in TEXT_ELEMENTS and in_article else 2 if tag in TEXT_ELEMENTS | SECTIONS else 1
            if named(value) >= least:
                return True
    return False


def parse(source: str) -> Page:
    """Text nodes of a page with their elements, in page order."""
    page = Page()
    root = Element("", -1, 0, False, False, False)
    page.elements.append(root)
    stack = [0]
    open_tags: dict[str, int] = {}
    block, at = 0, 0

    def pop():
        tag = page.elements[stack.pop()].tag
        open_tags[tag] -= 1

    def close(tags: set[str], scope: set[str]):
        """Close the nearest open one of ``tags`` unless ``scope`` comes first."""
        if not any(open_tags.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[k]].tag
            if tag in tags:
                while len(stack) > k:
                    pop()
                return
            if tag in scope or tag in SKIPPED:
                return

    def end_skipped(tag: str):
        """Close the open skipped elements that cannot hold ``tag``."""
        cut, in_head = len(stack), open_tags.get("head")
        if tag == "body" and in_head:
            cut = next(k for k in range(len(stack) - 1, 0, -1) if page.elements[stack[k]].tag == "head")
        elif tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                name = page.elements[stack[k]].tag
                if name in BLOCKS_INSIDE and not (name == "noscript" and in_head) or not page.elements[stack[k]].skipped:
                    break
                if name in ENDED_BY_BLOCK:
                    cut = k
        elif page.elements[stack[-1]].tag == "head" and tag not in HEAD_CONTENT:
            cut = len(stack) - 1
        while len(stack) > cut:
            pop()

    def add_text(text: str):
        if page.elements[stack[-1]].tag == "head" and not text.isspace():
            end_skipped("")
        if text and not page.elements[stack[-1]].skipped:
            page.nodes.append(Node(text, stack[-1], block))

    for match in MARKUP.finditer(source):
        if match.start() > at:
            add_text(source[at:match.start()])
        at = match.end()
        tag = (match.group("tag") or "").lower()
        if not tag:
            continue
        if match.group("end"):
            if tag in BLOCKS:
                block += 1
            if open_tags.get(tag):
                while page.elements[stack[-1]].tag != tag:
                    pop()
                pop()
            continue
        if page.elements[stack[-1]].skipped:
            end_skipped(tag)
        if tag == "br":
            add_text(" ")
            continue
        if tag in BLOCKS:
            block += 1
            if tag in CLOSES_PARAGRAPH:
                close({"p"}, INLINE_SCOPE_END)
            if tag in ITEM_CLOSES:
                close(ITEM_CLOSES[tag], ITEM_SCOPES[tag])
        if tag in VOID:
            continue
        up = page.elements[stack[-1]]
        path = page.paths.setdefault((up.path, tag), len(page.paths) + 1)
        page.elements.append(Element(
            tag, stack[-1], path,
            up.boilerplate or _is_boilerplate(tag, match.group("attrs"), up.in_article),
            up.in_article or tag in ("article", "main"), up.in_link or tag == "a",
            up.skipped or tag in SKIPPED))
        if not match.group("attrs").endswith("/") or tag in BLOCKS:
            stack.append(len(page.elements) - 1)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(source):
        add_text(source[at:])
    return page


def smooth(values: list[float]) -> list[float]:
    """Gaussian mean of each value and its neighbours."""
    weights = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out, n = [], len(values)
    for i in range(n):
        total = part = 0.0
        for k, w in enumerate(weights, i - RADIUS):
            if 0 <= k < n:
                total += w * values[k]
                part += w
        out.append(total / part)
    return out


def content_paths(page: Page, sizes: list[int]) -> dict[int, float]:
    """Paths whose fused and smoothed ratios pass the threshold, with their mean."""
    totals: dict[int, list[float]] = {}
    for node, size in zip(page.nodes, sizes):
        element = page.elements[node.element]
        if size and not element.boilerplate:
            sums = totals.setdefault(element.path, [0, 0, 0, 0])
            sums[0] += size
            sums[1] += len(PUNCTUATION.findall(node.text))
            sums[2] += size if element.in_link else 0
            sums[3] += 1
    owners, lengths, marks, links = [], [], [], []
    for node, size in zip(page.nodes, sizes):
        element = page.elements[node.element]
        if not size:
            continue
        sums = totals.get(element.path) if not element.boilerplate else None
        owners.append(element.path if sums else None)
        lengths.append(sums[0] / sums[3] if sums else 0.0)
        marks.append((1 + sums[1]) / sums[3] if sums else 0.0)
        links.append(sums[2] / sums[0] if sums else 1.0)
    if not totals:
        return {}
    lengths, marks = smooth(lengths), smooth(marks)
    top_length, top_mark = max(lengths) or 1.0, max(marks) or 1.0
    fused = [math.sqrt(a / top_length * b / top_mark) * (1 - c) for a, b, c in zip(lengths, marks, links)]
    mean = sum(fused) / len(fused)
    threshold = THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    by_path: dict[int, list[float]] = {}
    for path, x in zip(owners, fused):
        if path is not None:
            by_path.setdefault(path, []).append(x)
    return {p: sum(x) / len(x) for p, x in by_path.items() if sum(x) / len(x) >= threshold and sum(x) > 0}


def article_elements(page: Page, sizes: list[int], chosen: dict[int, float]) -> set[int]:
    """The deepest container of all nodes of the chosen paths, or the article
    or main element around it; without one, the article and main elements
    of these nodes if each is in one."""
    held = [0] * len(page.elements)
    around = [0] * len(page.elements)  # the outermost article or main element
    for k, element in enumerate(page.elements):
        around[k] = around[element.parent] if k and around[element.parent] else k if element.in_article else 0
    outer: set[int] = set()
    for node, size in zip(page.nodes, sizes):
        element = page.elements[node.element]
        if size and not element.boilerplate and element.path in chosen:
            held[node.element] += 1
            outer.add(around[node.element])
    for k in range(len(page.elements) - 1, 0, -1):  # children follow their parents
        held[page.elements[k].parent] += held[k]
    # the last container that holds all is the deepest: two such are nested
    best = max((k for k, e in enumerate(page.elements) if e.tag in CONTAINERS and held[k] == held[0]), default=0)
    k = best
    while k > 0:
        if page.elements[k].tag in ("article", "main"):
            return {k}
        k = page.elements[k].parent
    return {best} if 0 in outer else outer


def extract(source: str | None) -> tuple[str, int, int]:
    """(main text, its blocks, content paths) of a page."""
    if not source:
        return "", 0, 0
    page = parse(source)
    sizes = [len(n.text) - sum(map(n.text.count, " \n\t\r")) for n in page.nodes]
    chosen = content_paths(page, sizes)
    if not chosen:
        return "", 0, 0
    tops = article_elements(page, sizes, chosen)
    inside = [k in tops for k in range(len(page.elements))]
    for k in range(1, len(page.elements)):
        inside[k] = inside[k] or inside[page.elements[k].parent]
    blocks: dict[int, list[str]] = {}
    for node in page.nodes:
        if inside[node.element] and not page.elements[node.element].boilerplate:
            blocks.setdefault(node.block, []).append(html.unescape(node.text) if "&" in node.text else node.text)
    lines = [line for parts in blocks.values() if (line := " ".join("".join(parts).split()))]
    return "\n".join(lines), len(lines), len(chosen)


def extract_pages(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with text, n_chars, n_blocks and n_paths of each whole page."""

    def factory():
        def made(pages):
            rows = [extract(p) for p in pages.to_pylist()]
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())]

        return made

    fields = [StructField("text", StringType()), StructField("n_chars", LongType()),
              StructField("n_blocks", IntegerType()), StructField("n_paths", IntegerType())]
    return append_columns(df, html_col, fields, factory)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars", "n_blocks")
