"""Page extraction: exact article text of the pages, and hand-made cases."""

import html
import re

import pytest

from mercato.llm import htmltext as H


def expected(page):
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(p for p in parts if p)


def test_all_pages_have_exactly_their_article(spark, sf_llm):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_llm}/pages.parquet").collect()}
    got = H.op2(spark, sf_llm).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id]) and r.n_chars == len(r.text)


LONG = "This is a sentence of the story, and it goes on for a while. It has more to say, too."

CASES = {
    "divs and a sidebar": (
        f"<body><div id=menu><a href=x>Home</a> <a href=y>News</a></div><div class='post'><h2>Title here</h2><p>{LONG}</p>"
        f"<p>Of.</p><p>{LONG}</p></div><aside><p>{LONG}</p></aside><div class='comments'><p>{LONG} I agree.</p></div></body>",
        f"Title here\n{LONG}\nOf.\n{LONG}"),
    "header, notice, form and share box": (
        f"<html><body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies, really. {LONG}</div><main><article>"
        f"<h1>Head</h1><p>{LONG}</p><div class=share><a href=a>Share</a></div><form><p>Your name, please.</p><input></form>"
        f"<ul><li>first<li>second &amp; last</ul></article></main><footer>Copyright</footer></body></html>",
        f"Head\n{LONG}\nfirst\nsecond & last"),
    "references, white space and inline mark-up": (
        f"<article><p>  a&nbsp;&lt;b&gt;\n\t<b>bold</b>face&#33; &eacute;&#x41;<br>next </p><p>{LONG}</p></article>",
        f"a <b> boldface! éA next\n{LONG}"),
    "scripts, comments and a page that ends early": (
        f"<article><script>var a='<p>no</p>';</script><!-- <p>no</p> --><style>p{{}}</style><p>{LONG}<p>{LONG}<b>end",
        f"{LONG}\n{LONG}end"),
    "plain text": (LONG, LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, text = CASES[name]
    assert H.extract(page)[0] == text


P = f"<p>{LONG}</p>"

PARTS = {
    "two divs, the first with three quarters": (f"<body><nav><a href=x>Menu</a></nav><div class=content><div class=part>{P * 3}</div>"
                                                f"<div class=part>{P}</div></div><footer>Us</footer></body>", [LONG] * 4),
    "sections of equal form": (f"<body><div><section><h2>One</h2>{P * 4}</section><section><h2>Two</h2>{P}</section></div></body>",
                               ["One", *[LONG] * 4, "Two", LONG]),
    "paragraphs beside a long table": (f"<body><div>{P}<table><tr><td>{P * 8}</td></tr></table>{P}</div></body>", [LONG] * 10),
    "three articles, one of them long": (f"<body><div><a href=x>Home</a></div><article>{P}</article><article>{P * 6}</article>"
                                         f"<article>{P}</article></body>", [LONG] * 8),
    "articles in main": (f"<body><main><h1>Head</h1><article>{P * 6}</article><article>{P}</article></main></body>",
                         ["Head", *[LONG] * 7]),
}


@pytest.mark.parametrize("name", PARTS)
def test_no_part_of_the_content_is_lost(name):
    page, lines = PARTS[name]
    assert H.extract(page)[0].split("\n") == lines


UNCLOSED = {
    "head without its end tag": (f"<html><head><title>x</title><meta charset=u><body><article>{P}</article></body></html>", [LONG]),
    "head and title without end tags": (f"<head><title>x<body><article>{P}</article>", [LONG]),
    "head that a block ends": (f"<head><title>x</title><style>p{{}}</style><div>{P}</div>", [LONG]),
    "head that text ends": (f"<head><title>x</title>\n{LONG}", [LONG]),
    "head with its end tag": (f"<head><noscript><div>no</div></noscript><title>a <div> b</title></head><body>{P}</body>", [LONG]),
    "open noscript in an open head": (f"<head><noscript><link href=x><body><article>{P}</article>", [LONG]),
    "select without its end tag": (f"<article>{P}<div><select><option>no</div>{P}</article>", [LONG] * 2),
    "select that a block ends": (f"<article>{P}<select><option>no{P}</article>", [LONG] * 2),
    "drawing without its end tag": (f"<article>{P}<div><svg><title>no</title><g><text>no</text></div>{P}</article>", [LONG] * 2),
    "template and noscript end with their parents": (
        f"<article>{P}<div><template><p>no</div><div><noscript><p>no</div>{P}</article>", [LONG] * 2),
    "closed ones": (f"<article>{P}<svg><foreignObject><p>no</p></foreignObject></svg><template><div>no<template>no</template>"
                    f"no</div></template><select><option>no</select><iframe>no</iframe>{P}</article>", [LONG] * 2),
    "object with its fallback": (f"<article>{P}<object data=x><p>Instead of it.</p></object>{P}</article>",
                                 [LONG, "Instead of it.", LONG]),
    "object without its end tag": (f"<article><object data=x>{P}{P}</article>", [LONG] * 2),
    "formula": (f"<article>{P}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>{P}</article>",
                [LONG, "So x=2 holds.", LONG]),
}


@pytest.mark.parametrize("name", UNCLOSED)
def test_unclosed_elements_lose_nothing(name):
    page, lines = UNCLOSED[name]
    assert H.extract(page)[0].split("\n") == lines


@pytest.mark.parametrize("page", [None, "", "   ", "<nav><a href=x>Only a menu</a></nav>", "<", "<p", "</p></p>", "<!--"])
def test_pages_without_text(page):
    assert H.extract(page)[0] in ("", "<", "<p")


def test_hostile_pages_end():
    assert H.extract("<div>" * 20_000 + LONG)[0] == LONG
    H.extract("<a title='" * 20_000)
    H.extract("</b>" * 50_000 + "<p>" * 50_000)
    assert len(H.extract("<article><p>" + "word, " * 200_000)[0]) == 6 * 200_000 - 1


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "u"), (1, f"<p>{LONG}</p>", "u"), (1, f"<p>{LONG}</p>", None)],
                               "page_id long, html string, text string")
    out = H.extract_pages(df)
    assert sorted(r.text for r in out.collect()) == ["", LONG, LONG]
    assert out.columns == ["page_id", "html", "text", "n_chars", "n_blocks", "n_paths"]
    assert H.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [
    "<section id='related-work'><p>{0}</p></section>", "<section id='discussion'><p>{0}</p></section>",
    "<div class='market-share'><p>{0}</p></div>", "<h2 id='social-policy'>{0}</h2>", "<p class='notice'>{0}</p>",
    "<div class='header-files-in-c'><p>{0}</p></div>", "<p id=comment>{0}</p>", "<div id='searchAlgorithms'><p>{0}</p></div>"])
@pytest.mark.parametrize("around", ["<article>{0}</article>", "<main>{0}</main>", "<article>{0}</article><article><p>" + LONG + "</p></article>"])
def test_names_with_another_meaning_lose_nothing(part, around):
    body = f"<p>{LONG}</p>" + part.format("Fifty three words of it.") + f"<p>{LONG}</p>"
    text = H.extract(f"<html><body><nav><a href=x>Menu</a></nav>{around.format(body)}<footer>Us</footer></body></html>")[0]
    assert text.split("\n")[:3] == [LONG, "Fifty three words of it.", LONG]


@pytest.mark.parametrize("name", ["related-posts", "social share", "cookie-notice", "commentList", "ad", "ads_box", "newsletter-signup",
                                  "comments-section", "sharing-buttons", "siteHeader"])
def test_boilerplate_by_name(name):
    page = f"<body><article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>{LONG}</p></article></body>"
    assert H.extract(page)[0] == f"{LONG}\n{LONG}"
