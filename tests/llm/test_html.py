"""Wrappers and main texts."""

from __future__ import annotations

import html
import json
import re

import pytest

from insolara.llm import html_wrapper as hw
from insolara.llm.queries import QUERIES
from tests.llm.conftest import frame


def test_pages_equal_their_articles(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op5_html_extraction"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for page_id, source in pages.items():
        article = re.search(r"<article>(.*?)</article>", source, re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page_id]["text"] == "\n".join(b for b in blocks if b)
        assert got[page_id]["n_chars"] == len(got[page_id]["text"])


def page(number, body, extra=""):
    return (f"<html><head><title>T{number}</title><script>if (a<b) x('<p>no</p>')</script></head><body>"
            f"<div id=top><div class=menu><a href=/>Home</a> <a href=/x>News {number}</a></div></div>"
            f"<div><p>Accept our cookies</p></div>{body}{extra}"
            f"<div class='comments'><h3>Comments</h3><p>reader {number} says something rather long here</p></div>"
            f"<div><form><p>Search this site</p><input name=q></form></div>"
            f"<aside><p>Related {number}</p></aside><footer><p>Copyright {number}</p></footer></body></html>")


def body(number, lines):
    return "<div><h2>Head {0}</h2>{1}</div>".format(number, "".join(f"<p>Line {i} of {number} &amp; more\n text" for i in range(lines)))


def test_region_without_a_telling_name():
    """Without article or main, the element whose text differs between pages holds it; constant text stays out."""
    pages = [page(n, body(n, 2 + n % 4), "<div class=sponsored><p>Buy</p></div>" if n % 2 else "") for n in range(8)]
    wrapper = hw.infer(pages)
    for n, source in enumerate(pages):
        want = [f"Head {n}", *(f"Line {i} of {n} & more text" for i in range(2 + n % 4))]
        assert hw.main_text(source, wrapper) == "\n".join(want)
    new = page(99, body(99, 9))
    assert hw.main_text(new, wrapper).count("\n") == 9


def test_parts_inside_an_article_that_do_not_belong():
    source = ("<body><header><h1>Site</h1></header><main><article><header><p>by</p></header><h1>T</h1><p>One <b>two"
              "<p>three</b> <a href=x>four</a></p><div class='ad-box'><p>Buy</p></div><ul><li>five<li>six</ul>"
              "<aside>aside</aside><section id=comments><p>me too</p></section></article></main></body>")
    assert hw.main_text(source, hw.infer([source])) == "T\nOne two\nthree four\nfive\nsix"


def test_wrapper_has_optional_repeated_and_slots():
    wrapper = hw.infer([f"<div><h1>A{n}</h1>{'<p>x</p>' * n}{'<ul><li>a</ul>' if n % 2 else ''}<b>same</b></div>" for n in (1, 2, 3)])
    items = wrapper.items[0].items
    assert [i.key for i in items if isinstance(i, hw.Node)] == ["h1", "p", "ul"]
    assert items[0].items[0].value is None and items[1].many and items[2].maybe
    assert isinstance(items[3], hw.Text) and items[3].value == "same"
    assert hw.load(hw.dump(wrapper)) == wrapper


def test_tandem_runs_become_a_group():
    wrapper = hw.infer(["<main>" + "<h2>q</h2><p>a</p>" * 3 + "</main>", "<main>" + "<h2>r</h2><p>b</p>" * 5 + "</main>"])
    assert len(wrapper.items[0].items) == 1 and isinstance(wrapper.items[0].items[0], hw.Group)
    assert hw.main_text("<main><h2>1</h2><p>2</p><h2>3</h2><p>4</p></main>", wrapper) == "1\n2\n3\n4"


def test_page_of_another_make_than_its_host():
    wrapper = hw.infer([page(n, body(n, 3)) for n in range(4)])
    assert hw.main_text("<table><tr><td>Only</td></tr></table>", wrapper) == "Only"


@pytest.mark.parametrize("source", ["", "   ", "<", "<p", "</p></div>", "<script>", "<!-- never closed", "a < b & c", "<div><div><p>", "\x00"])
def test_broken_pages_do_not_crash(source):
    assert isinstance(hw.main_text(source, hw.infer([source])), str)


def test_odd_tables(spark):
    rows = [(1, None, None, 0), (2, "http://h/x", "", 0), (3, "not a url", "<p>Some text</p>", 1), (None, "http://h/y", "<main>hi&nbsp;there</main>", 1),
            (4, "http://h/z", "<main>" + "<p>long text</p>" * 20_000 + "</main>", 1), (4, "http://h/z", "<main>" + "<p>long text</p>" * 20_000 + "</main>", 1)]
    df = frame(spark, rows, "page_id long, url string, html string, host int")
    got = [(r["page_id"], r["text"]) for r in hw.main_texts(df).collect()]
    assert len(got) == 6
    texts = dict(got)
    assert (texts[1], texts[2], texts[3], texts[None]) == ("", "", "Some text", "hi there")
    assert texts[4].count("long text") == 20_000
    assert hw.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("names", ["single right-sidebar", "home header-fixed", "page no-comments", "login-ok", "post comments-open share-enabled"])
def test_names_of_the_whole_page_or_article_say_nothing(names):
    def make(n):
        blocks = "".join(f"<p>Line {i} of {n} is here</p>" for i in range(3))
        return (f"<html class='{names}'><body class='{names}'><nav><p>Menu {n}</p></nav><main class='{names}'><article class='{names}'>"
                f"<h1>Head {n}</h1>{blocks}</article></main><div class='sidebar'><p>Side {n}</p></div></body></html>")

    wrapper = hw.infer([make(n) for n in range(6)])
    for n in (1, 20):
        assert hw.main_text(make(n), wrapper) == "\n".join([f"Head {n}", *(f"Line {i} of {n} is here" for i in range(3))])


def test_icons_that_close_themselves():
    def make(n):
        return f"<body><article><p>Before {n} <svg width='1'/> after</p><p>Then <svg><path d='M0'/></svg> {n}</p></article></body>"

    assert hw.main_text(make(9), hw.infer([make(n) for n in range(5)])) == "Before 9 after\nThen 9"


def test_very_deep_pages():
    """No page ends the job; blocks at any depth come in their order."""
    def make(n, depth):
        return (f"<html><body><article><h1>Head {n}</h1>" + "<div>" * depth + f"<p>Deep {n}</p><p>Next {n}</p>" + "</div>" * depth
                + f"<p>Last {n}</p></article><footer><p>End {n}</p></footer></body></html>")

    for depth in (10, 500, 5000):
        wrapper = hw.infer([make(n, depth) for n in range(3)])
        assert hw.main_text(make(7, depth), wrapper) == "Head 7\nDeep 7\nNext 7\nLast 7"
        assert hw.main_text(make(7, depth), hw.load(json.loads(json.dumps(hw.dump(wrapper))))) == "Head 7\nDeep 7\nNext 7\nLast 7"
