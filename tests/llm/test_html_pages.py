"""HTML extraction: pages with omitted tags, visibility, controls, bounded output, and every visible word of whole pages."""

import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from marketlake.llm.html_layout import render


def test_a_head_without_its_end():
    want = "Hello world"
    for page in ("<html><head><title>T</title><body><p>Hello world", "<html><head><title>T</title><p>Hello world",
                 "<head><meta charset=x><style>p{}</style>Hello world", "<title>T</title><p>Hello world",
                 "<html><head><title>T</title></head><body><p>Hello world", "<head><noscript><link></noscript><p>Hello world",
                 "<head><template><p>no</p></template><div>Hello world", "<p>Hello <head><b>world</b>"):
        assert render(page) == want, page


def test_visibility():
    assert render("<p style='backface-visibility:hidden'>seen</p>") == "seen"
    assert render("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>") == "yes"
    assert render("<p style='color:red;display : NONE'>no</p><p style='display:none;display:block'>yes") == "yes"
    assert render("a<dialog>no</dialog><dialog open>yes</dialog>") == "a\nyes"
    assert render("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>") == "漢kan"


def test_controls_are_parted_and_items_numbered():
    assert render("a<textarea>ta</textarea>b") == "a ta b" and render("x<button>go</button>y") == "x go y"
    assert render("<select><option>one<option>two</select><textarea>ta</textarea>b").split() == ["one", "two", "ta", "b"]
    assert render("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"


def test_output_is_bounded():
    inner = "<table><tr>" + "<td colspan=1000>x" * 100 + "</table>"
    page = f"<table><tr><td>{inner}<td>y" + "<tr><td>a<td>b" * 300 + "</table>"
    assert len(render(page)) < 60 * len(page)
    page = "<table><tr><td>" + "w " * 20_000 + "<td>y" + "<tr><td>a<td>b" * 2_000 + "</table>"
    text = render(page)
    assert len(text) < 5 * len(page) and "w  y" in text
    page = "<blockquote>q" * 20_000
    assert len(render(page)) < 20 * len(page)


class Walk(HTMLParser):
    """Words outside elements that are not shown, found without a tree."""

    UNSEEN = {"head", "script", "style", "template", "noscript", "iframe", "object", "audio", "video", "canvas", "datalist", "title"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__()
        self.inside, self.words = [], []

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        off = tag in self.UNSEEN or "hidden" in dict(attrs) or re.search(r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)", style)
        if tag not in self.VOID and (self.inside or off):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.inside:
            self.words += data.split()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_visible_word_of_whole_pages(llm, sf):
    pages = [r.html for r in llm.read.parquet(f"/root/testdata/{sf}/pages.parquet").where("html IS NOT NULL").collect()]
    for html in pages:
        walk = Walk()
        walk.feed(html)
        want, got = Counter("".join(walk.words)), Counter("".join(render(html).split()))
        assert not want - got, html[:500]
        assert not {c for c in got - want if c not in "-.0123456789"}, html[:500]
