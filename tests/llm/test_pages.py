"""Main text: names of furniture, several articles, bad markup in linear time, and another parser's result."""

import time
from html.parser import HTMLParser

import pytest

from rowloom.llm import line_blocks, queries

PROSE = "The first sentence of the article is long enough to be a line of prose. "


def page(inner, outer=""):
    return f"<html><body><nav><a href='/'>Home</a></nav>{outer}<article><h1>Head</h1><p>{PROSE * 3}</p>{inner}<p>{PROSE * 2}</p></article><footer>imprint</footer></body></html>"


WHOLE = " ".join(["Head", (PROSE * 3).strip(), (PROSE * 2).strip()])


@pytest.mark.parametrize("name", ["sidebar-content", "comments-content", "comments main", "comment-list comments entry", "share-content", "newsletter main"])
def test_furniture_words_win_inside_an_article(name):
    assert line_blocks.main_text(page(f"<div class='{name}'><p>{PROSE}</p></div>")) == WHOLE


@pytest.mark.parametrize("name", ["sidebar-content", "footer-content", "comments-content", "comments main", "header-content", "nav-main-content"])
def test_furniture_words_win_on_pages_without_an_article(name):
    html = f"<body><div id='text'><p>{PROSE * 3}</p><p>{PROSE * 2}</p></div><div class='{name}'><p>{PROSE * 2}</p><p>{PROSE}</p></div></body>"
    assert line_blocks.main_text(html) == " ".join([(PROSE * 3).strip(), (PROSE * 2).strip()])


@pytest.mark.parametrize("name", ["content has-sidebar", "main-content with-comments", "post no-sidebar", "entry-content", "post related", "article-body"])
def test_names_of_main_text_keep_it(name):
    html = f"<body><div class='{name}'><p>{PROSE * 3}</p><p>{PROSE * 2}</p></div></body>"
    assert line_blocks.main_text(html) == " ".join([(PROSE * 3).strip(), (PROSE * 2).strip()])


BAD = ['<a b="', "</b>", '<a b=">" ', "<i>", "<div class='related'>", "<a<", "<p>", "<a b='\">", "<script ", "<!-", "< ", "<div><i>", "</p>", "<i></p>", "<a b=\"'> ", "&lt", '<b c="d" ']


@pytest.mark.parametrize("piece", BAD)
def test_bad_markup_takes_linear_time(piece):
    """Ten times the page takes some ten times as long, not a hundred; a megabyte took under three seconds."""

    def took(n):
        html = "<article>" + piece * (n // len(piece)) + ">text</article>"
        began = time.process_time()
        line_blocks.main_text(html)
        return time.process_time() - began

    small, large = min(took(30_000) for _ in range(3)), took(300_000)
    assert large < 35 * max(small, 0.003), (small, large)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p title="a>b">one</p>', "one"), ("<p title='x\">y'>one</p>", "one"), ('<p title="never closed>one</p>two', "one two"), ("a < b and c > d", "a < b and c > d"), ("<p>one<!-- <p>no</p> -->two</p>", "onetwo"), ("<p>one<!-- open", "one"),
        ("<script>if (a<b) {'</p>'}</script>x", "x"), ("<style>p{}</STYLE >x", "x"), ("<script>open", ""), ("<svg><text>no</text></svg>yes", "yes"), ("one<br>two<br/>three", "one two three"), ("<b>bo</b>ld", "bold"), ("<", "<"), ("<>", "<>"),
        ("x</", "x"), ("x<!", "x"), ("<?php no ?>yes", "yes"), ("<p>a</b>c</p>", "ac"), ("<ul><li>a<li>b</ul>", "a b"), ("<p hidden>no</p><p>yes</p>", "yes"), ("a&nbsp;&amp;&#x41;&lt;p&gt;", "a &A<p>"), ("<p a = 'x' b=y>z</p>", "z"),
    ],
)
def test_markup_is_read(html, text):
    # A page of a single short text is kept as it is; a second copy, alone, tells that nothing else was in it.
    assert line_blocks.main_text(html) == text


class Plain(HTMLParser):
    """The text of the page's one article by the library's parser: blocks apart, furniture and hidden markup left out."""

    DROPPED = {"nav", "footer", "aside", "form", "button", "script", "style", "noscript", "template", "fieldset", "dialog", "menu", "select", "iframe", "svg"}
    BLOCKS = {"p", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "tr", "td", "th", "tbody", "thead", "blockquote", "pre", "figure", "figcaption", "header", "br", "hr", "dl", "dt", "dd", "article", "main"}
    VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "col", "area", "embed"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.line = [], [], []

    def cut(self):
        text = " ".join("".join(self.line).split())
        if text:
            self.out.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
        if tag not in self.VOID:
            self.stack.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        names = [t for t, _ in self.stack]
        inside = names[names.index("article") :] if "article" in names else None
        if inside and not set(inside) & self.DROPPED and not any(v for _, a in self.stack[names.index("article") :] for k, v in a.items() if k in ("class", "id", "role")):
            self.line.append(data)


def test_pages_equal_another_parsers_articles(spark):
    """Whole results over a given table, whose pages have one article each and no named block in it that is kept."""
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in queries.op3_main_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = Plain()
        p.feed(r["html"])
        p.close()
        p.cut()
        assert got[r["page_id"]] == " ".join(p.out), r["page_id"]
