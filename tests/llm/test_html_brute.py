"""The page reader against the standard library's parser, the network against a plain loop, and the whole operator against both."""

import math
import os
import random
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from emberlog.llm import html_extract as H

DATA = "/root/testdata/sf0.001/pages.parquet"


class Plain(HTMLParser):
    """Texts of the blocks of a page, by events of the standard parser and a plain stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now, self.hidden = [], [], None, None

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in H.HIDDEN_TAGS.split("|"):
            self.hidden = tag
            self.add(" ")
            return
        if tag in H.BLOCK_TAGS:
            self.now = None
            kinds = {*H.ENDS.get(tag, ()), *(["p"] if tag not in ("option", "body") else [])}
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i] in kinds:
                    del self.stack[i:]
                    break
                if self.stack[i] in H.BLOCK_TAGS and self.stack[i] != "p":
                    break
        elif tag == "br":
            self.add(" ")
        if tag not in H.VOID_TAGS:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.stack[-1:] == [tag]:
            self.stack.pop()

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
            return
        if tag in H.BLOCK_TAGS:
            self.now = None
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        if self.hidden or {"head", "title"} & {*self.stack}:
            return
        if self.now is None and data.strip():
            self.now = []
            self.blocks.append(self.now)
        self.add(data)

    def add(self, data):
        if self.now is not None:
            self.now.append(data)


def texts(page):
    reader = Plain()
    reader.feed(page)
    reader.close()
    return [t for t in (" ".join("".join(b).split()) for b in reader.blocks) if t]


def pages():
    r = random.Random(77)
    out = [H.made_page(r)[0] for _ in range(120)]
    return out + (pq.read_table(DATA)["html"].to_pylist() if os.path.exists(DATA) else [])


def random_page(r):
    """Any mixture of open, closed, unclosed and misplaced elements."""
    tags = ["p", "div", "ul", "li", "b", "a", "span", "table", "tr", "td", "h2", "br", "option", "select", "i", "em", "dl", "dt", "dd"]
    parts = ["word", "two words ", " ", "\n", "&amp;", "&lt;b&gt;", "é", "1 < 2 ", "a&b", "<!-- <p>no --> ", "<script>if (a < b) {'</p>'}</script>", "<style>p{}</style>", '<img alt="a > b">', "<br/>", "<p/>"]
    for t in tags:
        parts += [f"<{t}>", f"<{t}>", f"</{t}>", f'<{t} class="x y" id=z>', f"<{t} title='it is > so' data-a=b/c>", f"<{t.upper()}\n checked>", f"</{t} >"]
    return "<body>" + "".join(r.choice(parts) for _ in range(r.randrange(60)))


def test_reader_matches_the_standard_parser():
    r = random.Random(5)
    for page in pages() + [random_page(r) for _ in range(1500)]:
        assert [b.text for b in H.blocks_of(page)] == texts(page), page


@pytest.mark.parametrize(
    "page, blocks",
    [
        ('<p>Hello there.</p><a href="http://exa', ["Hello there."]), ('<p class="x>Hello</p>', []), ("<p>a</p><!-- b", ["a"]), ("<p>a<b", ["a"]), ("<p>a</", ["a"]), ("<p>a<", ["a"]), ("<p>a &am", ["a &am"]), ("<p title=it's>a</p><p>b's</p>", ["a", "b's"]),
        ('<p a="1"b=\'2\'>x', ["x"]), ("<p>1 < 2 <3</p>", ["1 < 2 <3"]), ("a</>b", ["ab"]), ("<script>x", []), ("<SCRIPT>x</Script >y", ["y"]), ('<textarea><p>"</textarea>z', ["z"]), ("<?xml ?>q<!DOCTYPE html>", ["q"]),
        ("<p>one" + "<b>" * 20 + "two<p>three", ["onetwo", "three"]), ("", []), ("<", []), ("plain", ["plain"]), ('<p>one</p><svg class="i"/><p>two</p>', ["one", "two"]),
    ],
)
def test_broken_markup(page, blocks):
    assert [b.text for b in H.blocks_of(page)] == blocks


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<b>", "</i>", "<b><p>", "<!--", "<", "<a b=c'", "<svg>", "<script>", "&", "<p><b></q>", "<div>"])
def test_reading_is_linear(piece):
    def took(n):
        began = time.process_time()
        H.blocks_of("<p>" + piece * n + "x")
        return time.process_time() - began

    took(100)
    assert took(40_000) < 1 + 12 * max(took(10_000), 0.01)


def plain_scores(net, x):
    """The network's definition, step by step and without arrays of batches."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, c, out = np.zeros(H.HIDDEN), np.zeros(H.HIDDEN), {}
        for t in order:
            a = np.array(x[t], float) @ net.p[f"W{d}"] + net.p[f"c{d}"] + h @ net.p[f"U{d}"]
            i, f, o, g = a[: H.HIDDEN], a[H.HIDDEN : 2 * H.HIDDEN], a[2 * H.HIDDEN : 3 * H.HIDDEN], a[3 * H.HIDDEN :]
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out[t] = h
        states[d] = out
    return [float(sigmoid(np.concatenate([states["f"][t], states["b"][t]]) @ net.p["V"][:, 0] + net.p["v"][0])) for t in range(len(x))]


def test_query_matches_plain_python(spark):
    from emberlog.llm.runtime import ship

    ship(spark)
    net, own = H.trained(), pages()[::4] + [None, "", "<p>"]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(own)], "page_id long, url string, html string")).collect()}
    for i, page in enumerate(own):
        scores = plain_scores(net, H.vectors([H.blocks_of(page or "")])[0])
        assert all(math.fabs(s - 0.5) > 1e-4 for s in scores)
        text = "\n\n".join(t for t, s in zip(texts(page or ""), scores) if s >= 0.5)
        assert got[i] == (text, len(text))
