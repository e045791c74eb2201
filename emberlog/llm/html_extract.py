"""Main text of web pages by a recurrent block labeller.

A page is read once into its leaf blocks (runs of text between block-level tags) in page order. Each block becomes a vector: the
tags, classes and ids on its path and all its words, hashed into a fixed number of places, and a few ratios. A bidirectional LSTM
in numpy reads a page's whole sequence of vectors, so every block is labelled in the light of all that stand before and after it. Blocks
labelled as main text are joined.

The network is trained in this process, in a few seconds and always alike, on pages that a small grammar writes (``made_page``): articles in the
usual containers among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, all with known labels. No input rows
are needed for training, and nothing is fetched.

Defined cases: a null, empty or textless page gives the empty text; a tag, comment or quoted attribute that never ends gives nothing from its
beginning on, a reference that is cut off stands as it is; reading takes time in proportion to the page, whatever its markup; the inside of a closed svg is no text, nor is that of ``HIDDEN_TAGS``; unclosed elements end where HTML ends them; long pages are read whole; repeated rows give repeated results; the columns page_id
and url are handed on, others are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.runtime import streamed
from emberlog.llm.textblock import large, row_ranges

PATH_PLACES, WORD_PLACES, RATIOS = 192, 96, 6
HIDDEN, PAGES, EPOCHS, BATCH, RATE, SEED = 24, 1000, 10, 24, 0.008, 11
INPUTS = PATH_PLACES + WORD_PLACES + RATIOS

#: HTML's block-level elements, and those whose content is never text of the page, up to the page's end if need be.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = "script|style|template|iframe|textarea"
#: An element of the first kind ends an open one of the second kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: A tag as most pages write it. What it doesn't match is read piece by piece.
_USUAL = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[ \t\n\f\r]+[a-zA-Z-]+(?:="[^"<>]*"|='[^'<>]*')?)*)[ \t\n\f\r]*(/?)>""")
_NAME, _GAP, _ATTRIBUTE, _EQUALS, _BARE = (re.compile(p) for p in (r"[a-zA-Z][^ \t\n\f\r/>]*", r"[ \t\n\f\r/]*", r"=?[^ \t\n\f\r/>=]*", r"[ \t\n\f\r]*=[ \t\n\f\r]*", r"[^ \t\n\f\r>]*"))
_HIDDEN_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>]|\Z)", re.I) for tag in HIDDEN_TAGS.split("|")}
SKIP, HIDDEN_PART, OPEN, CLOSE = range(4)
_SVG_END = re.compile("</svg", re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` ends; -1 if it never does. A quote counts only where a value begins."""
    n = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return -1
        if page[at] == ">":
            return at + 1
        at = _ATTRIBUTE.match(page, at).end()
        equals = _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            if page[at : at + 1] in ('"', "'"):
                at = page.find(page[at], at + 1) + 1
                if not at:
                    return -1
            else:
                at = _BARE.match(page, at).end()


def markup(page: str) -> Iterator[tuple[int, int, int, str, str, bool]]:
    """(start, end, kind, tag, attributes, whether it closes itself) of each piece of markup, in page order."""
    at, n = 0, len(page)
    while (at := page.find("<", at)) >= 0:
        usual = _USUAL.match(page, at)
        if usual:
            end, kind, tag, attrs, alone = usual.end(), CLOSE if usual[1] else OPEN, usual[2].lower(), usual[3], bool(usual[4])
        else:
            close = page.startswith("/", at + 1)
            name = _NAME.match(page, at + 1 + close)
            if name:
                end, kind, tag = _tag_end(page, name.end()), CLOSE if close else OPEN, name[0].lower()
                if end < 0:
                    yield at, n, SKIP, "", "", False
                    return
                attrs, alone = page[name.end() : end - 1], page[end - 2] == "/"
            elif close or page[at + 1 : at + 2] in ("!", "?"):
                end = page.find("-->", at + 4) + 3 if page.startswith("<!--", at) else page.find(">", at) + 1
                end = end if end > at else n
                yield at, end, SKIP, "", "", False
                at = end
                continue
            elif at + 1 == n:
                yield at, n, SKIP, "", "", False
                return
            else:  # a sign of the text
                at += 1
                continue
        if kind == OPEN and tag in _HIDDEN_END:
            over = _HIDDEN_END[tag].search(page, end)
            end = page.find(">", over.end()) + 1 or n if over else n
            yield at, end, HIDDEN_PART, tag, attrs, alone
        else:
            yield at, end, kind, tag, attrs, alone
        at = end


@lru_cache(1 << 14)
def _path_places(parent: tuple[int, ...], tag: str, attrs: str) -> tuple[int, ...]:
    """Places of a path: those of the parent's, and of the element's tag and the words of its class, id and role."""
    names = {p.lower() for _, a, b, c in _NAMES.findall(attrs) for p in _PARTS.findall(a or b or c)} if attrs else set()
    return tuple(sorted({*parent, crc32(tag.encode()) % PATH_PLACES, *(crc32(f".{n}".encode()) % PATH_PLACES for n in names)}))


_POINTS = ".,;:!?()[]\"'"


class _WordPlaces(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = place = PATH_PLACES + crc32(word.encode()) % WORD_PLACES
        return place


_WORD_PLACES = _WordPlaces()


class Block:
    __slots__ = ("parts", "path", "depth", "tag", "linked", "size", "text")

    def __init__(self, path: tuple[int, ...], depth: int, tag: str) -> None:
        self.parts, self.path, self.depth, self.tag, self.linked, self.size, self.text = [], path, depth, tag, 0, 0, ""

    def close(self) -> bool:
        """Sets the text; whether there is any."""
        raw = self.parts[0] if len(self.parts) == 1 else "".join(self.parts)
        self.text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        return bool(self.text)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. The title in the head is not text of the page."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    open_at: dict[str, list[int]] = {}  # places of open elements by tag, and of those at block level
    block_at: list[int] = []
    now: Block | None = None
    drawing, last_drawing = False, max((m.start() for m in _SVG_END.finditer(page)), default=-1)

    def pop_to(i: int) -> None:
        while len(stack) > i:
            tag = stack.pop()[0]
            open_at[tag].pop()
            if tag in BLOCK_TAGS:
                block_at.pop()

    def text(a: int, b: int) -> None:
        nonlocal now
        if a < b and not open_at.get("head") and not open_at.get("title"):
            piece = page[a:b]
            if now is None:
                if piece.isspace():
                    return
                now = Block(stack[-1][1], len(stack), stack[-1][0]) if stack else Block((), 0, "")
                out.append(now)
            now.parts.append(piece)
            now.size += b - a
            now.linked += (b - a) * bool(open_at.get("a"))

    at = 0
    for start, end, kind, tag, attrs, alone in markup(page):
        if not drawing:
            text(at, start)
        at = end
        if kind in (SKIP, HIDDEN_PART):
            if kind == HIDDEN_PART and now is not None:
                now.parts.append(" ")
            continue
        if tag == "svg":
            # an element without a content or an end holds no text; another's content is a drawing up to its end or HTML's next block
            drawing = kind == OPEN and not alone and start < last_drawing
            if now is not None:
                now.parts.append(" ")
            continue
        if drawing:
            if kind == CLOSE or tag not in BLOCK_TAGS or tag == "title":
                continue
            drawing = False
        if kind == CLOSE:
            if tag in BLOCK_TAGS:
                now = None
            if open_at.get(tag):
                pop_to(open_at[tag][-1])
            continue
        if tag in BLOCK_TAGS:
            now = None
            kinds = ENDS.get(tag, ()) + (("p",) if tag not in ("option", "body") else ())
            for i in reversed(block_at):
                if stack[i][0] in kinds:
                    pop_to(i)
                if stack[i : i + 1] == [] or stack[i][0] != "p":
                    break
        elif tag == "br" and now is not None:
            now.parts.append(" ")
        if tag not in VOID_TAGS and not alone:
            open_at.setdefault(tag, []).append(len(stack))
            if tag in BLOCK_TAGS:
                block_at.append(len(stack))
            stack.append((tag, _path_places(stack[-1][1] if stack else (), tag, attrs)))
    if not drawing:
        text(at, len(page))
    return [b for b in out if b.close()]


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """A matrix for each page, a row for each block. Counts of words have length one in each row that has words."""
    places: list[int] = []
    words: list[int] = []
    n_path, n_words, ratios = [], [], []
    for b in (b for page in pages for b in page):
        own = [_WORD_PLACES[w.strip(_POINTS)] for w in b.text.lower().split()]
        places += b.path
        words += own
        n_path.append(len(b.path))
        n_words.append(len(own))
        ratios.append((min(math.log1p(b.size) / 8, 2.0), b.linked / max(1, b.size), b.tag[:1] == "h" and len(b.tag) == 2, b.tag == "li", min(b.depth, 12) / 12, b.text[-1] in ".!?"))
    n = len(n_path)
    out = np.zeros((n, INPUTS), np.float32)
    if n:
        out[np.repeat(np.arange(n), n_path), places] = 2.0
        at = np.repeat(np.arange(n) * WORD_PLACES, n_words) + np.array(words, np.int64) - PATH_PLACES
        held = np.bincount(at, minlength=n * WORD_PLACES).reshape(n, WORD_PLACES)
        out[:, PATH_PLACES:-RATIOS] = held / np.maximum(np.sqrt((held * held).sum(axis=1, keepdims=True)), 1)
        out[:, -RATIOS:] = ratios
    ends = np.cumsum([len(page) for page in pages])
    return [out[e - len(page) : e] for e, page in zip(ends, pages)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output for each step. Sequences of a batch are padded and masked."""

    def __init__(self, seed: int = SEED) -> None:
        r, f = np.random.default_rng(seed), np.float32
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (r.normal(0, 1, (INPUTS, 4 * HIDDEN)) * 0.15).astype(f)
            self.p[f"U{d}"] = (r.normal(0, 1, (HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f)
            bias = np.zeros(4 * HIDDEN, f)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p[f"c{d}"] = bias
        self.p["V"], self.p["v"] = (r.normal(0, 1, (2 * HIDDEN, 1)) * 0.2).astype(f), np.zeros(1, f)

    def _run(self, z: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """z: steps x batch x 4 HIDDEN. A masked step hands its state on."""
        steps, n, _ = z.shape
        h, c, out, tape = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p[f"U{d}"]
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            cn = f * c + i * g
            tc = np.tanh(cn)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, cn, c)
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        hf, tf = self._run(x @ self.p["Wf"] + self.p["cf"], mask, "f", keep)
        hb, tb = self._run(x @ self.p["Wb"] + self.p["cb"], mask, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return (both @ self.p["V"])[:, :, 0] + self.p["v"], (both, tf, tb)

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logit, (both, tf, tb) = self.forward(x, mask, keep=True)
        p, n = _sigmoid(logit), mask.sum()
        loss = -float((np.log(np.where(y, p, 1 - p) + 1e-9) * mask).sum() / n)
        d = ((p - y) * mask / n)[:, :, None].astype(np.float32)
        grad = {"V": (both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1)), "v": d.sum(axis=(0, 1))}
        dh_all = d @ self.p["V"].T
        for name, tape, part in (("f", tf, dh_all[:, :, :HIDDEN]), ("b", tb, dh_all[:, :, HIDDEN:])):
            u = self.p[f"U{name}"]
            da_all, du = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t, h, c, i, f, o, g, tc, m in reversed(tape):
                dh = dh + part[t]
                dcn = dc + dh * o * (1 - tc * tc)
                da = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dh * tc * o * (1 - o), dcn * i * (1 - g * g)], axis=1) * m
                da_all[t] = da
                du += h.T @ da
                dh, dc = da @ u.T + dh * ~m, np.where(m, dcn * f, dc)
            grad[f"U{name}"], grad[f"c{name}"] = du, da_all.sum(axis=(0, 1))
            grad[f"W{name}"] = x.reshape(-1, INPUTS).T @ da_all.reshape(-1, 4 * HIDDEN)
        return loss, grad

    def label(self, pages: list[np.ndarray], at_once: int = 128) -> list[np.ndarray]:
        """Probability of main text for each block of each page. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            take = max(1, min(at_once, 20_000 // longest))
            group, order = order[-take:], order[:-take]
            x, mask = padded([pages[i] for i in group])
            p = _sigmoid(self.forward(x, mask)[0])
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


#: Containers that the training grammar uses. Fixed values.
MAIN_BOXES = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div id="main"', 'div class="text"', "div", "section", 'div class="page"']
NOISE_BOXES = {
    "menu": ["nav", 'ul class="nav"', 'div class="menu"', 'div id="navigation"', 'div class="breadcrumbs"', 'div class="navbar"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="top"'],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"'],
    "sidebar": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"'],
    "notice": ['div class="cookie"', 'div class="notice"', 'div class="banner"', 'div class="popup"', 'div id="consent"', 'div class="alert"', 'div class="cookie-notice"', 'div role="dialog"'],
    "advert": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="promo"', 'div class="sponsored"', 'div id="ad"', 'aside class="ad"'],
    "form": ["form", 'form class="newsletter"', 'form class="search"', 'div class="login"', 'div class="subscribe"'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comments"', 'ol class="commentlist"', 'div class="comment-list"', 'section id="comments"', 'div class="responses"'],
}
NOISE_WORDS = {
    "menu": "home about contact news sports archive login search topics more",
    "header": "the daily online news welcome site search subscribe",
    "footer": "copyright all rights reserved privacy terms imprint contact",
    "sidebar": "related popular recent tags read more latest posts",
    "notice": "we use cookies accept this site consent agree notice privacy",
    "advert": "advertisement sponsored buy now offer sale save deal shop",
    "form": "name email subscribe send password submit search your",
    "comments": "reply comment says posted by great thanks agree wrote",
}


def made_page(r: Random) -> tuple[str, list[bool]]:
    """A page of the training grammar and whether each of its blocks is main text."""
    out, labels = [], []
    pick = lambda xs: xs[int(r.random() * len(xs))]
    parts = "the an er in on ed re ou ti es or en sch ein ge be ung que le aux tion de la os ar ción ue mar del".split()
    word = lambda: "".join(pick(parts) for _ in range(r.randrange(1, 5)))

    def words(n: int, common: str = "") -> str:
        own = common.split()
        xs = [pick(own) if own and r.random() < 0.5 else word() for _ in range(n)]
        if r.random() < 0.06:
            xs = xs[: r.randrange(1, 4)] + [xs[-1]] * (n - 1)
        if r.random() < 0.08:
            xs = [x + pick(["!!", "***", "$$$", "&amp;&amp;", " |"]) for x in xs]
        return " ".join(xs)

    def say(tag: str, body: str, main: bool) -> None:
        end = f"</{tag.split()[0]}>" if r.random() < 0.93 or tag not in ("p", "li") else ""
        out.append(f"<{tag}>{body}{end}")
        labels.append(main)

    def sentence(low: int, high: int, common: str = "") -> str:
        return words(r.randrange(low, high), common).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def inline(body: str) -> str:
        if r.random() < 0.3:
            a, b, c = body.partition(" ")
            tag = pick(["b", "em", 'a href="/x"', "strong", "span"])
            body = f"<{tag}>{a}</{tag.split()[0]}>{b}{c}" if r.random() < 0.8 else f"<{tag}>{body}"
        return body + ("<br>" if r.random() < 0.1 else "")

    def noise(kind: str, box: str | None = None) -> None:
        box = box or pick(NOISE_BOXES[kind])
        tag, common = box.split()[0], NOISE_WORDS[kind] if r.random() < 0.6 else ""
        if r.random() < 0.25:
            out.append(f"<!-- {kind} -->")
        if kind in ("advert", "notice", "footer", "header") and r.random() < 0.5:
            return say(box, sentence(2, 40, common), False)
        out.append(f"<{box}>")
        if kind == "menu" or kind == "sidebar" and r.random() < 0.5:
            listed = tag != "ul"
            out.append("<ul>" * listed)
            for _ in range(r.randrange(2, 9)):
                say("li", f'<a href="/{word()}">{words(r.randrange(1, 4), common)}</a>', False)
            out.append("</ul>" * listed)
        elif kind == "comments":
            for _ in range(r.randrange(1, 6)):
                inner = pick(['div class="comment"', "li", 'article class="comment"', "div"])
                out.append(f"<{inner}>")
                if r.random() < 0.5:
                    say(pick(["h4", 'div class="author"', 'p class="meta"']), words(2, common), False)
                for _ in range(r.randrange(1, 3)):
                    say("p", inline(sentence(3, 60, common)), False)
                out.append(f"</{inner.split()[0]}>")
        elif kind == "form":
            for _ in range(r.randrange(1, 4)):
                say(pick(["label", "p", "div"]) if tag != "form" else pick(["p", "div"]), words(r.randrange(1, 5), common) + '<input name="x">', False)
            if r.random() < 0.5:
                say("div", "<button>" + words(1, common) + "</button>", False)
        else:
            if r.random() < 0.4:
                say(pick(["h2", "h3", "h4"]), words(r.randrange(1, 5), common), False)
            for _ in range(r.randrange(1, 4)):
                say(pick(["p", "p", "div"]), inline(sentence(3, 50, common)), False)
        out.append(f"</{tag}>")

    out.append('<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8"><title>' + words(4) + "</title><style>p{margin:0}</style></head><body>")
    for kind in [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if r.random() < (0.75 if k == "menu" else 0.4)]:
        noise(kind)
    box = pick(MAIN_BOXES) if r.random() < 0.6 else "article"
    wrapped = r.random() < 0.2
    out.append("<div class=\"wrap\">" * wrapped + f"<{box}>")
    if r.random() < 0.75:
        say("h1", sentence(2, 14), True)
    for _ in range(r.randrange(1, 12) if r.random() < 0.95 else r.randrange(12, 70)):
        x = r.random()
        if x < 0.78:
            say("p", inline(sentence(1 if r.random() < 0.15 else 5, 120)), True)
        elif x < 0.84:
            say(pick(["h2", "h3"]), sentence(1, 8), True)
        elif x < 0.88:
            out.append("<ul>")
            for _ in range(r.randrange(1, 5)):
                say("li", sentence(2, 20), True)
            out.append("</ul>")
        elif x < 0.91:
            say(pick(["blockquote", "pre", "div", "figcaption"]), sentence(3, 40), True)
        else:
            noise(pick(["advert", "advert", "notice", "form", "sidebar"]))
    out.append(f"</{box.split()[0]}>" + "</div>" * wrapped)
    for kind in [k for k in ("comments", "sidebar", "advert", "form", "notice", "menu", "footer") if r.random() < (0.75 if k == "footer" else 0.3)]:
        noise(kind)
    out.append("</body></html>" if r.random() < 0.9 else "")
    return "".join(out), labels


@lru_cache(2)
def trained(seed: int = SEED, pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """The network, trained once in this process. Pages whose blocks the reader finds in other numbers than the grammar wrote are left out."""
    made, r, net = Random(seed), np.random.default_rng(seed), Labeller(seed)
    data = []
    for _ in range(pages):
        page, labels = made_page(made)
        blocks = blocks_of(page)
        if blocks and len(blocks) == len(labels):
            data.append((vectors([blocks])[0], np.array(labels)))
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        order = sorted(r.permutation(len(data)), key=lambda i: len(data[i][0]) // 8)
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        for b in r.permutation(len(batches)):
            x, mask = padded([data[i][0] for i in batches[b]])
            y = np.zeros(mask.shape, bool)
            for j, i in enumerate(batches[b]):
                y[: len(data[i][1]), j] = data[i][1]
            _, grad = net.gradients(x, y, mask)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            size = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grad.values()))) / 2)
            for k, w in net.p.items():
                g = grad[k].reshape(w.shape).astype(np.float32) / size
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.005 * (g * g - m2[k])
                w -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.995**step)) + 1e-7)
    return net


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    scores = net.label(vectors(blocks))
    return ["\n\n".join(x.text for x, s in zip(b, p) if s >= 0.5) for b, p in zip(blocks, scores)]


def extract(pages: DataFrame, body: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; one pass without a shuffle. The network travels with the tasks (under 300 kB).

    About a megabyte of pages is worked on at once; a longer page is worked on alone.
    """
    net = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = large(batch.column(2))
            for lo, hi in row_ranges(column):
                texts = main_texts(column.slice(lo, hi - lo).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(body), F.lit("")).alias("html")).mapInArrow(streamed(run), "page_id long, url string, text string, n_chars long")
