import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import html_extract as H
from emberlog.llm import language_id as L
from emberlog.llm import lm_score as M
from emberlog.llm.keycounts import bin_of
from emberlog.llm.runtime import crc32_of_id
from emberlog.llm.textblock import large, pack_counts, pack_keys, unpack_counts, unpack_keys, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def test_words_and_packing(edge_rows):
    texts = [t for _, t, _ in edge_rows]
    w = words_of(large(pa.array(texts)))
    own = [words(t) for t in texts]
    assert w.count.tolist() == list(map(len, own))
    flat = [x for o in own for x in o]
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat)) == len(set(w.hash.tolist()))
    keys = np.unique(w.hash)
    assert (unpack_keys(pack_keys(keys)) == keys).all() and len(unpack_keys(b"")) == 0
    assert unpack_counts(pack_counts(np.array([0, 1, 2**32 - 1]))).tolist() == [0, 1, 2**32 - 1]


def brute_scores(docs, order):
    """Token-at-a-time walk of the automaton: arcs, failure arcs and a carried state."""
    train = [["<s>", *words(t), "</s>"] for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts = {k: Counter(tuple(x[j : j + k]) for x in train for j in range(len(x) - k + 1) if k > 1 or j) for k in range(1, order + 1)}
    starts = len(train)
    total, types = sum(counts[1].values()), len(counts[1])
    unknown = max(1, sum(v == 1 for v in counts[1].values()))
    big_k = {}
    for k in range(2, order + 1):
        c = np.array(list(counts[k - 1].values()) or [0])
        b = bin_of(c)
        big_k[k] = M.matched_k({int(x): (int((b == x).sum()), int(c[b == x].sum())) for x in np.unique(b) if x}, sum(v == 1 for v in counts[k].values()))
    context = lambda h: starts if h == ("<s>",) else counts[len(h)][h]

    def p(h, w):
        if not h:
            return (counts[1][(w,)] or unknown) / (total + unknown)
        return (counts[len(h) + 1][(*h, w)] + big_k[len(h) + 1] * p(h[1:], w)) / (context(h) + big_k[len(h) + 1]) if context(h) else p(h[1:], w)

    out = []
    for i, t in docs:
        state, score, base = ("<s>",)[: order - 1], 0.0, 0.0
        for w in [*words(t), "</s>"]:
            base += math.log10((counts[1][(w,)] + 0.1) / (total + 0.1 * (types + 1)))
            while state and not counts[len(state) + 1][(*state, w)]:
                if context(state):
                    score += math.log10(big_k[len(state) + 1] / (context(state) + big_k[len(state) + 1]))
                state = state[1:]
            score += math.log10(p(state, w))
            state = (*state, w)[-(order - 1) :] if order > 1 else ()
            while state and not context(state):
                state = state[1:]
        out.append((i, len(words(t)) + 1, sum(counts[1][(w,)] > 0 for w in [*words(t), "</s>"]), total, round(base, 6), round(score, 6)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_match_a_walk(edge, edge_rows, order):
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(10)) == 0
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in M.score(edge, held_out, order=order).collect())
    assert got == Counter(brute_scores([(i, t) for i, t, _ in edge_rows], order))


def test_lm_empty_tables_and_no_training(spark, empty, edge):
    assert M.score(empty, F.lit(False)).collect() == []
    out = M.score(edge.where("doc_id in (1, 2)"), F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["score"]) for r in out] == [(0, 0, 0.0)] * 2


def test_lm_sums_to_one():
    model = M.Model([(1, 1, 3, 3), (1, 5, 1, 5), (2, 1, 4, 4), (2, 2, 2, 4)])
    counts = [np.array([1, 1, 1, 5, 0]), np.array([1, 0, 1, 0, 0])]  # one context seen twice: its arcs and all it leaves to order 1
    contexts = np.full(5, 2.0)
    p1 = np.where(counts[0] > 0, counts[0], model.unknown) / (model.total + model.unknown)
    assert abs(p1.sum() - 1) < 1e-12
    assert abs(((counts[1] + model.k[2] * p1) / (contexts + model.k[2])).sum() - 1) < 1e-12


def test_language_id(spark, edge, empty):
    r = random.Random(1)
    own = {"aa": "the and ing er of".split(), "bb": "sch ung ein der ß".split(), "cc": "ção os de ñ que".split()}
    rows = [(i, " ".join("".join(r.choice(own[g]) for _ in range(3)) for _ in range(r.randrange(5, 200))), g) for i in range(240) for g in [r.choice(list(own))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) == 2
    net = L.fit(docs, ~held_out)
    assert net.languages == ["aa", "bb", "cc"]
    out = {x["doc_id"]: x for x in L.predict(docs, net).collect()}
    wrong = [i for i, _, g in rows if out[i]["lang_pred"] != g]
    assert len(wrong) <= 5 and all(0 <= x["score"] <= 1 for x in out.values())
    odd = {(x["doc_id"], x["lang_pred"]) for x in L.predict(edge, net, keep=["doc_id", "n"]).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (11, "und")} <= odd
    assert L.predict(edge, net).count() == edge.count()
    assert L.predict(empty, net).collect() == [] and L.fit(empty, F.lit(True)) is None
    assert {x["lang_pred"] for x in L.predict(edge, None).collect()} == {"und"}
    again = L.fit(docs.repartition(5), ~held_out)
    assert (again.dense == net.dense).all()


def test_windows_cover_whole_texts():
    windows, first, filled = L.windows_of(large(pa.array(["A" * 300, "", "b" * 128, "c"])))
    assert first.tolist() == [0, 3, 3, 4, 5] and filled.tolist() == [128, 128, 44, 128, 1]
    assert (windows[:3].ravel()[:300] == ord("a")).all() and not windows[:3].ravel()[300:].any()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><div class="menu"><ul><li><a href="/">home<li><a href="/">news</ul></div></header>
<div class="cookie">We use cookies. <button>Accept</button></div><article><h1>Big &amp; bold</h1><p>First  <b>para</b>graph &lt;1&gt;<br>goes on. It has some more words.<p>Second one, unclosed
<div class="ad">Buy now</div><p>Third &copy; one ends it here.</p></article><section class="comments"><div class="comment"><p>Great article, thanks!</p></div></section><footer>&copy; all rights reserved</footer></body></html>"""


def test_html_extraction(spark):
    pages = [(1, "u1", PAGE, "x"), (2, None, None, "x"), (3, "u3", "", "x"), (4, "u4", "no markup at all, only a line of text.", "x"), (5, "u5", "<p>cut off <b>in a ta", "x"), (6, "u6", PAGE[: PAGE.index("Third") + 9] + "&am", "x"), (1, "u1", PAGE, "x"), (7, "u7", "<article>" + "<p>A paragraph of the text, one of many.</p>" * 3000 + "</article>", "x")]
    out = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert got[1]["text"] == "Big & bold\n\nFirst paragraph <1> goes on. It has some more words.\n\nSecond one, unclosed\n\nThird © one ends it here."
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["url"] is None
    assert got[6]["text"].endswith("\n\nThird &co&am")
    assert got[7]["text"].count("\n\n") == 2999
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_labeller_on_unseen_pages():
    net, r, right, total = H.trained(), random.Random(12345), 0, 0
    for _ in range(150):
        page, labels = H.made_page(r)
        blocks = H.blocks_of(page)
        if blocks and len(blocks) == len(labels):
            right += int(((net.label(H.vectors([blocks]))[0] >= 0.5) == np.array(labels)).sum())
            total += len(labels)
    assert total > 1500 and right / total > 0.985


def test_labeller_gradients():
    net = H.Labeller(3)
    r = np.random.default_rng(0)
    x, mask = r.normal(0, 1, (5, 3, H.INPUTS)).astype(np.float32), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y = r.random((5, 3)) < 0.5
    _, grad = net.gradients(x, y, mask)
    for name in ("Uf", "Wb", "cf", "V"):
        w, g = net.p[name], grad[name].reshape(net.p[name].shape)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[at], 1e-2
        w[at] = old + e
        up = net.gradients(x, y, mask)[0]
        w[at] = old - e
        down = net.gradients(x, y, mask)[0]
        w[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 0.05 * abs(g[at]) + 1e-4
