import numpy as np

from emberlog.llm import html_extract as H


def vector(page):
    return H.vectors([H.blocks_of(page)])[0]


def test_every_word_of_a_block_is_read():
    start = " ".join(f"word{i}" for i in range(60))
    rows = [vector(f"<div>{start} {tail}.</div>")[0, H.PATH_PLACES : -H.RATIOS] for tail in ("reply comment says", "cookies accept agree")]
    assert not np.array_equal(*rows)
    again = vector("<div>one two one</div>")[0, H.PATH_PLACES : -H.RATIOS]
    assert np.allclose(sorted(again[again > 0]), [5**-0.5, 2 * 5**-0.5])
    assert len(H.vectors([[]])[0]) == 0


def texts(page):
    return [b.text for b in H.blocks_of(page)]


def test_drawings_and_fallbacks_drop_nothing_else():
    for odd in ('<svg class="i"/>', '<svg class="i">', "<math/>", "<noscript>", "<object>", "<canvas>", '<svg><path d="M0"/></svg>', "<svg><title>t</title><text>x</text></svg>", "<svg><svg/>"):
        assert texts(f"<p>one</p>{odd}<p>two</p>") == ["one", "two"], odd
    assert texts("<svg><p>one</p><svg><g>x</g></svg><p>two</p>") == ["one", "two"]
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["if x=2 holds"]
    assert texts('<p>see <object data="a"><em>the fallback</em></object> here</p>') == ["see the fallback here"]
    for tag in ("script", "style", "template", "iframe", "textarea"):
        assert texts(f"<p>one</p><{tag}>x</{tag}><p>two</p><{tag}>three") == ["one", "two"], tag
