"""Matches against brute force where a benchmark shares a template, and for short items, long texts and several blocks."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import decontaminate as D
from emberlog.llm.textblock import buffers, large

from .conftest import prose
from .test_copies import distance


def found(items, texts):
    index = D.ProbeIndex.build(items)
    own, item, edits, left, length = index.find(*D.plain(*buffers(large(pa.array(texts)))))
    return {(int(a), int(b)): int(c) for a, b, c in zip(own, item, edits)}


def expected(items, texts):
    """Least edits of any probe of an item within a text, where that is within the probe's budget."""
    out = {}
    for number, body in items:
        for p in D.cut(np.frombuffer(body.encode(), np.uint8)):
            k = int(D.RATE * len(p))
            while k and len(p) + 1 - D.Q - k * D.Q < D.LEAST:
                k -= 1
            for i, t in enumerate(texts):
                n = distance(p.tobytes(), t.encode())
                if n <= k:
                    out[i, number] = min(n, out.get((i, number), n))
    return out


@pytest.mark.parametrize("share", [30, 120, 260])
def test_items_with_a_template(share, monkeypatch):
    monkeypatch.setattr(D, "COMMON", 3)
    monkeypatch.setattr(D, "POSTINGS", 500)  # many slices
    r = random.Random(share)
    template = prose(r, 80)[:share]
    items = [(i, f"{template} {prose(r, 20)[:90]}".strip()) for i in range(12)]
    texts = [prose(r, 30) + " " + template + " " + prose(r, 20) for _ in range(4)]
    for i in (0, 3, 7):
        body = list(items[i][1])
        for _ in range(4):
            body[r.randrange(len(body))] = r.choice("qxz")
        texts.append(prose(r, 10) + " " + "".join(body) + " " + prose(r, 10))
    texts += ["", template, items[5][1]]
    assert found(items, texts) == expected(items, texts)


def test_short_items_and_long_texts():
    r = random.Random(1)
    long = " ".join(prose(r, 3000) for _ in range(30))
    item = prose(r, 40)
    texts = ["abc", "x abc", "xabc abcx", "abc d", "ab c", "", long + " " + item + " " + long, long]
    items = [(1, "abc"), (2, " ABC \n d"), (3, ""), (4, None), (5, item), (5, item)]
    got = found(items, texts)
    assert {k for k in got if k[1] < 5} == {(0, 1), (1, 1), (3, 1), (3, 2)} and {k for k in got if k[1] == 5} == {(6, 5)}


def test_blocks_give_what_one_gives(spark, monkeypatch):
    r = random.Random(9)
    items = [(i, prose(r, 30)) for i in range(20)]
    docs = [(i, prose(r, 30) + " " + items[i][1] if i % 3 == 0 else prose(r, 60)) for i in range(20)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    one, kept = sorted(D.contaminated(df, bench).collect()), sorted(D.drop_contaminated(df, bench).collect())
    cut = D.blocks
    monkeypatch.setattr(D, "blocks", lambda b: cut(b, block_bytes=600))
    assert sorted(D.contaminated(df, bench).collect()) == one and sorted(D.drop_contaminated(df, bench).collect()) == kept
    assert len(one) == 7 and len(kept) == 13


#: Megabytes of a process that scans templated text against many items with the same template.
PROBE = """
import random, resource, sys
import pyarrow as pa
from emberlog.llm import decontaminate as D
from emberlog.llm.textblock import buffers, large, row_ranges
r = random.Random(2)
word = lambda: "".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))
prose = lambda n: " ".join(word() for _ in range(n))
template = prose(22)[:110]
index = D.ProbeIndex.build([(i, template + " " + prose(60)) for i in range(2000)])
texts = large(pa.array([prose(60) + " " + template + " " + prose(60) for _ in range(int(sys.argv[1]))]))
before, rows = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 0
for lo, hi in row_ranges(texts):
    rows += len(index.find(*D.plain(*buffers(texts.slice(lo, hi - lo))))[0])
print(rows, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024 - before)
"""


def test_memory_does_not_grow_with_texts_and_items():
    rows, mb = subprocess.run([sys.executable, "-c", PROBE, "200"], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(rows) == 0 and float(mb) < 400
