"""The near-copy stage against a brute force with five words and 0.8."""

import random

import corpus_pipeline as C

from .conftest import prose
from .test_copies import LOWER, WORD


def left(docs, k=5, percent=80):
    """Ids of the documents with the smallest id of each component."""
    sets = []
    for _, t in docs:
        w = [x.translate(LOWER) for x in WORD.findall(t)]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)})
    name = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if name[i] != name[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    low = {}
    for (d, _), c in zip(docs, name):
        low[c] = min(low.get(c, d), d)
    return set(low.values())


def test_near_copies_of_five_words(spark):
    r = random.Random(8)
    docs = []
    for n, changed in ((50, 1), (100, 2), (200, 4), (400, 8), (50, 2), (100, 4), (200, 9)):
        base = prose(r, n).split()
        near = list(base)
        for i in range(changed):
            near[10 + i * (n // changed)] = f"other{n}x{changed}x{i}"
        docs += [" ".join(base), " ".join(near)]
    docs += [prose(r, r.randrange(3, 200)) for _ in range(20)]
    for _ in range(60):
        own = r.choice(docs[:14]).split()
        for _ in range(r.choice([0, 1, 2, 4, 6])):
            own[r.randrange(len(own))] = prose(r, 1) + "x"
        docs.append(" ".join(own))
    docs = list(enumerate(docs))
    expected = left(docs)
    assert expected != left(docs, 3, 90) and expected.isdisjoint({1, 3, 5, 7})
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {x["doc_id"] for x in C.near_copies(spark, table, "").collect()} == expected
