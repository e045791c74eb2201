import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import decontaminate as D
from emberlog.llm import jaccard_join as J
from emberlog.llm.components import roots
from emberlog.llm.textblock import buffers, large

from .conftest import prose, rows, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def brute(docs):
    sets = []
    for _, t in docs:
        w = [x.translate(LOWER) for x in WORD.findall(t or "")]
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        low[r] = d if low.get(r) is None else min(low[r], d if d is not None else low[r])
    return [(d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)]


def test_components_match_brute_force(edge, edge_rows, empty):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(edge).collect())
    assert got == Counter(brute([(i, t) for i, t, _ in edge_rows]))
    assert J.jaccard_components(empty).collect() == []


def test_clusters_with_shared_passages(spark):
    r = random.Random(4)
    docs, passage = [], prose(r, 40)
    for c in range(6):
        base = prose(r, r.choice([30, 100, 200])).split()
        for _ in range(25):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 9])):
                own[r.randrange(len(own))] = prose(r, 1) + "x"
            if r.random() < 0.2:
                own = own[: len(own) - r.randrange(1, 6)]
            docs.append(" ".join(own))
    docs += [prose(r, 10) + " " + passage + " " + prose(r, 10) for _ in range(40)] + [passage] * 5 + [passage + " " + prose(r, 2) for _ in range(20)]
    r.shuffle(docs)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in J.jaccard_components(df).collect())
    expected = brute(list(enumerate(docs)))
    assert len({c for _, _, c in expected}) < len(docs) - 60
    assert got == Counter(expected)


def test_one_of_each(edge, edge_rows):
    kept = J.one_of_each(edge)
    assert kept.columns == edge.columns
    found = Counter(r["doc_id"] for r in kept.collect())
    expected = Counter()
    seen = set()
    for (d, n, c), (_, t, _) in zip(brute([(i, t) for i, t, _ in edge_rows]), edge_rows):
        group = ("c", c) if n else ("d", d, t or "")
        if group not in seen:
            seen.add(group)
            expected[c if n else d] += 1
    assert found == expected


def test_roots(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(500, 500)]
    got = {x["node"]: x["root"] for x in roots(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert roots(spark.createDataFrame([], "a long, b long")).collect() == []


def typo(r, text, edits):
    out = list(text)
    for _ in range(edits):
        p = r.randrange(len(out))
        x = r.random()
        if x < 0.4:
            out[p] = r.choice("qwxz")
        elif x < 0.7:
            del out[p]
        else:
            out.insert(p, r.choice("qwxz"))
    return "".join(out)


def distance(p, t):
    """Least edits of p within any part of t."""
    row = [0] * (len(t) + 1)
    for a in p:
        new = [row[0] + 1]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_finds_all_within_the_budget(spark, empty):
    r = random.Random(6)
    items = [(i, prose(r, r.choice([12, 20, 30]))) for i in range(25)] + [(90, None), (91, "ab"), (92, ""), (3, "another text under the same number, long enough"), (None, "no id at all for this one")]
    docs, planted = [], {}
    for d in range(120):
        text = prose(r, 100)
        if d % 3 == 0:
            i, body = items[r.randrange(25)]
            k = int(D.RATE * len(body)) if len(body) < 1.5 * D.PROBE else 0
            body = typo(r, body, r.randrange(0, max(1, k - 1)))
            w = text.split()
            j = r.randrange(len(w))
            text = " ".join(w[:j]) + r.choice([" ", "\n", "  \t"]) + body.translate(UPPER) + " " + " ".join(w[j:])
            planted[d] = i
        docs.append((d, text))
    docs += [(200, None), (201, ""), (202, "short"), (203, items[0][1]), (203, items[0][1]), (None, items[1][1])]
    df = spark.createDataFrame(rows([(i, t, None) for i, t in docs]), SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.contaminated(df, bench).collect()
    found = {(x["doc_id"], x["item_id"]) for x in out}
    assert {(d, i) for d, i in planted.items()} <= found and {(203, 0), (None, 1)} <= found
    clean = {d for d, _ in docs[:120]} - set(planted)
    assert not clean & {d for d, _ in found}
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", (t or "").translate(LOWER))
    texts = {d: plain(t) for d, t in docs}
    bodies = dict(items[:25])
    for x in [o for o in out if o["doc_id"] is not None and o["item_id"] != 3 and len(bodies[o["item_id"]]) < 1.5 * D.PROBE][:12]:
        assert x["n_edits"] == distance(plain(bodies[x["item_id"]]), texts[x["doc_id"]])
        part = texts[x["doc_id"]].encode()[x["start"] : x["start"] + x["n_bytes"]].decode()
        assert distance(plain(bodies[x["item_id"]]), part) == x["n_edits"]
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {d for d, _ in docs if d is not None} - {d for d, _ in found}
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(df, none).collect() == [] and D.drop_contaminated(df, none).count() == len(docs)
    assert D.contaminated(empty, bench).collect() == [] and D.drop_contaminated(empty, bench).collect() == []


def test_benchmark_in_blocks(spark):
    r = random.Random(8)
    items = [(i, prose(r, 20)) for i in range(30)]
    lists = list(D.blocks(spark.createDataFrame(items, "item_id long, text string"), block_bytes=500))
    assert len(lists) > 3 and sorted(x for own in lists for x in own) == items


def test_plain_form():
    data, off = buffers(large(pa.array(["A  b\n\tc", "  x", "", "É "])))
    out, edge = D.plain(data, off)
    assert [out[a:b].tobytes().decode() for a, b in zip(edge, edge[1:])] == ["a b c", " x", "", "É "]


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 100, 101])
def test_prefix_is_long_enough(n):
    p = J.prefix_length(n)
    assert 1 <= p <= n and n - p + 1 <= 0.9 * n + 1e-9 + 1
    assert n - (p - 1) >= 0.9 * n - 1e-9 > n - p - 1e-9 or n == p


def test_size_and_position_filter(spark):
    df = spark.createDataFrame([(100, 0, 100, 0), (100, 0, 112, 0), (100, 6, 100, 0), (100, 5, 100, 5)], "n int, a int, m int, b int")
    assert [r[0] for r in df.select(J.could_link(F.col("n"), F.col("a"), F.col("m"), F.col("b"))).collect()] == [True, False, False, True]


def test_matches_sql(spark, edge_rows, tmp_path):
    """The query's SQL, on distinct ids."""
    import duckdb

    docs = [(i, t) for i, t in {i: t for i, t, _ in edge_rows if i is not None}.items()]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = J.jaccard_components(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    names = ", ".join(out.columns)
    assert Counter(map(tuple, out.collect())) == Counter(con.execute(f"SELECT {names} FROM ({J.oracle_sql()})").fetchall())


def test_template_texts_make_few_pairs(spark, monkeypatch):
    """Texts that differ in one word and are not similar enough share almost all shingles, but none early enough to be indexed."""
    made = []
    seen = J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, *a: made.append(pairs.count()) or seen(pairs, *a))
    r = random.Random(2)
    base = prose(r, 42).split()
    docs = []
    for i in range(600):
        own = list(base)
        own[r.randrange(3, 39)] = f"own{i}"
        docs.append((i, " ".join(own)))
    got = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(x["doc_id"], x["component_id"]) for x in got.collect()} == {(i, c) for i, _, c in brute(docs)}
    assert sum(made) <= 2 * len(docs)


def test_salted_join_splits_hot_keys(spark):
    from emberlog.llm.skew import salted_join

    left = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)] + [(None, -1)], "k long, a long")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (950, "z"), (None, "n"), (7777, "m")], "k long, b string")
    joined = salted_join(left, right, ["k"], 50)
    assert sorted(map(tuple, joined.collect())) == sorted([(1, i, b) for i in range(900) for b in "xy"] + [(950, 950, "z")])
    assert salted_join(left.limit(0), right, ["k"]).count() == 0
