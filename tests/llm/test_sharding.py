import zlib
from collections import Counter

from pyspark.sql import functions as F

from emberlog.llm import sharding as S


def deal(spark, tree, n=4000):
    keys = spark.range(n).select(F.col("id"), F.col("id").cast("string").alias("k"))
    return {r["id"]: (r["region"], r["rack"], r["shard"]) for r in S.descend(keys, F.col("k"), tree).select("id", "region", "rack", "shard").collect()}


def test_every_row_has_a_slot(edge, edge_rows):
    out = S.shard_documents(edge).collect()
    assert len(out) == len(edge_rows)
    for shard in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], set()).add(r["shard"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    assert all(len(s) == 1 for s in by_id.values())
    found = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert found == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in edge_rows)


def test_repeated_rows(spark, monkeypatch):
    """A third of all rows alike, and one id under many texts."""
    monkeypatch.setattr(S, "RUN", 100)
    docs = spark.range(1500).select(F.when(F.col("id") < 500, F.lit(7)).when(F.col("id") < 900, F.lit(None).cast("long")).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 500, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    out = S.shard_documents(docs).collect()
    assert len(out) == 1500 and sum(r["doc_id"] == 7 for r in out) == 500
    for shard in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_empty(empty):
    assert S.shard_documents(empty).collect() == []


def test_growth_moves_rows_only_into_the_new_shard(spark):
    for n in (1, 5, 16, 17):
        tree = S.HashTree.uniform(n)
        a, b = deal(spark, tree, 2000), deal(spark, tree.grow(), 2000)
        moved = [i for i in a if a[i][2] != b[i][2]]
        assert moved and all(b[i][2] == n for i in moved)
        assert abs(len(moved) - 2000 / (n + 1)) < 150


def test_parts_follow_weights_and_movement_is_confined(spark):
    tree = S.HashTree.uniform(16)
    a = deal(spark, tree)
    assert all(150 < c < 350 for c in Counter(s for _, _, s in a.values()).values())
    heavy = tree.reweigh(0, 3.0)
    b = deal(spark, heavy)
    assert 1.9 < Counter(s for _, _, s in b.values())[0] / Counter(s for _, _, s in a.values())[0] < 3.2
    for i in a:
        if a[i][0] == b[i][0] == 1:  # region 1 has no changed weight
            assert a[i] == b[i]
        if a[i][0] != b[i][0]:
            assert b[i][0] == 0  # keys move only towards the heavier region
    gone = deal(spark, tree.reweigh(3, 0.0))
    assert all(s != 3 for _, _, s in gone.values())
