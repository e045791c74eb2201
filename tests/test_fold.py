import pytest
from pyspark.sql import functions as F

from emberlog.functions import entry_size, has_prefix
from emberlog.operators import as_of, compacted, get, get_many, merge_runs, newest_wins, scan, visible
from emberlog.schema import ENTRY


def entries(spark, rows):
    return spark.createDataFrame([(k, v, v is None, s) for k, v, s in rows], ENTRY)


def pairs(df):
    return {r["key"]: bytes(r["value"]) for r in df.collect()}


def run_of(spark, items):
    return entries(spark, [(f"/key/{k}", v, 0) for k, v in items])


def states(df):
    return {r["key"]: None if r["deleted"] else bytes(r["value"]) for r in df.collect()}


def test_tombstone_ends_the_search(spark):
    e = entries(spark, [("1", b"hello", 1), ("2", b"world", 2), ("2", None, 3), ("3", b"", 4), ("4", None, 5), ("4", b"again", 6), ("gone", None, 7)])
    assert pairs(scan(e)) == {"1": b"hello", "3": b"", "4": b"again"}
    assert get(e, "2").count() == 0
    assert pairs(get(e, "3")) == {"3": b""}


def test_prefixes_are_plain_text(spark):
    e = entries(spark, [("a_b1", b"x", 1), ("axb1", b"y", 2), ("a%b", b"z", 3), ("", b"empty", 4), ("￿", b"u", 5), ("\U0001f600", b"v", 6)])
    assert pairs(scan(e, "a_b")) == {"a_b1": b"x"}
    assert pairs(scan(e, "a%")) == {"a%b": b"z"}
    assert len(pairs(scan(e))) == 6
    assert pairs(scan(e, "/items/")) == {}
    assert [r["key"] for r in scan(e).orderBy("key").collect()] == ["", "a%b", "a_b1", "axb1", "￿", "\U0001f600"]


def test_earlier_run_wins(spark):
    one = run_of(spark, [(i, bytes([i])) for i in range(10)])
    two = run_of(spark, [(i, None) for i in range(0, 10, 2)])
    assert len(states(visible(merge_runs([one, two])))) == 10
    assert sorted(states(visible(merge_runs([two, one])))) == [f"/key/{i}" for i in (1, 3, 5, 7, 9)]
    assert states(visible(two)) == {}


def test_three_levels_keep_tombstones(spark):
    l2 = run_of(spark, [(1, b"\0\1"), (2, b"\0\2"), (3, b"\0\3")])
    l1 = run_of(spark, [(1, None), (4, b"\0\4"), (5, b"\0\5")])
    l0 = run_of(spark, [(3, None), (4, None), (6, b"\0\6")])
    upper = compacted([l0, l1], final=False)
    assert states(upper) == {"/key/1": None, "/key/3": None, "/key/4": None, "/key/5": b"\0\5", "/key/6": b"\0\6"}
    assert states(compacted([upper, l2], final=False)) == {"/key/1": None, "/key/2": b"\0\2", "/key/3": None, "/key/4": None, "/key/5": b"\0\5", "/key/6": b"\0\6"}
    assert sorted(states(compacted([upper, l2], final=True))) == ["/key/2", "/key/5", "/key/6"]
    with pytest.raises(ValueError):
        merge_runs([])


def test_get_many_and_snapshots(spark):
    e = entries(spark, [("a", b"1", 1), ("a", b"2", 5), ("b", None, 2), ("c", b"3", 3)])
    found = {r["key"]: (r["found"], r["value"]) for r in get_many(e, spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "key string")).collect()}
    assert found["a"] == (True, b"2") and found["b"] == (False, None) and found["x"] == (False, None) and len(found) == 3
    assert pairs(visible(as_of(e, 5))) == {"a": b"1", "c": b"3"}
    assert [r[0] for r in e.where("seq = 2").select(entry_size(F.col("key"), F.col("value"))).collect()] == [10]


def test_plan_pushes_prefix_and_limits_groups(spark, tmp_path):
    entries(spark, [(f"/user/{i:03}", b"x", i) for i in range(50)]).write.parquet(str(tmp_path / "e"))
    df = newest_wins(spark.read.parquet(str(tmp_path / "e")).where(has_prefix("/user/01")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,/user/01)" in plan and "WindowGroupLimit" in plan
    assert df.count() == 10
