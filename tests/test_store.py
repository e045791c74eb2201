import random

import pytest

from emberlog.config import StoreConfig
from emberlog.errors import InvalidRootPath, LockedError, LogError, ManifestError, SegmentPathError, StoreError
from emberlog.plans.compaction import stretches
from emberlog.plans.manifest import Segment, State, parse
from emberlog.sources import wal
from emberlog.sources.files import Files
from emberlog.store import KVStore
from emberlog.streaming import ingest


def pairs(df):
    return [(r["key"], bytes(r["value"])) for r in df.collect()]


def test_random_operations_match_a_dict(spark, tmp_path):
    """Any order of puts, deletes, freezes, flushes and merges reads like a dict; scans are snapshots."""
    r, model = random.Random(31), {}
    words = ["", "p", "pq", "pq/1", "pq_1", "p%", "r", "r/s/t", "é", "😀"]
    with KVStore.open(spark, str(tmp_path / "s"), StoreConfig(max_frozen_memtables=50)) as s:
        for i in range(60):
            key, act = r.choice(words), r.random()
            if act < 0.5:
                model[key] = r.choice([b"", bytes([i]), b"x" * i])
                s.put(key, model[key])
            elif act < 0.75:
                s.delete(key)
                model.pop(key, None)
            elif act < 0.9:
                s.freeze()
            elif act < 0.96:
                s.flush()
            else:
                s.flush()
                s.compact(0)
            assert s.get(key) == model.get(key)
        before, old = s.scan(), sorted(model.items(), key=lambda e: e[0].encode())
        assert pairs(before) == old and list(s.iterate()) == old and next(s.iterate()) == old[0]
        for prefix in ("p", "pq/", "pq_", "p%", "nothing"):
            assert pairs(s.scan(prefix)) == [e for e in old if e[0].startswith(prefix)]
        s.put_many([("later", b"1"), (old[0][0], None)])
        assert pairs(before) == old and s.get("later") == b"1" and s.get(old[0][0]) is None
    with pytest.raises(StoreError):
        s.put("a", "b")


def test_one_run_for_each_frozen_buffer_and_reopen(spark, tmp_path):
    root, config = str(tmp_path / "s"), StoreConfig(max_frozen_memtables=10)
    with KVStore.open(spark, root, config) as s:
        for k in "abcdef":
            s.put(f"/key/{k}", f"val {k}")
            s.freeze()
        s.freeze()  # empty: nothing happens
        s.put("/key/g", "g")
        assert len(s.manifest.state.logs) == 7
        s.flush()
        assert len(s.levels()[0]) == 6 and len(s.manifest.state.logs) == 1
    with KVStore.open(spark, root, config) as s:
        assert [(x.smallest, x.largest) for x in s.levels()[0]] == [(f"/key/{k}", f"/key/{k}") for k in "abcdef"]
        assert [v for _, v in pairs(s.scan())] == [f"val {k}".encode() for k in "abcdef"] + [b"g"]
        assert s.segments().count() == 6


def test_recovery_keeps_frozen_boundaries(spark, tmp_path):
    root, config = str(tmp_path / "s"), StoreConfig(max_active_memtable_size=90, max_frozen_memtables=5)
    with KVStore.open(spark, root, config) as s:
        for i in range(40):
            s.put(f"/key/{i}", bytes([i]))
        sizes = [s._active.size, *(t.size for t in s._frozen)]
        assert len(sizes) > 2
    with KVStore.open(spark, root, config) as s:
        assert [s._active.size, *(t.size for t in s._frozen)] == sizes
        assert all(s.get(f"/key/{i}") == bytes([i]) for i in range(40))
        s.put("/key/1", "new")
        assert s.get("/key/1") == b"new"


def test_levels_match_a_dict(spark, tmp_path):
    r, model = random.Random(7), {}
    config = StoreConfig(max_active_memtable_size=300, max_frozen_memtables=1, level_base_max_size=1500, level_base_max_sstables=1)
    root = str(tmp_path / "s")
    s = KVStore.open(spark, root, config)
    for i in range(130):
        key = f"/key/{r.choice('abcdef')}/{r.randrange(60)}"
        if r.random() < 0.4:
            s.delete(key)
            model.pop(key, None)
        else:
            model[key] = f"val {i}".encode()
            s.put(key, model[key])
        if i == 80:
            s.close()
            s = KVStore.open(spark, root, config)
    assert len(s.levels()) >= 2
    assert dict(pairs(s.scan())) == model
    assert sum((pairs(s.scan(f"/key/{c}")) for c in "abcdef"), []) == pairs(s.scan()) == sorted(model.items())
    for level in range(len(s.levels())):
        s._spill_buffers()
        s.compact(level)
        assert dict(pairs(s.scan())) == model
        held = sorted(s.levels()[level + 1], key=lambda x: x.smallest)
        assert all(a.largest < b.smallest for a, b in zip(held, held[1:]))
    old = s.scan("/key/a")
    assert s.vacuum(retain=3) >= 0
    assert pairs(old) == [p for p in sorted(model.items()) if p[0].startswith("/key/a")]
    assert s.vacuum() > 0 and dict(pairs(s.scan())) == model
    s.close()


def test_tombstones_go_at_the_last_level_only(spark, tmp_path):
    with KVStore.open(spark, str(tmp_path / "s")) as s:
        s.put_all(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
        s.compact(0)
        s.compact(1)
        s.delete_all(spark.createDataFrame([("a",)], "key string"))
        s.compact(0)  # level 2 still holds a
        assert s.entries().where("deleted").count() == 1
        s.compact(1)
        assert s.entries().count() == 1 and pairs(s.scan()) == [("b", b"2")]


def test_put_all_versions_and_large_values(spark, tmp_path):
    with KVStore.open(spark, str(tmp_path / "s")) as s:
        s.put("k0", "buffered")
        s.put_all(spark.createDataFrame([("k0", "run"), ("k1", "é" * 5000), ("", "empty key")], "key string, value string"))
        version = s.version
        s.put_all(spark.createDataFrame([("k1", "a", 1), ("k1", "b", 2)], "key string, value string, n int"), order_by=__import__("pyspark").sql.functions.col("n"))
        assert dict(pairs(s.scan())) == {"k0": b"run", "k1": b"b", "": b"empty key"}
        assert dict(pairs(s.scan(version=version)))["k1"] == ("é" * 5000).encode()
        got = {r["key"]: r["found"] for r in s.get_many(spark.createDataFrame([("k1",), ("zz",)], "key string")).collect()}
        assert got == {"k1": True, "zz": False}
        for bad in ([(None, "x"), ("k9", "y")], [(None, None)]):
            with pytest.raises(StoreError):
                s.put_all(spark.createDataFrame(bad, "key string, value string"))
        assert s.get("k9") is None and len(pairs(s.scan())) == 3


def test_a_version_holds_what_was_put_before(spark, tmp_path):
    with KVStore.open(spark, str(tmp_path / "s")) as s:
        s.put("a", "1")
        first = s.version
        s.put("a", "2")
        s.delete("b")
        assert pairs(s.scan(version=first)) == [("a", b"1")] and pairs(s.scan()) == [("a", b"2")]
        assert pairs(s.scan(version=s.version)) == [("a", b"2")]


def test_get_many_reads_only_files_that_may_hold_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("emberlog.store.FEW_KEYS", 3)
    with KVStore.open(spark, str(tmp_path / "s")) as s:
        for c in "abc":
            s.put_all(spark.createDataFrame([(f"{c}{i}", f"{c}{i}") for i in range(5)], "key string, value string"))
        s.put("b1", "new")
        one = s.get_many(spark.createDataFrame([("b1",), ("b1",)], "key string"))
        assert len(one.inputFiles()) == 1 and [(r["key"], bytes(r["value"]), r["found"]) for r in one.collect()] == [("b1", b"new", True)]
        many = s.get_many(spark.createDataFrame([(k,) for k in ("b0", "b1", "c1", "c9", None, "zz")], "key string"))
        assert len(many.inputFiles()) == 2
        assert {r["key"]: r["value"] and bytes(r["value"]) for r in many.collect()} == {"b0": b"b0", "b1": b"new", "c1": b"c1", "c9": None, None: None, "zz": None}
        none = s.get_many(spark.createDataFrame([], "key string"))
        assert none.collect() == [] and none.inputFiles() == []


def test_lock_and_bad_roots(spark, tmp_path):
    root = str(tmp_path / "s")
    s = KVStore.open(spark, root)
    with pytest.raises(LockedError):
        KVStore.open(spark, root)
    KVStore.open(spark, root, break_lock=True).close()
    s.close()
    (tmp_path / "file").write_text("x")
    with pytest.raises(InvalidRootPath):
        KVStore.open(spark, str(tmp_path / "file"))


def test_crash_between_data_and_commit_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    s = KVStore.open(spark, root, StoreConfig(max_frozen_memtables=9))
    s.put("a", "1")
    s.freeze()

    def crash(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(s.manifest, "commit", crash)
    with pytest.raises(RuntimeError):
        s.flush()
    s._log.close()
    with KVStore.open(spark, root, break_lock=True) as t:
        assert t.get("a") == b"1" and t.levels() == [[]]
        assert t.vacuum() >= 1  # the orphan


CHANGES = [("north", b"\0\1", 1), ("ünïcode", b"", 2), ("", None, 3), ("south", b"w" * 300, 9)]


def test_log_drops_a_torn_tail_only(tmp_path):
    raw, ends = wal.pack(CHANGES), [len(wal.pack(CHANGES[:n])) for n in range(len(CHANGES) + 1)]
    assert list(wal.unpack(raw, "x")) == CHANGES
    for cut in range(len(raw)):
        whole = sum(e <= cut for e in ends) - 1
        assert list(wal.unpack(raw[:cut], "x")) == CHANGES[:whole]
        if cut > ends[-2]:  # what was not written may be there as zeros
            assert list(wal.unpack(raw[:cut] + bytes(len(raw) - cut), "x"))[:3] == CHANGES[:3]
        if cut not in ends:
            with pytest.raises(LogError):
                list(wal.unpack(raw[:cut], "x", last=False))


def test_log_reports_damage(tmp_path):
    raw = wal.pack(CHANGES)
    for i in range(len(wal.pack(CHANGES[:1]))):  # any byte of the first record, its length too
        for bit in (1, 128):
            with pytest.raises(LogError):
                list(wal.unpack(raw[:i] + bytes([raw[i] ^ bit]) + raw[i + 1 :], "x"))


@pytest.mark.parametrize("shared", [False, True])
def test_logs(spark, tmp_path, shared):
    logs = wal.SharedLogs(Files(spark, str(tmp_path))) if shared else wal.LocalLogs(tmp_path / "wal")
    w = logs.create("LOG-a")
    w.append(CHANGES[:1])
    w.append(CHANGES[1:])
    w.close()
    logs.create("LOG-b").close()
    assert list(logs.replay("LOG-a")) == CHANGES and list(logs.replay("LOG-b")) == [] and logs.names() == ["LOG-a", "LOG-b"]
    logs.delete("LOG-a")
    assert logs.names() == ["LOG-b"]
    with pytest.raises(LogError):
        list(logs.replay("LOG-a"))
    if shared:
        w = logs.create("LOG-c")
        for c in CHANGES:
            w.append([c])
        (tmp_path / "wal/LOG-c/000000000001").unlink()
        with pytest.raises(LogError):
            list(logs.replay("LOG-c"))


@pytest.mark.parametrize("shared", [False, True])
def test_reopening_leaves_no_logs(spark, tmp_path, shared, monkeypatch):
    root = str(tmp_path / "s")
    if shared:
        monkeypatch.setattr("emberlog.store.LocalLogs", lambda folder: wal.SharedLogs(Files(spark, root)))
    for i in range(4):
        with KVStore.open(spark, root) as s:
            s.put(f"k{i}", b"v")
            assert s._logs.names() == s.manifest.state.logs
    (tmp_path / "s/wal/LOG-lost").mkdir() if shared else (tmp_path / "s/wal/LOG-lost").write_bytes(b"")
    with KVStore.open(spark, root) as s:
        assert len(pairs(s.scan())) == 4
        assert s.vacuum() == 1 and s._logs.names() == s.manifest.state.logs


def test_two_stores_share_a_log_folder(spark, tmp_path):
    with KVStore.open(spark, str(tmp_path / "a"), wal_dir=str(tmp_path / "w")) as a, KVStore.open(spark, str(tmp_path / "b"), wal_dir=str(tmp_path / "w")) as b:
        a.put("k", b"a")
        b.put("k", b"b")
        assert a.vacuum() == b.vacuum() == 0
    with KVStore.open(spark, str(tmp_path / "a"), wal_dir=str(tmp_path / "w")) as a:
        assert a.get("k") == b"a"


def test_manifest_follows_a_model():
    """Random operations against lists of names."""
    r = random.Random(12)
    state, levels, logs = State(), [[]], []
    for i in range(200):
        low, high = sorted(r.choices("bcdefgh", k=2))
        file = {"run": f"r{i}", "path": f"segments/r{i}/f", "smallest": low, "largest": high}
        act = r.randrange(4)
        if act == 0:
            state.apply({"NewLog": {"filename": f"L{i}", "next_seq": i}})
            logs.append(f"L{i}")
        elif act < 3:
            log = logs.pop(r.randrange(len(logs))) if logs and r.random() < 0.7 else None
            state.apply({"AddSegments": {"segments": [file], "log": log}})
            levels[0].append(file["path"])
        else:
            to = r.randrange(1, len(levels) + 1)
            state.apply({"MergeLevel": {"to_level": to, "segments": [file]}})
            levels += [[]] * (to == len(levels))
            levels[to - 1], levels[to] = [], [file["path"]]
        assert [[s.path for s in level] for level in state.levels] == levels and state.logs == logs
    assert len(levels) > 3
    for to in (0, len(levels) + 1):
        with pytest.raises(ManifestError):
            state.apply({"MergeLevel": {"to_level": to, "segments": []}})
    again = State()
    again.apply(state.snapshot())
    assert again == state
    for line in ('{"AddSegments": {"segments": [{"run": "r", "path": "../x", "smallest": "a", "largest": "b"}]}}', '{"AddSegments": {"segments": [{"run": "r", "path": "/x", "smallest": "a", "largest": "b"}]}}'):
        with pytest.raises(SegmentPathError):
            parse([line])
    for line in ("nonsense", '{"Unknown": {}}'):
        with pytest.raises(ManifestError):
            parse([line])


def test_file_ranges():
    s = Segment("r", "p", "b", "d")
    assert [s.may_hold(k) for k in ("a", "b", "c", "d", "da", "e")] == [False, True, True, True, False, False]
    assert [s.may_hold_prefix(k) for k in ("", "a", "b", "ba", "c", "d", "da", "e")] == [True, False, True, True, True, True, False, False]


def test_merges_leave_files_that_meet_nothing(spark, tmp_path):
    with KVStore.open(spark, str(tmp_path / "s")) as s:
        for c in "acegi":  # one file of level 1 for each letter
            s.put_all(spark.createDataFrame([(f"{c}{i}", "old") for i in range(4)], "key string, value string"))
            s.compact(0)
        before = {x.smallest[0]: x.path for x in s.levels()[1]}
        assert len(before) == 5
        s.put_all(spark.createDataFrame([("c1", "new"), ("d", "new")], "key string, value string"))
        s.put_all(spark.createDataFrame([("g9", None), ("g2", None)], "key string, value string"))
        s.compact(0)
        after = {x.smallest[0]: x.path for x in s.levels()[1]}
        assert {c for c in "aeiacg" if after.get(c) == before[c]} == set("aei") and len(s.levels()[1]) == 5
        model = {f"{c}{i}": b"old" for c in "acegi" for i in range(4)} | {"c1": b"new", "d": b"new"}
        del model["g2"]
        assert dict(pairs(s.scan())) == model
        held = s.levels()[1]
        assert all(a.largest < b.smallest for a, b in zip(held, held[1:]))


def test_stretches():
    r = random.Random(4)
    for _ in range(300):
        cuts = sorted(r.sample(range(100), 20))
        lower = [Segment("r", f"l{i}", f"{a:02}", f"{b:02}") for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2])) if r.random() < 0.8]
        upper = [Segment("r", f"u{i}", f"{min(x):02}", f"{max(x):02}") for i, x in enumerate([r.choices(range(100), k=2) for _ in range(r.randrange(1, 12))])]
        upper = [u if r.random() < 0.5 else Segment("r", u.path, u.smallest, u.smallest) for u in upper]
        most = r.choice([1, 2, 8])
        merged, kept = stretches(upper, lower, most)
        assert sorted(s.path for part in [*merged, kept] for s in part) == sorted(s.path for s in [*upper, *lower]) and 1 <= len(merged) <= most
        spans = sorted([(min(s.smallest for s in part), max(s.largest for s in part)) for part in merged] + [(s.smallest, s.largest) for s in kept])
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and all(s.path[0] == "l" for s in kept)


def test_config():
    c = StoreConfig.small()
    assert c.level_max_size(2) == 1000 << 20 and c.level_max_sstables(1) == 4 and c.target_shard_size(1) == (100 << 20) // 4


def test_stream_commits_each_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    schema = "key string, value string, deleted boolean"
    with KVStore.open(spark, str(tmp_path / "s")) as s:
        for rows in ([("a", "1", False), ("b", "2", False)], [("a", None, True), ("c", "", False)]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(schema).parquet(str(source))
            ingest(stream, s, "feed", str(tmp_path / "checkpoint")).awaitTermination()
        assert pairs(s.scan()) == [("b", b"2"), ("c", b"")]
        n = s.version
        assert not s.put_all(spark.createDataFrame([("z", "9", False)], schema), stream="feed", batch=1)
        assert s.version == n
