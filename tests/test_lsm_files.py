import json
import random

import pytest

from emberlog.errors import LogError, ManifestError, SegmentError
from emberlog.sources.files import Files
from emberlog.sources.lsm_files import live_files, log_bytes, log_entries, read_database, table_bytes, table_entries, write_database


def test_tables_round_trip():
    r = random.Random(2)
    for n in (0, 1, 40, 700):
        model = {"".join(r.choices("xyzé😀/", k=r.randrange(9))): r.choice([None, b"", r.randbytes(r.choice([3, 50, 6000]))]) for _ in range(n)}
        entries = sorted(model.items(), key=lambda e: e[0].encode())
        raw = table_bytes(entries, r.choice([64, 4096]))
        assert list(table_entries(raw)) == entries
        if n > 1:
            with pytest.raises(SegmentError):
                list(table_entries(raw[:-6]))


def test_logs_drop_a_torn_tail_only():
    changes = [("east", b"12"), ("west", None), ("", b"")]
    raw = log_bytes(changes)
    ends = [len(log_bytes(changes[:n])) for n in range(4)]
    for cut in range(len(raw) + 1):
        assert list(log_entries(raw[:cut])) == changes[: sum(e <= cut for e in ends) - 1]
    with pytest.raises(LogError):
        list(log_entries(b"\7" + raw))


def test_writes_a_database(spark, tmp_path):
    runs = [{f"{c}{i:03}": None if i % step == 1 else bytes([i]) for i in range(n) for c in "mn"} for n, step in ((30, 3), (60, 4), (90, 5), (40, 2))]
    frames = [spark.createDataFrame([(k, v, v is None) for k, v in run.items()], "key string, value binary, deleted boolean") for run in runs]
    write_database(frames, str(tmp_path / "db"), n_ranges=2, table_size=600)
    levels, logs = live_files(Files(spark, str(tmp_path / "db")))
    assert len(levels) == 4 and all(len(level) > 1 for level in levels) and len(logs) == 1
    model = runs[3] | runs[2] | runs[1] | runs[0]
    rows = {r["key"]: None if r["deleted"] else bytes(r["value"]) for r in read_database(spark, str(tmp_path / "db")).collect()}
    assert rows == model
    with pytest.raises(ManifestError):
        write_database(frames, str(tmp_path / "db"))
    write_database([frames[0].limit(0)], str(tmp_path / "none"))
    assert read_database(spark, str(tmp_path / "none")).collect() == []


def test_reads_a_database(spark, tmp_path):
    with pytest.raises(ManifestError):
        read_database(spark, str(tmp_path))
    (tmp_path / "l1-0.sst").write_bytes(table_bytes([("a", b"old"), ("b", b"old"), ("c", b"old")]))
    (tmp_path / "l0-0.sst").write_bytes(table_bytes([("a", b"mid"), ("b", None)]))
    (tmp_path / "LOG.2").write_bytes(log_bytes([("a", b"new"), ("d", b""), ("d", None), ("d", b"4")]))
    span = {"smallest": "a", "largest": "c"}
    ops = [{"NewLog": {"filename": "LOG.0"}}, {"AddSSTable": {"key_range": span, "sstable": "x.sst"}}, {"MergeLevel": {"to_level": 1, "sstables": [[span, str(tmp_path / "l1-0.sst")]]}}, {"NewLog": {"filename": "LOG.1"}}, {"AddSSTable": {"key_range": span, "sstable": "l0-0.sst"}}, {"NewLog": {"filename": "LOG.2"}}]
    (tmp_path / "MANIFEST-0").write_text("".join("\n" + json.dumps(o) for o in ops))
    (tmp_path / "CURRENT").write_text("MANIFEST-0")
    rows = {r["key"]: None if r["deleted"] else bytes(r["value"]) for r in read_database(spark, str(tmp_path)).collect()}
    assert rows == {"a": b"new", "b": None, "c": b"old", "d": b"4"}
