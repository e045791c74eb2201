"""A keyed, versioned store: upserts, deletes, point reads and ordered prefix scans over immutable sorted runs.

Entries written one by one go to a write-ahead log and a buffer on the driver; DataFrames (``put_all``, ``delete_all``) become runs at once
and are the way to write much. Every change has a sequence number, and every read is the fold of ``operators.fold``.

A version is what the manifest holds after a commit: runs, not buffers. ``version`` therefore flushes first, so that a scan of the version it names
shows every change made before. Null keys are an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.config import StoreConfig
from emberlog.errors import InvalidRootPath, LockedError, StoreError, StoreIOError
from emberlog.functions import has_prefix, key_is
from emberlog.operators.fold import get_many as fold_get_many
from emberlog.operators.fold import newest_wins, visible
from emberlog.plans.compaction import compact_if_full, merge_level
from emberlog.plans.manifest import Manifest, Segment, State
from emberlog.schema import ENTRY, SEGMENT
from emberlog.sources.files import Files
from emberlog.sources.segments import files_for, read_segments, write_rows, write_run
from emberlog.sources.wal import LocalLogs, SharedLogs


#: Up to so many wanted keys reach the scan as a list.
FEW_KEYS = 1000
_NULL_KEY = "a key is null"


class Memtable:
    """Newest entry of each key, and the bytes of keys and values."""

    def __init__(self, log: str) -> None:
        self.entries: dict[str, tuple[bytes | None, int]] = {}
        self.size, self.log = 0, log

    def put(self, key: str, value: bytes | None, seq: int) -> None:
        old = self.entries.get(key)
        self.size += len(value or b"") - len(old[0] or b"") if old else len(key.encode()) + len(value or b"")
        self.entries[key] = (value, seq)

    def rows(self, prefix: str = "") -> list[tuple]:
        return [(k, *self._row(k)) for k in sorted(k for k in self.entries if k.startswith(prefix))]

    def _row(self, key: str) -> tuple[bytes | None, bool, int]:
        value, seq = self.entries[key]
        return value, value is None, seq


class KVStore:
    """Open with ``KVStore.open``. One writer at a time; usable as a context manager."""

    def __init__(self, spark: SparkSession, files: Files, config: StoreConfig, logs: LocalLogs | SharedLogs) -> None:
        self.spark, self.files, self.config, self._logs = spark, files, config, logs
        self.manifest = Manifest(files)
        self._frozen: deque[Memtable] = deque()  # newest first
        self._seq, self._log, self._closed = self.manifest.state.next_seq, None, False
        self._recover()

    # -- opening and closing

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: StoreConfig | None = None, wal_dir: str | None = None, break_lock: bool = False) -> "KVStore":
        """Open or create the store under ``root`` (any file system that Spark reaches).

        Logs are kept under ``<root>/wal``, or in a durable local folder ``wal_dir`` (in a part of it that is this root's own).
        ``break_lock`` takes over the lock of a writer that died.
        """
        files = Files(spark, root)
        if files.exists() and not files.is_dir():
            raise InvalidRootPath(f"{root} is not a directory")
        files.make_dirs()
        place = urlparse(files.root)
        if wal_dir is not None:
            logs = LocalLogs(Path(wal_dir) / hashlib.sha256(files.root.encode()).hexdigest()[:16])
        else:
            logs = LocalLogs(Path(place.path) / "wal") if place.scheme in ("", "file") else SharedLogs(files)
        if break_lock:
            files.delete("LOCK")
        owner = {"host": socket.gethostname(), "pid": os.getpid(), "id": uuid.uuid4().hex}
        try:
            files.create("LOCK", json.dumps(owner).encode())
        except StoreIOError as e:
            holder = files.read("LOCK").decode() if files.exists("LOCK") else "?"
            raise LockedError(f"{root} is open for writing by {holder}; pass break_lock=True if that writer is gone") from e
        try:
            return cls(spark, files, config or StoreConfig(), logs)
        except BaseException:
            files.delete("LOCK")
            raise

    def _recover(self) -> None:
        """One buffer for each log that the manifest lists; then a fresh log."""
        for name in self.manifest.state.logs:
            table = Memtable(name)
            for key, value, seq in self._logs.replay(name):
                table.put(key, value, seq)
                self._seq = max(self._seq, seq + 1)
            self._frozen.appendleft(table)
        # the newest log's entries go on as the active buffer, under their own log until it is flushed
        self._active = self._frozen.popleft() if self._frozen else None
        if self._active is None:
            self._new_log()
        else:
            old = self._active
            fresh = f"LOG-{uuid.uuid4().hex}"
            self._log = self._logs.create(fresh)
            self._log.append([(k, v, s) for k, (v, s) in old.entries.items()])
            state = self.manifest.state
            logs = [fresh if n == old.log else n for n in state.logs]
            snapshot = state.snapshot()
            snapshot["State"] |= {"logs": logs, "next_seq": self._seq}
            self.manifest.commit(snapshot)
            self._logs.delete(old.log)
            old.log = fresh

    def _new_log(self) -> None:
        name = f"LOG-{uuid.uuid4().hex}"
        self._log = self._logs.create(name)
        self.manifest.commit({"NewLog": {"filename": name, "next_seq": self._seq}})
        self._active = Memtable(name)

    def close(self) -> None:
        """Give up the store. Nothing is flushed: what was put is in the logs."""
        if not self._closed:
            self._closed = True
            self._log.close()
            self.files.delete("LOCK")

    def __enter__(self) -> "KVStore":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _check(self) -> None:
        if self._closed:
            raise StoreError("the store is closed")

    # -- writing

    def put(self, key: str, value: bytes | str) -> None:
        """Insert or replace."""
        self._write([(key, value.encode() if isinstance(value, str) else bytes(value))])

    def delete(self, key: str) -> None:
        """Hide a key; no error if there is none."""
        self._write([(key, None)])

    def put_many(self, pairs: list[tuple[str, bytes | None]]) -> None:
        """Several changes (None deletes) under one ``fsync``."""
        self._write(pairs)

    def _write(self, pairs: list[tuple[str, bytes | None]]) -> None:
        self._check()
        changes = [(k, v, self._seq + i) for i, (k, v) in enumerate(pairs)]
        self._log.append(changes)
        self._seq += len(changes)
        for change in changes:
            self._active.put(*change)
        if self._active.size >= self.config.max_active_memtable_size:
            self.freeze()
        if len(self._frozen) > self.config.max_frozen_memtables:
            self.flush()
            self.compact()

    def put_all(self, pairs: DataFrame, order_by: Column | None = None, stream: str | None = None, batch: int = 0) -> bool:
        """Write a DataFrame (key, value and, if it has it, deleted) as one run of level 0.

        All of it is newer than anything before. Of rows with one key the last by ``order_by`` counts; without it they must be
        equal or the largest (deleted, value) counts. A null key fails the whole call and nothing is written. With ``stream`` a batch number
        that is already committed is left out (False is returned).
        """
        self._check()
        if stream is not None and self.manifest.state.batches.get(stream, -1) >= batch:
            return False
        self._spill_buffers()
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in pairs.columns else F.lit(False)
        value = F.col("value").cast("binary")
        key = F.when(F.col("key").isNull(), F.raise_error(F.lit(_NULL_KEY)).cast("string")).otherwise(F.col("key").cast("string"))
        rows = pairs.withColumns({"key": key, "_gone": gone | value.isNull(), "_order": order_by if order_by is not None else F.struct(gone, value)})
        rows = rows.select("key", F.when(F.col("_gone"), F.lit(None)).otherwise(value).alias("value"), F.col("_gone").alias("deleted"), F.lit(self._seq).cast("long").alias("seq"), "_order")
        folded = newest_wins(rows, F.col("_order").desc()).drop("_order")
        # counted, as a task's memory depends on it; files are as large as suits the level that the run will get to
        n_entries, n_raw = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.octet_length(F.col("key").cast("string")) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")), F.lit(0))).first()
        size = min(n_raw, int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        n_files = files_for(size, self.config.target_shard_size(self.config.level_for(size)), n_entries, n_raw)
        try:
            segments = write_run(self.files, folded, n_files, self.config.block_max_size)
        except Exception as e:
            if _NULL_KEY in str(e):
                raise StoreError(_NULL_KEY) from e
            raise
        self._seq += 1
        self.manifest.commit({"AddSegments": {"segments": [asdict(s) for s in segments], "stream": stream, "batch": batch, "next_seq": self._seq}})
        self.compact()
        return True

    def delete_all(self, keys: DataFrame) -> None:
        """Hide every key of a DataFrame."""
        self.put_all(keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("deleted")))

    def _spill_buffers(self) -> None:
        """Runs of a level are in order of age, so buffered entries become runs before a newer one."""
        if self._active.entries:
            self.freeze()
        self.flush()

    def freeze(self) -> None:
        """Close the active buffer and its log and begin new ones; nothing happens if it is empty."""
        self._check()
        if self._active.entries:
            self._log.close()
            self._frozen.appendleft(self._active)
            self._new_log()

    def flush(self) -> None:
        """Write each frozen buffer as a run of level 0, oldest first: data, then manifest, then the logs go."""
        self._check()
        tables = list(reversed(self._frozen))
        runs = [write_rows(self.files, table.rows(), self.config.block_max_size) for table in tables]
        if tables:
            self.manifest.commit(*({"AddSegments": {"segments": [asdict(s) for s in run], "log": table.log, "next_seq": self._seq}} for table, run in zip(tables, runs)))
        for table in tables:
            self._frozen.pop()
            self._logs.delete(table.log)

    def compact(self, level: int | None = None) -> list[int]:
        """Merge what is over its size or, if given, one level whatever its size."""
        self._check()
        if level is None:
            return compact_if_full(self.spark, self.files, self.manifest, self.config)
        merge_level(self.spark, self.files, self.manifest, self.config, level)
        return [level]

    def vacuum(self, retain: int = 1) -> int:
        """Delete files that none of the last ``retain`` versions names, and logs that the manifest does not name; the number of files deleted.
        Scans of older versions fail after it."""
        self._check()
        versions = range(max(0, self.manifest.version - max(1, retain) + 1), self.manifest.version + 1)
        live = {s.path for v in versions if self.files.exists(f"MANIFEST-{v}") for _, s in self.manifest.at(v).segments()}
        lost = [name for name in self._logs.names() if name.startswith("LOG-") and name not in self.manifest.state.logs]
        for name in lost:
            self._logs.delete(name)
        gone = len(lost)
        for run in self.files.sizes("segments"):
            held = [f for f in self.files.sizes(f"segments/{run}") if f.endswith(".parquet")]
            dead = [f for f in held if f"segments/{run}/{f}" not in live]
            if len(dead) == len(held):
                self.files.delete(f"segments/{run}")
            else:
                for f in dead:
                    self.files.delete(f"segments/{run}/{f}")
            gone += len(dead)
        for name in self.files.sizes(""):
            if name.startswith("MANIFEST-") and not name.endswith(".tmp") and int(name.removeprefix("MANIFEST-")) not in versions:
                self.files.delete(name)
        return gone

    # -- reading

    def _buffered(self, prefix: str = "") -> list[tuple]:
        return [row for table in (self._active, *self._frozen) for row in table.rows(prefix)]

    def entries(self, prefix: str = "", version: int | None = None) -> DataFrame:
        """All stored changes under a prefix, each run's newest for each key; only files whose range may hold it are read."""
        self._check()
        state = self.manifest.state if version is None else self.manifest.at(version)
        stored = read_segments(self.spark, self.files, [s for _, s in state.segments() if s.may_hold_prefix(prefix)]).where(has_prefix(prefix))
        rows = self._buffered(prefix) if version is None else []
        return stored.unionByName(self.spark.createDataFrame(rows, ENTRY)) if rows else stored

    def scan(self, prefix: str = "", version: int | None = None, ordered: bool = True) -> DataFrame:
        """Live pairs under a prefix by ascending key, as of now (later writes do not show) or of an earlier ``version``.

        If one level alone holds the prefix and its files do not overlap, every key occurs once and no fold is needed.
        """
        self._check()
        state = self.manifest.state if version is None else self.manifest.at(version)
        entries = self.entries(prefix, version)
        once = self._single_run(state, prefix) and (version is not None or not self._buffered(prefix))
        out = visible(entries if once else newest_wins(entries)).select("key", "value")
        return out.orderBy("key") if ordered else out

    def iterate(self, prefix: str = "") -> Iterator[tuple[str, bytes]]:
        """Live pairs under a prefix, ascending, fetched a partition at a time; the caller may stop early."""
        for row in self.scan(prefix).toLocalIterator():
            yield row["key"], bytes(row["value"])

    @staticmethod
    def _single_run(state: State, prefix: str) -> bool:
        held = sorted((s for _, s in state.segments() if s.may_hold_prefix(prefix)), key=lambda s: s.smallest)
        return all(a.largest < b.smallest for a, b in zip(held, held[1:]))

    def get(self, key: str) -> bytes | None:
        """The value of a key, or None. A buffered entry decides without a job."""
        self._check()
        for table in (self._active, *self._frozen):
            if key in table.entries:
                return table.entries[key][0]
        held = [s for _, s in self.manifest.state.segments() if s.may_hold(key)]
        if not held:
            return None
        newest = read_segments(self.spark, self.files, held).where(key_is(key)).orderBy(F.col("seq").desc()).limit(1).collect()
        return bytes(newest[0]["value"]) if newest and not newest[0]["deleted"] else None

    def get_many(self, keys: DataFrame) -> DataFrame:
        """key, value and found for each distinct key of a DataFrame.

        A first small job finds the range of the keys and, up to ``FEW_KEYS``, the keys; only files that may hold one are read then, and
        a list of keys reaches Parquet's statistics and Bloom filters.
        """
        self._check()
        wanted = keys.select("key").where(F.col("key").isNotNull()).distinct()
        low, high = wanted.agg(F.min("key"), F.max("key")).first()
        few = [r["key"] for r in wanted.limit(FEW_KEYS + 1).collect()] if low is not None else []
        live = self.manifest.state.segments()
        if len(few) <= FEW_KEYS:
            held = [s for _, s in live if any(s.may_hold(k) for k in few)]
            inside = F.col("key").isin(few) if few else F.lit(False)
        else:
            few = []
            held = [s for _, s in live if s.smallest <= high and low <= s.largest]
            inside = F.col("key").between(low, high)
        stored = read_segments(self.spark, self.files, held).where(inside)
        rows = [row for row in self._buffered() if low is not None and low <= row[0] <= high]
        return fold_get_many(stored.unionByName(self.spark.createDataFrame(rows, ENTRY)) if rows else stored, keys)

    def levels(self) -> list[list[Segment]]:
        return [list(level) for level in self.manifest.state.levels]

    def segments(self) -> DataFrame:
        """The live files."""
        rows = [(n, s.run, s.path, s.smallest, s.largest, s.n_entries, s.n_bytes) for n, s in self.manifest.state.segments()]
        return self.spark.createDataFrame(rows, SEGMENT)

    @property
    def version(self) -> int:
        """The newest version, with all that was put so far: buffers are flushed first."""
        self._check()
        self._spill_buffers()
        return self.manifest.version
