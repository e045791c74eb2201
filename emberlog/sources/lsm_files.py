"""Databases of the embedded store's own binary files, as DataFrames, and back.

Little-endian layout:

    entry      key length u32, key, 1 and value length u32, value; or 0 for a tombstone
    block      entries, the offset of each u32, their number u32
    table      blocks; for each block its size u32, last key length u32, last key; the size of that index u32
    log        for each record 0 (put) and an entry
    manifest   a JSON operation a line; CURRENT names the file
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.errors import LogError, ManifestError, SegmentError
from emberlog.operators.fold import newest_wins
from emberlog.shared import ship
from emberlog.sources.files import Files, open_uri

Entry = tuple[str, bytes | None]
_U32 = struct.Struct("<I")


def pack_entry(key: str, value: bytes | None) -> bytes:
    k = key.encode()
    return _U32.pack(len(k)) + k + (b"\0" if value is None else b"\1" + _U32.pack(len(value)) + value)


def unpack_entry(raw: bytes, at: int) -> tuple[str, bytes | None, int]:
    """Key, value and where the next entry begins."""
    end = at + 4 + _U32.unpack_from(raw, at)[0]
    key, mark = raw[at + 4 : end].decode(), raw[end]
    if mark == 0:
        return key, None, end + 1
    if mark != 1:
        raise SegmentError(f"presence byte {mark} at {end}")
    size = _U32.unpack_from(raw, end + 1)[0]
    value = raw[end + 5 : end + 5 + size]
    if len(value) != size:
        raise SegmentError("an entry is cut short")
    return key, value, end + 5 + size


def table_bytes(entries: Iterable[Entry], block_size: int = 4096) -> bytes:
    """A table of sorted entries. An entry larger than a block gets a block of its own."""
    blocks, index, now, at, last = [], [], [], 0, ""

    def close() -> None:
        nonlocal now, at
        offsets, pos = [], 0
        for e in now:
            offsets.append(_U32.pack(pos))
            pos += len(e)
        body = b"".join(now) + b"".join(offsets) + _U32.pack(len(now))
        blocks.append(body)
        k = last.encode()
        index.append(_U32.pack(len(body)) + _U32.pack(len(k)) + k)
        now, at = [], 0

    for key, value in entries:
        e = pack_entry(key, value)
        if now and at + len(e) + 4 * (len(now) + 1) + 4 > block_size:
            close()
        now.append(e)
        at, last = at + len(e), key
    if now:
        close()
    tail = b"".join(index)
    return b"".join(blocks) + tail + _U32.pack(len(tail))


def table_entries(raw: bytes) -> Iterator[Entry]:
    """The entries of a table, in key order."""
    try:
        size = _U32.unpack_from(raw, len(raw) - 4)[0]
        at, end, sizes = len(raw) - 4 - size, len(raw) - 4, []
        if at < 0:
            raise SegmentError("the index is longer than the file")
        while at < end:
            block, k = struct.unpack_from("<II", raw, at)
            sizes.append(block)
            at += 8 + k
        start = 0
        for block in sizes:
            n, pos = _U32.unpack_from(raw, start + block - 4)[0], start
            for _ in range(n):
                key, value, pos = unpack_entry(raw, pos)
                yield key, value
            start += block
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise SegmentError(f"not a table: {e}") from e


def log_bytes(changes: Iterable[Entry]) -> bytes:
    return b"".join(b"\0" + pack_entry(k, v) for k, v in changes)


def log_entries(raw: bytes) -> Iterator[Entry]:
    """The changes of a log; a record that the end of the file cuts short was never acknowledged."""
    at = 0
    while at < len(raw):
        if raw[at] != 0:
            raise LogError(f"operation {raw[at]} at {at}")
        try:
            key, value, end = unpack_entry(raw, at + 1)
        except (struct.error, IndexError, SegmentError) as e:
            if isinstance(e, SegmentError) and "cut short" not in str(e):
                raise LogError(str(e)) from e
            return
        yield key, value
        at = end


#: Bytes of entries that a table written here holds.
TABLE_BYTES = 64 << 20
_TABLES = "name string, smallest string, largest string"


def write_tables(run: DataFrame, files: Files, n_ranges: int, table_size: int = TABLE_BYTES) -> list[dict]:
    """Write a folded run (key, value, deleted) as tables with disjoint key ranges; the manifest's entry of each, by key.

    A task sorts one key range and writes tables of about ``table_size`` bytes, holding one at a time.
    """
    ship(run.sparkSession)
    root = files.root

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entry] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            name = f"{uuid.uuid4().hex}.sst"
            with open_uri(f"{root}/{name}", "w") as f:
                f.write(table_bytes(held))
            out = pa.RecordBatch.from_pydict({"name": [name], "smallest": [held[0][0]], "largest": [held[-1][0]]})
            held, size = [], 0
            return out

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((key, value))
                size += 9 + len(key) + len(value or b"")
                if size >= table_size:
                    yield close()
        if held:
            yield close()

    rows = run.select("key", F.when(~F.col("deleted"), F.col("value").cast("binary")).alias("value"))
    dealt = rows.repartitionByRange(max(1, n_ranges), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(write, _TABLES).collect()
    return [{"key_range": {"smallest": t["smallest"], "largest": t["largest"]}, "sstable": t["name"]} for t in sorted(found, key=lambda t: t["smallest"])]


def write_database(runs: list[DataFrame], root: str, n_ranges: int = 1, table_size: int = TABLE_BYTES) -> None:
    """Write a whole database from folded runs, newest first: run n becomes level n. ``root`` must hold none.

    Tables first, then the manifest, then ``CURRENT``, so a failure before the end leaves no database.
    """
    files = Files(runs[0].sparkSession, root)
    if files.exists("CURRENT"):
        raise ManifestError(f"{root} holds a database")
    files.make_dirs()
    ops: list[dict] = []
    for level in range(len(runs) - 1, -1, -1):
        tables = write_tables(runs[level], files, n_ranges, table_size)
        # a level is reached through all levels above it, which are empty so far
        ops += [{"MergeLevel": {"to_level": to, "sstables": [[t["key_range"], t["sstable"]] for t in tables]}} for to in range(1, level + 1)]
        if level == 0:
            for i, t in enumerate(tables):
                ops += [{"NewLog": {"filename": f"LOG.{i}"}}, {"AddSSTable": t}]
            log = f"LOG.{len(tables)}"
            files.create(log, b"")
            ops.append({"NewLog": {"filename": log}})
    files.create("MANIFEST-0", "\n".join(json.dumps(o) for o in ops).encode())
    files.replace("CURRENT", b"MANIFEST-0")


def live_files(files: Files) -> tuple[list[list[str]], list[str]]:
    """Tables of each level (level 0: oldest first) and logs (oldest first), by replaying the manifest."""
    if not files.exists("CURRENT"):
        raise ManifestError("no CURRENT")
    levels: list[list[str]] = [[]]
    logs: list[str] = []
    for line in files.read(files.read("CURRENT").decode().strip()).decode().split("\n"):
        if not line.strip():
            continue
        kind, body = next(iter(json.loads(line).items()))
        if kind == "NewLog":
            logs.append(body["filename"])
        elif kind == "AddSSTable":
            levels[0].append(body["sstable"])
            del logs[:1]
        elif kind == "MergeLevel":
            to = body["to_level"]
            if not 1 <= to <= len(levels):
                raise ManifestError(f"cannot merge into level {to} of {len(levels)}")
            levels += [[]] * (to == len(levels))
            levels[to - 1], levels[to] = [], [name for _, name in body["sstables"]]
        else:
            raise ManifestError(f"unknown operation {kind}")
    return levels, logs


def read_database(spark: SparkSession, root: str) -> DataFrame:
    """key, value, deleted and seq of the newest entry of each key of such a database. Files are parsed by the executors, one at a time."""
    ship(spark)
    files = Files(spark, root)
    levels, logs = live_files(files)
    oldest_first = [*(n for level in reversed(levels[1:]) for n in level), *levels[0], *logs]
    age = {name.rsplit("/", 1)[-1]: i for i, name in enumerate(oldest_first)}
    own_logs = {n.rsplit("/", 1)[-1] for n in logs}

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                name = path.rsplit("/", 1)[-1]
                entries = list((log_entries if name in own_logs else table_entries)(bytes(raw)))
                yield pd.DataFrame({"key": [k for k, _ in entries], "value": [v for _, v in entries], "deleted": [v is None for _, v in entries], "seq": [(age[name] << 40) + i for i in range(len(entries))]})

    schema = "key string, value binary, deleted boolean, seq long"
    if not oldest_first:
        return spark.createDataFrame([], schema)
    paths = [n if n.startswith("/") and not files.exists(n.rsplit("/", 1)[-1]) else files.url(n.rsplit("/", 1)[-1]) for n in oldest_first]
    raw = spark.read.format("binaryFile").load(paths).select("path", F.col("content"))
    return newest_wins(raw.mapInPandas(parse, schema))
