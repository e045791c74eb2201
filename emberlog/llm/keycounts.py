"""Counts over the whole corpus, sent back to where they are needed.

Documents are dealt into blocks of about ``BLOCK_BYTES`` of text. A block lists its distinct keys (64-bit hashes) with their own counts, sorted
and cut into buckets by key range. A bucket adds up what all blocks say of its keys and answers each block with the sums, in the
order in which that block sent its keys. So every block learns the corpus-wide count of each of its keys, exactly; a key
that most documents hold costs one entry for each block; nothing is broadcast; and a task holds one block or one bucket.
Both are lost and made again as any shuffle is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.runtime import grouped
from emberlog.llm.textblock import pack_counts, pack_keys, unpack_counts, unpack_keys

BLOCK_BYTES = 8 << 20
#: Keys that a bucket is meant to get.
BUCKET_KEYS = 2_000_000
ASKED = "block long, bucket int, kind int, keys binary, counts binary"
ANSWERED = "block long, bucket int, kind int, counts binary, bin int, n_types long, n_sum long"


def sizes(docs: DataFrame, text: str, keys_per_byte: float) -> tuple[int, int]:
    """Numbers of blocks and buckets for ``docs``."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES)), max(1, int(total * keys_per_byte / BUCKET_KEYS) + 1)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The key range of each key, below 2**32 ranges."""
    return ((np.asarray(keys, np.uint64) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def ask(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``ASKED`` for a block's distinct sorted keys, in the time that its keys take, however many buckets there are."""
    bucket = bucket_of(keys, n_buckets)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    full, spans = bucket[begin], list(zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]))
    yield pa.RecordBatch.from_pydict(
        {"block": pa.array([block] * len(full), pa.int64()), "bucket": pa.array(full, pa.int32()), "kind": pa.array([kind] * len(full), pa.int32()), "keys": pa.array([pack_keys(keys[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([pack_counts(counts[a:b]) for a, b in spans], pa.binary())}
    )


def no_rows() -> pa.Table:
    return pa.Table.from_pydict({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})


def bin_of(counts: np.ndarray) -> np.ndarray:
    """Each count up to 32 has a bin; above, eight bins share a doubling."""
    return np.where(counts <= 32, counts, 32 + np.ceil(8 * np.log2(np.maximum(counts, 1) / 32))).astype(np.int64)


def ask_nothing(block: int, kind: int, counts: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """A row of ``ASKED`` that adds keys which no other block can hold to the statistics: how many have each count. The kind is negative."""
    values, types = np.unique(counts, return_counts=True)
    yield pa.RecordBatch.from_pydict(
        {"block": pa.array([block], pa.int64()), "bucket": pa.array([block % n_buckets], pa.int32()), "kind": pa.array([-kind], pa.int32()), "keys": pa.array([pack_keys(values.astype(np.uint64))], pa.binary()), "counts": pa.array([pack_counts(types)], pa.binary())}
    )


def _binned(bucket: int, kind: int, counts: np.ndarray, n_types: np.ndarray) -> pa.RecordBatch:
    """Statistics rows for ``n_types`` keys of each count."""
    bins = bin_of(counts)
    types, sums = np.bincount(bins, n_types).astype(np.int64), np.bincount(bins, counts * n_types).astype(np.int64)
    full = np.flatnonzero(types)
    n = len(full)
    return pa.RecordBatch.from_pydict(
        {"block": pa.array([-1] * n, pa.int64()), "bucket": pa.array([bucket] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "counts": pa.nulls(n, pa.binary()), "bin": pa.array(full, pa.int32()), "n_types": pa.array(types[full], pa.int64()), "n_sum": pa.array(sums[full], pa.int64())}
    )


def add_up(table: pa.Table, statistics: bool) -> Iterator[pa.RecordBatch]:
    """The answers of one bucket and, with ``statistics``, how many keys have a count of each bin (block -1)."""
    kinds, blocks, bucket = table["kind"].to_numpy(), table["block"].to_numpy(), table["bucket"][0].as_py()
    raw_keys, raw_counts = table["keys"], table["counts"]
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        if kind < 0:
            for i in rows if statistics else ():
                yield _binned(bucket, -kind, unpack_keys(raw_keys[int(i)].as_py()).astype(np.int64), unpack_counts(raw_counts[int(i)].as_py()))
            continue
        parts = [unpack_keys(raw_keys[int(i)].as_py()) for i in rows]
        length = np.array([len(p) for p in parts])
        own = np.concatenate([unpack_counts(raw_counts[int(i)].as_py()) for i in rows])
        keys = np.concatenate(parts)
        del parts
        order = np.argsort(keys)
        keys = keys[order]
        group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)]))
        totals = np.bincount(group, own[order]).astype(np.int64)
        answer = np.empty(len(keys), np.int64)
        answer[order] = totals[group]
        ends = np.cumsum(length)
        n = len(rows)
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(blocks[rows], pa.int64()), "bucket": pa.array([bucket] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "counts": pa.array([pack_counts(answer[e - k : e]) for e, k in zip(ends, length)], pa.binary()), "bin": pa.nulls(n, pa.int32()), "n_types": pa.nulls(n, pa.int64()), "n_sum": pa.nulls(n, pa.int64())}
        )
        if statistics:
            yield _binned(bucket, kind, totals, np.ones(len(totals), np.int64))


def answered(asked: DataFrame, statistics: bool = False) -> DataFrame:
    """The answers of all buckets to rows of ``ASKED``."""
    return asked.groupBy("bucket").applyInArrow(grouped(lambda t: pa.Table.from_batches(list(add_up(t, statistics)))), ANSWERED)


def answer_for(table: pa.Table, kind: int) -> np.ndarray:
    """Counts of a block's sorted distinct keys, from its answers."""
    rows = np.flatnonzero(table["kind"].to_numpy() == kind)
    buckets, raw = table["bucket"].to_numpy()[rows], table["counts"]
    return np.concatenate([unpack_counts(raw[int(i)].as_py()) for i in rows[np.argsort(buckets)]]) if len(rows) else np.zeros(0, np.int64)
