"""Words and their hashes for a column of texts, as array operations over the column's bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A column is worked through in row ranges of about so many bytes; a longer text is a range of its own.
CHUNK_BYTES = 1 << 20

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_LOW = 12
_BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), np.uint64(base)))])[:n].astype(np.uint64)


_POW_LOW, _INV_LOW = _powers(_R, 1 << _LOW), _powers(_R_INV, 1 << _LOW)


def _high(base: int, n: int) -> np.ndarray:
    return _powers(pow(base, 1 << _LOW, 2**64), n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each position from the hashes of several words, order kept."""
    out = np.full(len(parts[0]), 0x1234567 + len(parts), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + p)
    return out


def large(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offsets of each text, from 0."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def row_ranges(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each that cover all rows."""
    off, lo = buffers(texts)[1], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


@dataclass
class Words:
    """``first[i] : first[i + 1]`` are the words of text i; start and end are byte positions."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Words (runs without white space) of each text, with a 64-bit hash of each; A-Z count as a-z if ``lower``."""
    data, off = buffers(texts)
    n = len(data)
    space = np.ones(n + 1, bool)
    space[:n] = _IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = space[: n - 1]
    start = np.flatnonzero(~space[:n] & (before | edge[:n]))
    end = np.flatnonzero(~space[:n] & (space[1:] | edge[1:])) + 1
    first = np.searchsorted(start, off, side="left")
    if not len(start):
        return Words(start, end, first, np.zeros(0, np.uint64))
    with np.errstate(over="ignore"):
        total = np.multiply.outer(_high(_R, (n >> _LOW) + 1), _POW_LOW).ravel()[:n]
        total *= (_FOLDED if lower else _BYTES)[data]
        np.cumsum(total, out=total)
        h = total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))
        h *= _high(_R_INV, (n >> _LOW) + 1)[start >> _LOW] * _INV_LOW[start & ((1 << _LOW) - 1)]
        return Words(start, end, first, mix(h))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word window within a text, and the start of each text's windows.

    A text with words but fewer than k gives the whole sequence as its one window.
    """
    n, count = len(words.hash), words.count
    lengths = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    first = np.concatenate([[0], np.cumsum(lengths)])
    at = spread(words.first[:-1], lengths)
    padded = np.concatenate([words.hash, np.zeros(k, np.uint64)])
    out = combine([padded[at + j] for j in range(k)]) if n else np.zeros(0, np.uint64)
    for i in np.flatnonzero((count > 0) & (count < k)):
        own = words.hash[words.first[i] : words.first[i + 1]]
        out[first[i]] = combine([own[j : j + 1] for j in range(len(own))])[0]
    return out, first


def _pack_planes(planes: np.ndarray) -> bytes:
    """Byte planes, each compressed on its own where that is shorter (an entropy coder needs a table for each); a plane of zeros is left out."""
    parts = []
    for plane in planes:
        raw = plane.tobytes() if plane.any() else b""
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        parts.append(small if len(small) < len(raw) else raw)
    head = np.array([planes.shape[1], *map(len, parts)], "<u4")
    return b"".join([head.tobytes(), *parts])


def _unpack_planes(raw: bytes, k: int) -> np.ndarray:
    n, *lengths = np.frombuffer(raw, "<u4", k + 1).tolist() if raw else [0] * (k + 1)
    out, at = np.zeros((k, n), np.uint8), 4 * (k + 1)
    for plane, length in zip(out, lengths):
        if length:
            own = raw[at : at + length]
            plane[:] = np.frombuffer(own if length == n else pa.decompress(own, n, codec="zstd"), np.uint8)
        at += length
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences in byte planes."""
    gaps = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    return _pack_planes(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpack_planes(raw, 8).T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts below 2**32 as byte planes."""
    return _pack_planes(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack_planes(raw, 4).T).view("<u4").ravel().astype(np.int64)
