"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Texts are compared in a plain form (A-Z as a-z, each run of white space as one blank). A benchmark item is cut into probes of ``PROBE`` bytes, the
last one of up to half as many more or less; equal probes are one. A probe of m bytes occurs in a text if some part of the text is within
k = floor(``RATE`` * m) edits. By the q-gram lemma k edits destroy at most k * q of the probe's m + 1 - q q-grams and shift positions by k at
most, so the others lie on at most k + 1 neighbouring diagonals (text position minus probe position). So:

1. The q-grams of a probe that few probes hold (``COMMON``) are indexed, but at least its k * q + 1 rarest; of s indexed ones an occurrence has at
   least s - k * q. What a whole benchmark shares, such as a fixed instruction, is so looked up only where a probe has little else.
2. Every position of a text is looked up in the table of indexed q-grams (8 bytes, exact), and only stretches with enough of
   them to reach the bound of some probe are looked at further.
3. Their shared q-grams are counted for each probe in bands of 2 (k + 1) diagonals that overlap by half, so that any k + 1
   neighbouring diagonals lie in one band; bands that reach the bound are kept. Positions are worked through in slices of at most ``POSTINGS``
   postings, and the counts of a text are judged as soon as its last slice is done.
4. Kept bands must also share enough of the probe's 3-grams (the same lemma), and are then aligned, with free ends in the text, within their
   diagonals widened by k. What is within k edits is a match.

No step samples or caps anything. The documents are scanned where they lie: no shuffle. The benchmark is the stated query set; its
index is built and broadcast in blocks of at most ``BLOCK_BYTES`` of text, one at a time, one pass over the documents for each block.

Defined cases: null and empty texts match nothing; items whose bound would be below ``LEAST`` q-grams get fewer edits, down to none;
items under ``Q`` bytes match exactly, as whole words; null and empty items match nothing; repeated items match each under its own id; repeated
documents are judged one by one; long texts are read whole; empty tables give empty results; other columns are ignored or, in
``drop_contaminated``, handed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.runtime import materialize, streamed
from emberlog.llm.textblock import buffers, large, row_ranges, spread

Q, RATE, PROBE, LEAST = 8, 0.08, 200, 8
#: Probes that may hold a q-gram that is not common; postings looked at together; candidates counted or aligned together.
COMMON, POSTINGS, AT_ONCE = 32, 1 << 19, 512
BLOCK_BYTES = 4 << 20
_TABLE_BITS = 21
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in the plain form and the offsets of each text in them."""
    data = _FOLD[data]
    keep = np.ones(len(data) + 1, bool)
    keep[1:-1] = (data[1:] != 32) | (data[:-1] != 32)
    starts = off[:-1][off[:-1] < off[1:]]
    keep[starts] = True
    keep = keep[:-1]
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1] | (data[1:].astype(np.uint32) << np.uint32(8))
    four = two[:-2] | (two[2:] << np.uint32(16))
    return four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))


def slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def cut(raw: np.ndarray) -> list[np.ndarray]:
    """Probes of an item: ``PROBE`` bytes each; what is left at the end is a probe if it is half as long, or else part of the last one."""
    n = max(1, len(raw) // PROBE + (len(raw) % PROBE >= PROBE // 2))
    return [raw[i * PROBE : (i + 1) * PROBE if i < n - 1 else len(raw)] for i in range(n)]


@dataclass
class ProbeIndex:
    """The q-grams of a block of probes."""

    item: np.ndarray  # item ids of all probes, one probe after another
    item_first: np.ndarray  # where each probe's begin (and the end)
    text: list[np.ndarray]
    edits: np.ndarray  # k of each probe
    bound: np.ndarray  # indexed q-grams that an occurrence has at least
    table: np.ndarray  # one byte for each slot
    keys: np.ndarray  # distinct indexed q-grams, sorted
    first: np.ndarray  # postings of keys[i] are first[i]:first[i+1]
    probe: np.ndarray
    at: np.ndarray
    groups: list[tuple[int, int]]  # (window, least q-grams) of probes of like length and bound
    short: list[tuple[int, bytes]]  # items under Q bytes

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], rate: float = RATE) -> "ProbeIndex":
        owners: dict[bytes, list[int]] = {}
        short: list[tuple[int, bytes]] = []
        for number, body in items:
            raw = np.frombuffer((body or "").strip().encode(), np.uint8)
            raw = plain(raw, np.array([0, len(raw)]))[0] if len(raw) else raw
            if 0 < len(raw) < Q:
                short.append((number, raw.tobytes()))
            elif len(raw):
                for p in cut(raw):
                    own = owners.setdefault(p.tobytes(), [])
                    own += [number] * (number not in own[-1:])
        text = [np.frombuffer(p, np.uint8) for p in owners]
        lengths = np.array([len(p) for p in text], np.int64)
        edits = (rate * lengths).astype(np.int64)
        while (poor := (edits > 0) & (lengths + 1 - Q - edits * Q < LEAST)).any():
            edits[poor] -= 1
        g = [grams(p) for p in text]
        flat = np.concatenate(g) if g else np.zeros(0, np.uint64)
        probe, at = np.repeat(np.arange(len(g)), lengths + 1 - Q), spread(np.zeros(len(g), np.int64), lengths + 1 - Q)
        # in how many probes a q-gram is, at most
        _, where, held = np.unique(flat, return_inverse=True, return_counts=True)
        held = held[where] if len(flat) else held
        rank = np.lexsort((held, probe))
        place = spread(np.zeros(len(g), np.int64), lengths + 1 - Q)  # of each in its probe, rarest first
        chosen = np.zeros(len(flat), bool)
        chosen[rank] = (held[rank] <= COMMON) | (place <= (edits * Q)[probe])
        bound = np.bincount(probe[chosen], minlength=len(g)) - edits * Q
        flat, probe, at = flat[chosen], probe[chosen], at[chosen]
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[slot(keys)] = True
        spans: dict[tuple[int, int], tuple[int, int]] = {}
        for m, k, b in zip(lengths.tolist(), edits.tolist(), bound.tolist()):
            c = (m.bit_length() * 2 + (m >> (m.bit_length() - 2) & 1), b.bit_length())
            w, least = spans.get(c, (0, 1 << 30))
            spans[c] = (max(w, m + k - Q + 1), min(least, b))
        numbers = list(owners.values())
        item = np.array([i for own in numbers for i in own], np.int64)
        item_first = np.concatenate([[0], np.cumsum([len(own) for own in numbers])]).astype(np.int64)
        return cls(item, item_first, text, edits, bound, table, keys, np.append(first, len(flat)), probe[order], at[order], sorted(spans.values()), short)

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, item id, edits, first byte, bytes) of each item that occurs in the plain texts, one row for each text and item."""
        found = [self._short(data, off)]
        for owner, probe, band in self._candidates(data, off):
            start = (band - 1) * (self.edits[probe] + 1) - 4096
            near = self._near(data, off, owner, probe, start)
            owner, probe, start = owner[near], probe[near], start[near]
            edits, left, length = self._align(data, off, owner, probe, start)
            ok = edits <= self.edits[probe]
            owner, probe, edits, left, length = (x[ok] for x in (owner, probe, edits, left, length))
            n = self.item_first[probe + 1] - self.item_first[probe]
            item = self.item[spread(self.item_first[probe], n)]
            found.append(_best(*(np.repeat(x, n) for x in (owner,)), item, *(np.repeat(x, n) for x in (edits, left, length))))
        return _best(*(np.concatenate(x) for x in zip(*found)))

    def _short(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Items under ``Q`` bytes, where they stand between blanks or ends of a text."""
        raw, rows = data.tobytes() if self.short else b"", []
        for number, body in self.short:
            a = raw.find(body)
            while a >= 0:
                b, own = a + len(body), int(np.searchsorted(off, a, side="right")) - 1
                if b <= off[own + 1] and (a == off[own] or raw[a - 1] == 32) and (b == off[own + 1] or raw[b] == 32):
                    rows.append((own, number, 0, a - int(off[own]), len(body)))
                a = raw.find(body, a + 1)
        return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))

    def _candidates(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, probe, band) wherever a band of a text has as many of the probe's indexed q-grams as its bound, some texts at a time."""
        g = grams(data)
        if not len(g) or not len(self.keys):
            return
        hit = self.table[slot(g)]
        # q-grams that run over a text's end belong to none
        for o in range(1, Q):
            ends = off[1:-1] - o
            hit[ends[(ends >= 0) & (ends < len(hit))]] = False
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        near = np.zeros(len(g) + 1, np.int32)
        for window, least in self.groups:
            w = min(window, len(g))
            begin = np.flatnonzero(total[w:] - total[:-w] >= least)
            np.add.at(near, begin, 1)
            np.add.at(near, begin + w, -1)
        at = np.flatnonzero(hit & (np.cumsum(near)[:-1] > 0))
        where = np.searchsorted(self.keys, g[at])
        where[where == len(self.keys)] = 0
        right = self.keys[where] == g[at]
        at, where = at[right], where[right]
        n = self.first[where + 1] - self.first[where]
        owner = np.searchsorted(off, at, side="right") - 1
        ends, a = np.cumsum(n), 0
        n_bands = int((np.diff(off).max(initial=0) + 8192)) + 2
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, side="right")))
            posting = spread(self.first[where[a:b]], n[a:b])
            own, pos, probe = np.repeat(owner[a:b], n[a:b]), np.repeat(at[a:b], n[a:b]), self.probe[posting]
            diagonal = pos - off[own] - self.at[posting] + 4096  # above zero, as probes are shorter
            code = (own * len(self.text) + probe) * n_bands + diagonal // (self.edits[probe] + 1)
            # each diagonal lies in two bands
            new, number = np.unique(np.concatenate([code, code + 1]), return_counts=True)
            merged, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, number])).astype(np.int64)
            codes, a = merged, b
            # texts before the next position's are done
            done = len(codes) if a == len(at) else int(np.searchsorted(codes, owner[a] * len(self.text) * n_bands))
            pair, band = np.divmod(codes[:done], n_bands)
            text, probe = np.divmod(pair, len(self.text))
            full = counts[:done] >= self.bound[probe]
            if full.any():
                yield text[full], probe[full], band[full]
            codes, counts = codes[done:], counts[done:]

    def _regions(self, data: np.ndarray, off: np.ndarray, own: np.ndarray, p: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Lengths of some probes, their bytes in rows, the text bytes that their widened bands reach (255, which UTF-8 never has, outside the text), and the bands' width."""
        m, width = np.array([len(self.text[i]) for i in p]), int((4 * self.edits[p] + 2).max())
        pattern = np.zeros((len(p), int(m.max())), np.uint8)
        for i, q in enumerate(p):
            pattern[i, : m[i]] = self.text[q]
        index = off[own][:, None] + low[:, None] + np.arange(pattern.shape[1] + width)
        inside = (index >= off[own][:, None]) & (index < off[own + 1][:, None])
        return m, pattern, np.where(inside, data[np.clip(index, 0, len(data) - 1)], 255), width

    def _near(self, data: np.ndarray, off: np.ndarray, owner: np.ndarray, probe: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which candidates share at least m - 2 - 3 k of the probe's 3-grams within their widened bands."""
        out = np.zeros(len(owner), bool)
        three = lambda x: x[:, :-2].astype(np.uint32) | (x[:, 1:-1].astype(np.uint32) << np.uint32(8)) | (x[:, 2:].astype(np.uint32) << np.uint32(16))
        for a in range(0, len(owner), AT_ONCE):
            own, p = owner[a : a + AT_ONCE], probe[a : a + AT_ONCE]
            k = self.edits[p]
            m, pattern, region, width = self._regions(data, off, own, p, start[a : a + AT_ONCE] - k)
            wanted, there = three(pattern), three(region)
            shared = np.zeros(wanted.shape, bool)
            for d in range(width):
                shared |= there[:, d : d + wanted.shape[1]] == wanted
            shared &= np.arange(wanted.shape[1]) < (m - 2)[:, None]
            out[a : a + len(p)] = shared.sum(axis=1) >= m - 2 - 3 * k
        return out

    def _align(self, data: np.ndarray, off: np.ndarray, owner: np.ndarray, probe: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each probe within its band, the first byte and the length of that part of the text."""
        out = [np.zeros(len(owner), np.int64) for _ in range(3)]
        for a in range(0, len(owner), AT_ONCE):
            own, p, s = owner[a : a + AT_ONCE], probe[a : a + AT_ONCE], start[a : a + AT_ONCE]
            low = s - self.edits[p]
            m, pattern, region, width = self._regions(data, off, own, p, low)
            rows = pattern.shape[1]
            cols = np.arange(width, dtype=np.int32)
            cost = np.zeros((len(p), width), np.int32)
            origin = np.broadcast_to(cols, cost.shape).copy()
            last, where, came = np.full(len(p), 1 << 20, np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for i in range(rows):
                # packed so that a minimum carries the origin of its path: cost in the high bits
                packed = (cost.astype(np.int64) << 20) | origin
                best = packed + ((region[:, i : i + width] != pattern[:, i : i + 1]).astype(np.int64) << 20)
                best[:, :-1] = np.minimum(best[:, :-1], packed[:, 1:] + (1 << 20))
                slope = cols.astype(np.int64) << 20
                best = np.minimum.accumulate(best - slope, axis=1) + slope
                cost, origin = (best >> 20).astype(np.int32), (best & ((1 << 20) - 1)).astype(np.int32)
                done = np.flatnonzero(m == i + 1)
                if len(done):
                    j = cost[done].argmin(axis=1)
                    last[done], where[done], came[done] = cost[done, j], j, origin[done, j]
            out[0][a : a + len(p)], out[1][a : a + len(p)], out[2][a : a + len(p)] = last, low + came, m + where - came
        return tuple(out)


def _best(owner: np.ndarray, item: np.ndarray, edits: np.ndarray, left: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the rows of one text and item the one with the fewest edits; of these the first in the text."""
    order = np.lexsort((length, left, edits, item, owner))
    owner, item, edits, left, length = (x[order] for x in (owner, item, edits, left, length))
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])
    return owner[new], item[new], edits[new], left[new], length[new]


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in lists of about ``block_bytes`` of text, each fetched on its own."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield sorted(((r["item"], r["text"]) for r in part.collect() if r["item"] is not None), key=lambda x: (x[0], x[1] or ""))


def _matches(texts: pa.Array, index: ProbeIndex) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    for lo, hi in row_ranges(texts):
        data, off = buffers(texts.slice(lo, hi - lo))
        yield lo, index.find(*plain(data, off))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document and item that occurs in it: doc_id, item_id, n_edits, start and n_bytes in the plain text."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc_ids = batch.column("doc_id")
                for lo, (own, item, edits, left, length) in _matches(large(batch.column("text")), shared.value):
                    if len(own):
                        yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(lo + own)), *map(pa.array, (item, edits, left, length))], ["doc_id", "item_id", "n_edits", "start", "n_bytes"])

        return run

    schema = "doc_id long, item_id long, n_edits long, start long, n_bytes long"
    done, last = [], None
    for b in blocks(benchmark):
        if last is not None:  # there is another block: this one's matches are written and its index goes first
            done.append(materialize(rows.mapInArrow(streamed(scan(last)), schema), "benchmark-matches"))
            last.destroy()
        last = context.broadcast(ProbeIndex.build(b))
    done += [rows.mapInArrow(streamed(scan(last)), schema)] if last is not None else []
    return reduce(DataFrame.unionAll, done) if done else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item occurs.

    All blocks of the benchmark but the last are applied one after another, each to what the ones before have left, written to the shared folder.
    """
    context, place = docs.sparkSession.sparkContext, docs.columns.index(text)

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, (own, *_) in _matches(large(batch.column(place)), shared.value):
                    clean[lo + own] = False
                yield batch.filter(pa.array(clean))

        return run

    last = None
    for b in blocks(benchmark):
        if last is not None:
            docs = materialize(docs.mapInArrow(streamed(keep(last)), docs.schema), "benchmark-kept")
            last.destroy()
        last = context.broadcast(ProbeIndex.build(b))
    return docs if last is None else docs.mapInArrow(streamed(keep(last)), docs.schema)
