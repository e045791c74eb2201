"""Tokenizing by distinct segments.

A text is cut where the tokenizer is certain to cut it as well, so its ids are the ids of its segments, one after
another. Each distinct segment is encoded once by the tokenizers library and kept in a bounded cache; nothing depends on
whether it is still there.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from emberlog.llm.textblock import buffers, spread

#: Bytes that begin a UTF-8 sequence which may be white space outside ASCII; no cut is made beside these.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # no apostrophe
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


class SegmentCache:
    """Segment (bytes) -> value (bytes), of at most twice ``most`` segments: when half is full, the older half goes."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = 100_000) -> None:
        self.encode, self.most, self.new, self.old = encode, most, {}, {}

    def __call__(self, keys: list[bytes]) -> list[bytes]:
        new, old = self.new, self.old
        out = list(map(new.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing and old:
            for i, v in zip(missing, [old.get(keys[i]) for i in missing]):
                out[i] = v
            missing = [i for i in missing if out[i] is None]
        if missing:
            for i, v in zip(missing, self.encode([keys[i] for i in missing])):
                out[i] = new[keys[i]] = v
        if len(new) > self.most:
            self.old, self.new = new, {}
        return out


def cuts_at_blanks(data: np.ndarray, off: np.ndarray, newline: bool = True) -> np.ndarray:
    """Segment starts (text starts included) for byte-level BPE with the usual pre-tokenizer pattern.

    A single space between two characters that are not white space begins a pre-token there, whatever stands
    around it; a single line feed there is a pre-token of its own. A run of letters ends before a punctuation mark and
    starts after one, but for the apostrophe.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    if n >= 3:
        blank, doubt = _BLANK[data], _DOUBT[data]
        sure = np.zeros(n, bool)
        sure[1:-1] = ~blank[:-2] & ~blank[2:] & ~doubt[2:] & ~doubt[:-2]
        sure[2:] &= ~doubt[:-2]
        sure[3:] &= ~doubt[:-3]
        inner = ~cut[:n]
        inner[:-1] &= ~cut[1:n]
        sure &= inner
        cut[:n] |= sure & (data == 32)
        if newline:
            feed = np.flatnonzero(sure & (data == 10))
            cut[feed] = cut[feed + 1] = True
    if n >= 2:
        letter, point = _LETTER[data], _POINT[data]
        # Latin-1 letters: C3 and a continuation byte other than those of the signs x and :
        late = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        ends = letter.copy()
        ends[1:] |= late
        begins = letter.copy()
        begins[:-1] |= late
        cut[1:n] |= (ends[:-1] & point[1:]) | (point[:-1] & begins[1:])
    return np.flatnonzero(cut[:n])


class Segmented:
    """Texts as indices into their distinct segments."""

    def __init__(self, texts: pa.Array, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        data, off = buffers(texts)
        self.start = cuts(data, off)
        self.first = np.searchsorted(self.start, off, side="left")
        ends = np.concatenate([self.start, [len(data)]]).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        self.index = np.asarray(pieces.indices, np.int64)
        self.distinct: list[bytes] = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.length = np.diff(ends)


def ids_of(seg: Segmented, cache: SegmentCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, the position of each text's first id (and the end), and the number of ids of each segment."""
    values = cache(seg.distinct)
    own = np.fromiter(map(len, values), np.int64, len(values)) >> 2
    flat, begin = np.frombuffer(b"".join(values), "<u4"), np.cumsum(own) - own
    each = own[seg.index] if len(own) else np.zeros(0, np.int64)
    ids = flat[spread(begin[seg.index], each)] if len(own) else np.zeros(0, np.uint32)
    return ids, np.concatenate([[0], np.cumsum(each)])[seg.first], each


def byte_bpe(path: str, most: int = 100_000) -> SegmentCache:
    """The cached encoder for a byte-level BPE file of the tokenizers library; ``most`` is that of the cache."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    # one pre-token for certain: its bytes, as the model writes them, go to the model at once
    single = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+)").fullmatch
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    one = tokenizer.model.tokenize

    def written(key: bytes) -> str:
        # of ASCII such a segment has only a blank that is written otherwise
        return key.decode("latin-1").replace(" ", chr(table[32])) if key.isascii() else key.decode("latin-1").translate(table)

    def encode(keys: list[bytes]) -> list[bytes]:
        out = [array("I", [t.id for t in one(written(k))]).tobytes() if single(k) else None for k in keys]
        rest = [i for i, v in enumerate(out) if v is None]
        for i, e in zip(rest, tokenizer.encode_batch_fast([keys[i].decode() for i in rest], add_special_tokens=False) if rest else []):
            out[i] = array("I", e.ids).tobytes()
        return out

    return SegmentCache(encode, most)


_OPEN: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]):
    """One object for each key and worker process, kept from task to task."""
    if key not in _OPEN:
        _OPEN[key] = make()
    return _OPEN[key]
