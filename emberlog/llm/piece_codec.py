"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed here and rebuilt from the library's parts: normaliser (the precompiled character map, if any, and
the handling of blanks), the metaspace marker U+2581, the model (unigram scores, or merges ordered by the pieces' scores for
a BPE model) and byte fallback. Batches are encoded and decoded by the library's own threads (``THREADS`` in a worker, unless RAYON_NUM_THREADS says otherwise).

No symbol of either model spans two bytes that no piece holds next to each other. With an identity normaliser and byte
fallback, a text can therefore be cut at such places and each distinct segment encoded once. Every distinct
segment's ids are compared with those of the sentencepiece library when it is first met. That library only verifies: the ids returned are those of
the rebuilt tokenizer, and ``n_differing`` counts a document's segments for which the two differ. Models with another normaliser are encoded
and compared text by text. Ids are decoded by the rebuilt decoder: marker, byte fallback, leading blank.

Defined cases: null and empty texts have no ids and decode to the empty text; control characters, unknown characters and
blanks of any number survive; a text that holds U+2581 itself decodes to a blank there and reports ``round_trip`` false;
repeated rows give repeated results; columns other than the two named are not read. Ids of control and unused pieces decode to nothing, unknown ones to
the model's surface for them, each byte of a run of byte pieces that is no UTF-8 to U+FFFD (encoded texts hold none).
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.runtime import streamed
from emberlog.llm.segments import SegmentCache, Segmented, ids_of, once
from emberlog.llm.textblock import buffers, large, row_ranges

#: Field values of the public protobuf definition.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: Threads of the library in each worker process.
THREADS = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        if size is None:
            if key & 7 != 2:
                raise ValueError("not a sentencepiece model")
            size = varint()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What the protobuf says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    unk_surface: str = " ⁇ "

    @classmethod
    def parse(cls, raw: bytes) -> "PieceModel":
        out = cls()
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                out.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
                out.unk_surface = own[44].decode() if 44 in own else out.unk_surface
            elif number == 3:
                own = dict(_fields(value))
                out.charsmap = own.get(2, out.charsmap)
                out.dummy_prefix, out.squeeze = bool(own.get(3, out.dummy_prefix)), bool(own.get(4, out.squeeze))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are known")
        return out

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, best piece first."""
        own = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED)}
        ranked = sorted((p for p in own if len(p) > 1), key=lambda p: (-self.pieces[own[p]][1], own[p]))
        return [(p[:j], p[j:]) for p in ranked for j in range(1, len(p)) if p[:j] in own and p[j:] in own]

    def tokenizer(self, normalise: bool = True):
        from tokenizers import Regex, Tokenizer, models, normalizers

        if self.kind == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        out = Tokenizer(model)
        if normalise:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            if self.squeeze:
                steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
            steps += [normalizers.Prepend(MARK)] * self.dummy_prefix + [normalizers.Replace(" ", MARK)]
            out.normalizer = normalizers.Sequence(steps)
        out.decoder = self.decoder()
        return out

    def decoder(self, unknown: bool = False):
        """From the strings of pieces to a text; ``unknown``: for ids that may hold the unknown piece."""
        from tokenizers import decoders

        # the surface may begin with a blank that is not the prefix: a noncharacter stands for it meanwhile
        before, after = [decoders.Replace(self.pieces[self.unk][0], "\ufdd0")] * unknown, [decoders.Replace("\ufdd0", self.unk_surface)] * unknown
        return decoders.Sequence([*before, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * self.dummy_prefix, *after])

    @property
    def splittable(self) -> bool:
        return not self.charsmap and not self.squeeze and self.byte_fallback

    def joined(self) -> np.ndarray:
        """Whether any piece holds the second byte right after the first (a blank stands for the marker)."""
        out = np.zeros((256, 256), bool)
        for piece, _, kind in self.pieces:
            if kind in (NORMAL, USER_DEFINED):
                b = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8)
                out[b[:-1], b[1:]] = True
        out[0x81] |= out[0x20]  # the marker itself in a text is e2 96 81
        out[:, 0xE2] |= out[:, 0x20]
        return out


class PieceCodec:
    """Encoder and decoder of one model file, with the cache of a worker process."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        raw = open(path, "rb").read()
        self.model = PieceModel.parse(raw)
        self.whole = self.model.tokenizer()
        self.check = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.differing: set[bytes] = set()
        if self.model.splittable:
            self.bare = self.model.tokenizer(normalise=False)
            # a second normaliser message overrides the first one's prefix rule
            self.check_bare = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x1a\x02\x18\x00")
            self.apart = ~self.model.joined()
            self.apart[:, 0x80:0xC0] = False
            self.cache = SegmentCache(self._encode)
        self.silent = np.array([kind in (CONTROL, UNUSED) for _, _, kind in self.model.pieces])
        self.with_unknown = None

    def _encode(self, keys: list[bytes]) -> list[bytes]:
        texts = [k.decode() for k in keys]
        own = self.bare.encode_batch_fast([t.replace(" ", MARK) for t in texts], add_special_tokens=False)
        out = []
        for key, e, other in zip(keys, own, self.check_bare.encode(texts, num_threads=1)):
            if e.ids != other:
                self.differing.add(key)
            out.append(array("I", e.ids).tobytes())
        return out

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        if len(data) > 1:
            cut[1:-1] |= self.apart[data[:-1], data[1:]]
        return np.flatnonzero(cut[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's ids begin (and the end), and each text's segments whose ids differ between the libraries."""
        if self.model.splittable:
            if self.model.dummy_prefix:
                texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
            seg = Segmented(texts, self._cuts)
            ids, first, _ = ids_of(seg, self.cache)
            odd = np.fromiter((d in self.differing for d in seg.distinct), np.int64, len(seg.distinct)) if self.differing else np.zeros(len(seg.distinct), np.int64)
            return ids, first, np.diff(np.concatenate([[0], np.cumsum(odd[seg.index])])[seg.first])
        plain = texts.to_pylist()
        own = [e.ids for e in self.whole.encode_batch_fast(plain, add_special_tokens=False)]
        other = self.check.encode(plain, num_threads=1)
        first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        return np.array([i for x in own for i in x], np.uint32), first, np.array([int(a != b) for a, b in zip(own, other)], np.int64)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts and where each begins (and the end)."""
        silent = self.silent[ids]
        if silent.any():
            first = np.concatenate([[0], np.cumsum(~silent)])[first]
            ids = ids[~silent]
        tokenizer = self.whole
        if (ids == self.model.unk).any():
            if self.with_unknown is None:
                self.with_unknown = self.model.tokenizer()
                self.with_unknown.decoder = self.model.decoder(unknown=True)
            tokenizer = self.with_unknown
        flat, at = ids.tolist(), first.tolist()
        parts = [t.encode() for t in tokenizer.decode_batch([flat[a:b] for a, b in zip(at, at[1:])], skip_special_tokens=False)]
        return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, n_differing long"


def encode_documents(docs: DataFrame, model: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every text: ids, their crc32, the crc32 of the decoded text, whether it equals the text.

    One pass without a shuffle; a task holds one batch of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once((model,), lambda: PieceCodec(model))
        for batch in batches:
            texts, doc_ids = large(batch.column("text")), batch.column("doc_id")
            for lo, hi in row_ranges(texts):
                part = texts.slice(lo, hi - lo)
                ids, first, differing = codec.encode(part)
                decoded, edge = codec.decode(ids, first)
                data, off = buffers(part)
                same = np.ones(hi - lo, bool) if decoded == data.tobytes() and (edge == off).all() else np.array([decoded[a:b] == data[c:d].tobytes() for a, b, c, d in zip(edge, edge[1:], off, off[1:])], bool)
                raw, view, at, cut = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B"), memoryview(decoded), first.tolist(), edge.tolist()
                out = {
                    "doc_id": doc_ids.slice(lo, hi - lo),
                    "n_tokens": pa.array(np.diff(first), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                    "round_trip": pa.array(same),
                    "n_differing": pa.array(differing, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(streamed(run), SCHEMA + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows that have doc_id and ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once((model,), lambda: PieceCodec(model))
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            decoded, edge = codec.decode(np.asarray(pc.list_flatten(lists), np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": [decoded[a:b].decode("utf-8", "replace") for a, b in zip(edge, edge[1:])]})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(streamed(run), "doc_id long, text string")
