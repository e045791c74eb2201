"""Token ids in files of patched frame-of-reference blocks.

File: magic ``PFOR0001``, then blocks of ``BLOCK`` ids (the last one may be shorter), then the block index, the document
index and a footer. A block subtracts its minimum and packs the differences at the width that holds at
least ``PERCENTILE`` of them. A difference that needs more bits leaves its low bits in the packed part and is *patched*: its
position and high bits go to the block's exception list. The block index holds the byte at which each block starts, so a reader
can begin at any id.

    block      minimum u32, width u8, exceptions u16 | packed u64 words: value j of each 64 at bit j * width | positions u16... | high bits u32...
    index      block starts u64..., document ids i64 (with a null flag u8 each), document starts u64... (one more than documents)
    footer     ids u64, blocks u64, documents u64, index start u64, magic

Writing deals the documents over files by ranges of (id, hash of text), so file order is id order. Each task writes one file of its own
under a name nothing else uses and returns its row of the manifest; only files named by rows of finished tasks belong to the
output, so a task that is lost or runs twice leaves at most an unused file. The manifest is written to the shared folder.

Texts are encoded as the tokenizers library does by default with ``add_special_tokens=False``: a string of a special or added token within a
text becomes that token's id.

Defined cases: a null text is empty and gives the end id only; repeated ids and rows stand next to each other in order of
their text's hash and text; null ids come first; no documents give an empty manifest and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.runtime import fresh_path, materialize, streamed
from emberlog.llm.segments import Segmented, byte_bpe, cuts_at_blanks, ids_of, once
from emberlog.llm.textblock import large, row_ranges

MAGIC = b"PFOR0001"
BLOCK = 512
PERCENTILE = 0.9
#: Bytes of text for each file: the least, and the most, which very large inputs get so that files (and tasks) do not become too many.
FILE_BYTES, MOST_BYTES, MANY_FILES = 16 << 20, 64 << 20, 4096
#: Bytes of text that are encoded together, and distinct segments that half of a worker's cache holds: what both halves hold is some 100 MB.
CHUNK_BYTES, CACHED = 2 << 20, 250_000
#: Parts in which the numbers of ids before each file are added up.
PARTS = 1000
#: The id that ends a document.
END_ID = 2
_FOOT = struct.Struct("<QQQQ8s")
_HEAD = 7


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values, each below 2**width, as ``width`` 64-bit words a row."""
    out = np.zeros((len(values), width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        out[:, at] |= values[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, at + 1] |= values[:, j] >> np.uint64(64 - shift)
    return out


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        v = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[:, at + 1] << np.uint64(64 - shift))
        out[:, j] = v & mask
    return out


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ``ids``; ``block`` is a multiple of 64. A short last block is filled up with its minimum."""
    n = -(-len(ids) // block)
    if not n:
        return []
    short = n * block - len(ids)
    full = np.concatenate([ids.astype(np.uint64), np.full(short, ids[(n - 1) * block :].min(), np.uint64)]).reshape(n, block)
    low = full.min(axis=1)
    full -= low[:, None]
    rank = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    width = np.maximum(_bits(np.partition(full, rank, axis=1)[:, rank]), 0)
    limit = np.uint64(1) << width.astype(np.uint64)
    over = full >= limit[:, None]
    high = full >> width.astype(np.uint64)[:, None]
    full &= (limit - np.uint64(1))[:, None]
    packed: list[bytes] = [b""] * n
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            words = pack_words(full[rows].reshape(-1, 64), int(w)).astype("<u8").reshape(len(rows), -1)
            for r, x in zip(rows, words):
                packed[r] = x.tobytes()
    row, col = np.nonzero(over)
    first = np.searchsorted(row, np.arange(n + 1))
    col, patch = col.astype("<u2"), high[over].astype("<u4")
    return [struct.pack("<IBH", int(low[i]), int(width[i]), int(first[i + 1] - first[i])) + packed[i] + col[first[i] : first[i + 1]].tobytes() + patch[first[i] : first[i + 1]].tobytes() for i in range(n)]


def decode_blocks(raw: memoryview, starts: np.ndarray, count: int, block: int = BLOCK) -> np.ndarray:
    """The ids of the blocks at ``starts`` of ``raw``; ``count`` ids in all."""
    out = np.zeros((len(starts), block), np.uint64)
    heads = [struct.unpack_from("<IBH", raw, int(s)) for s in starts]
    width = np.array([h[1] for h in heads], np.int64)
    data = np.frombuffer(raw, np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            size = int(w) * block // 8
            words = np.ascontiguousarray(data[(starts[rows] + _HEAD)[:, None] + np.arange(size)]).view("<u8").reshape(-1, int(w))
            out[rows] = unpack_words(words, int(w)).reshape(len(rows), block)
    for i, (low, w, n) in enumerate(heads):
        if n:
            at = int(starts[i]) + _HEAD + w * block // 8
            out[i, np.frombuffer(raw, "<u2", n, at)] |= np.frombuffer(raw, "<u4", n, at + 2 * n).astype(np.uint64) << np.uint64(w)
        out[i] += np.uint64(low)
    return out.ravel()[:count].astype(np.uint32)


class Writer:
    """Writes one file; ``add`` takes ids and the documents that end with them."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.starts, self.left = sink, len(MAGIC), [], np.zeros(0, np.uint32)
        self.docs, self.doc_starts, self.count = [], [0], 0
        sink.write(MAGIC)

    def _blocks(self, ids: np.ndarray) -> None:
        blocks = encode_blocks(ids)
        self.starts += (self.at + np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]).astype(np.int64)).tolist() if blocks else []
        body = b"".join(blocks)
        self.sink.write(body)
        self.at += len(body)

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.doc_starts += (self.count + np.cumsum(lengths)).tolist()
        self.count += len(ids)
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.left = ids[whole:]

    def close(self) -> int:
        """Bytes written."""
        self._blocks(self.left)
        null = np.array([d is None for d in self.docs], np.uint8)
        index = np.array(self.starts, "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + null.tobytes() + np.array(self.doc_starts, "<u8").tobytes()
        foot = _FOOT.pack(self.count, len(self.starts), len(self.docs), self.at, MAGIC)
        self.sink.write(index + foot)
        return self.at + len(index) + len(foot)


class Reader:
    """Random access to one file's bytes."""

    def __init__(self, raw: bytes) -> None:
        self.raw = memoryview(raw)
        self.count, blocks, docs, at, magic = _FOOT.unpack(self.raw[-_FOOT.size :])
        if bytes(self.raw[: len(MAGIC)]) != MAGIC or magic != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.starts = np.frombuffer(self.raw, "<u8", blocks, at).astype(np.int64)
        doc_ids = np.frombuffer(self.raw, "<i8", docs, at + 8 * blocks)
        null = np.frombuffer(self.raw, np.uint8, docs, at + 8 * (blocks + docs))
        self.docs = [None if gone else int(d) for d, gone in zip(doc_ids, null)]
        self.doc_starts = np.frombuffer(self.raw, "<u8", docs + 1, at + 8 * (blocks + docs) + docs).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1, reading only the blocks that hold them."""
        a, b = start // BLOCK, -(-stop // BLOCK)
        return decode_blocks(self.raw, self.starts[a:b], min(self.count, b * BLOCK) - a * BLOCK)[start - a * BLOCK : stop - a * BLOCK] if stop > start else np.zeros(0, np.uint32)


def _open_file(path: str, mode: str):
    """A file of any file system that pyarrow knows, by its URI."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_stream(inner)


MANIFEST = "file long, path string, n_docs long, n_tokens long, n_bytes long"


class Encoder:
    """Ids of whole texts. Texts without a special or added token's string are encoded by distinct segments, the others as they are."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.cache, self.whole = byte_bpe(path, CACHED), Tokenizer.from_file(path)
        self.marks = sorted({t.content for t in self.whole.get_added_tokens_decoder().values() if t.content})

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and where each text's begin (and the end)."""
        ids, first, _ = ids_of(Segmented(texts, cuts_at_blanks), self.cache)
        marked = np.zeros(len(texts), bool)
        for mark in self.marks:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if marked.any():
            own = self.whole.encode_batch_fast([texts[int(i)].as_py() for i in np.flatnonzero(marked)], add_special_tokens=False)
            parts, at = [ids[a:b] for a, b in zip(first, first[1:])], iter(own)
            parts = [np.array(next(at).ids, np.uint32) if m else p for m, p in zip(marked, parts)]
            ids, first = np.concatenate(parts).astype(np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, first


def write_tokens(docs: DataFrame, tokenizer: str, path: str, text: str = "text", end_id: int = END_ID, file_bytes: int | None = None) -> DataFrame:
    """Encode every text and write the files under ``path``; returns the manifest, as written to the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, writer, sink, name, n, shard = once((tokenizer, "whole"), lambda: Encoder(tokenizer)), None, None, "", 0, TaskContext.get().partitionId()
        for batch in batches:
            texts, doc_ids = large(batch.column("text")), batch.column("doc_id").to_pylist()
            for lo, hi in row_ranges(texts, CHUNK_BYTES):
                if writer is None:
                    name = f"{path}/tokens-{shard:06d}-{uuid.uuid4().hex}.pfor"
                    sink = _open_file(name, "w")
                    writer = Writer(sink)
                ids, first = encode(texts.slice(lo, hi - lo))
                with_end = np.insert(ids, first[1:], np.uint32(end_id))
                writer.add(doc_ids[lo:hi], np.diff(first) + 1, with_end)
                n += hi - lo
        if writer is not None:
            size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [shard], "path": [name], "n_docs": [n], "n_tokens": [writer.count], "n_bytes": [size]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    file_bytes = file_bytes or min(MOST_BYTES, max(FILE_BYTES, total // MANY_FILES))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    return materialize(rows.select("doc_id", "text").mapInArrow(streamed(write), MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32 and (``with_ids``) ids as an array."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with _open_file(path, "r") as f:
                    file = Reader(f.read())
                step = 4096
                for a in range(0, len(file.docs), step):
                    at = file.doc_starts[a : a + step + 1]
                    ids = file.ids(int(at[0]), int(at[-1]))
                    raw, cut = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B"), (at - at[0]).tolist()
                    out = {
                        "doc_id": pa.array(file.docs[a : a + step], pa.int64()),
                        "start": pa.array(base + at[:-1]),
                        "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cut, cut[1:])], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)

    # files are numbered from 0: PARTS runs of them are added up first, then each within itself; a table of PARTS rows is broadcast
    n = (manifest.agg(F.max("file")).first()[0] or 0) + 1
    parted = manifest.withColumn("part", F.floor(F.col("file") * PARTS / n).cast("int"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parted.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    sums = sums.select("part", before(Window.partitionBy(F.lit(0)).orderBy("part")).alias("start"))
    based = parted.withColumn("within", before(Window.partitionBy("part").orderBy("file"))).join(F.broadcast(sums), "part")
    files = based.select("path", (F.col("start") + F.col("within")).alias("base")).repartition(max(1, manifest.count()))
    return files.mapInArrow(streamed(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Write all documents into fresh files of the shared folder and read them back."""
    return read_tokens(write_tokens(docs, tokenizer, fresh_path(docs.sparkSession, "tokens")), with_ids)
