"""Token counts that follow edits.

A document's text is kept as leaves of ``LEAF`` pre-tokens each under a binary tree whose nodes hold the tokens, code points
and bytes below them. An edit replaces a range of code points. Descending the tree finds the leaves it touches; these, with
at least four characters of context on either side, are cut into pre-tokens and encoded again, and the sums on the
paths to the root are corrected. All else keeps its counts. Whether a text is cut at some place depends on at most three bytes
before and two after it (see ``segments.cuts_at_blanks``), so the leaves outside keep their cuts, and the
root holds what encoding the whole edited text would give.

Trees travel between runs as arrays (``tree_columns``), so a later batch of edits starts from the stored tree.

Strings of special tokens are ordinary text here.

Defined cases: a null text is empty; positions beyond the end are the end, and an end before its start is the start; null
replacements are empty; edits apply in the order of the list, each to the text as the ones before left it; a document without edits keeps its
counts; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.runtime import streamed
from emberlog.llm.segments import SegmentCache, Segmented, byte_bpe, cuts_at_blanks, once
from emberlog.llm.textblock import buffers, large, row_ranges

LEAF = 16
#: Pre-tokens that a leaf may come to hold by edits before it is split (sums are added up again then; nothing else is encoded).
MOST = 4 * LEAF
CONTEXT = 4
EDIT = "struct<start: bigint, stop: bigint, replacement: string>"


class CountTree:
    """Leaves (texts) under sums of tokens and code points; node i has the children 2i and 2i + 1."""

    def __init__(self, texts: list[bytes], tokens: list[int], chars: list[int], cache: SegmentCache) -> None:
        self.cache, self.reencoded = cache, 0
        self._build(texts or [b""], tokens, chars)

    def _build(self, texts: list[bytes], tokens: list[int], chars: list[int]) -> None:
        self.texts = texts
        self.size = 1 << max(0, len(self.texts) - 1).bit_length()
        fill = [0] * (self.size - max(1, len(tokens)))
        self.tokens = [0] * self.size + (list(tokens) or [0]) + fill
        self.chars = [0] * self.size + (list(chars) or [0]) + fill
        for i in range(self.size - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> bytes:
        return b"".join(self.texts)

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a code point and the number of code points before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.size, len(self.texts) - 1), before

    def _set(self, leaf: int, text: bytes, tokens: int, chars: int) -> None:
        self.texts[leaf] = text
        node = self.size + leaf
        dt, dc = tokens - self.tokens[node], chars - self.chars[node]
        while node:
            self.tokens[node] += dt
            self.chars[node] += dc
            node >>= 1

    def _near(self, leaf: int, step: int) -> bytes:
        """``CONTEXT`` bytes of text next to a leaf, or as many as there are."""
        out = b""
        while 0 <= leaf < len(self.texts) and len(out) < CONTEXT:
            out = out + self.texts[leaf] if step > 0 else self.texts[leaf] + out
            leaf += step
        return out[:CONTEXT] if step > 0 else out[-CONTEXT:]

    def edit(self, start: int, stop: int, replacement: str) -> None:
        total = self.chars[1]
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        first, before = self.find(max(0, start - CONTEXT))
        last = max(first, self.find(min(total - 1, stop + CONTEXT))[0] if total else 0)
        old = b"".join(self.texts[first : last + 1]).decode()
        new = (old[: start - before] + replacement + old[stop - before :]).encode()
        left, right = self._near(first - 1, -1), self._near(last + 1, 1)
        data = np.frombuffer(left + new + right, np.uint8)
        cuts = cuts_at_blanks(data, np.array([0, len(data)])).tolist() if len(data) else []
        a, b = len(left), len(left) + len(new)
        edges = [a, *(c for c in cuts if a < c < b), b]
        pieces = [data[x:y].tobytes() for x, y in zip(edges, edges[1:])] if new else []
        self.reencoded += len(pieces)
        tokens = [len(v) >> 2 for v in self.cache(pieces)] if pieces else []
        chars = [sum((b & 0xC0) != 0x80 for b in p) for p in pieces]
        span = last - first + 1
        # the pieces go to the leaves they came from, or to new ones if they are too many for these
        each = max(LEAF, -(-len(pieces) // span)) if len(pieces) <= MOST * span else LEAF
        leaves = [(b"".join(pieces[i : i + each]), sum(tokens[i : i + each]), sum(chars[i : i + each])) for i in range(0, len(pieces), each)]
        leaves += [(b"", 0, 0)] * (span - len(leaves))
        if len(leaves) == span:
            for i, leaf in enumerate(leaves, first):
                self._set(i, *leaf)
        else:
            a, k = self.size, len(self.texts)
            joined = [[*own[:first], *(x[j] for x in leaves), *own[last + 1 :]] for j, own in enumerate((self.texts, self.tokens[a : a + k], self.chars[a : a + k]))]
            self._build(*joined)


def build(texts: pa.Array, cache: SegmentCache) -> Iterator[tuple[list[bytes], list[int], list[int], int]]:
    """Leaf texts, tokens and code points of each text, and its number of pre-token segments."""
    seg = Segmented(texts, cuts_at_blanks)
    data, off = buffers(texts)
    own = np.fromiter(map(len, cache(seg.distinct)), np.int64, len(seg.distinct)) >> 2
    tokens = np.concatenate([[0], np.cumsum(own[seg.index] if len(own) else np.zeros(0, np.int64))])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts, raw = np.concatenate([seg.start, [len(data)]]), data.tobytes()
    for i in range(len(texts)):
        a, b = int(seg.first[i]), int(seg.first[i + 1])
        at = np.append(np.arange(a, b, LEAF), b) if b > a else np.zeros(1, np.int64)
        edge = starts[at]
        yield [raw[x:y] for x, y in zip(edge.tolist(), edge[1:].tolist())], np.diff(tokens[at]).tolist(), np.diff(chars[edge]).tolist(), b - a


TREE = "leaf_bytes array<int>, leaf_chars array<int>, leaf_tokens array<int>"
SCHEMA = "doc_id long, n_tokens long, n_segments long, n_edits long, n_tokens_after long, n_reencoded long, text_crc32_after long"


def edited_counts(docs: DataFrame, edits: Column, tokenizer: str, text: str = "text", state: bool = False) -> DataFrame:
    """Counts before and after each row's list of edits (``array<EDIT>``).

    If ``docs`` has the columns of ``TREE`` (from an earlier call with ``state``), the tree is taken from there and only
    what edits touch is encoded; otherwise it is built. With ``state`` the edited text and its tree are returned too.
    """
    stored = [c for c in ("leaf_bytes", "leaf_chars", "leaf_tokens") if c in docs.columns]
    stored = stored if len(stored) == 3 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = once((tokenizer,), lambda: byte_bpe(tokenizer))
        for batch in batches:
            texts, doc_ids, changes = large(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("edits")
            for lo, hi in row_ranges(texts):
                part, rows, after = texts.slice(lo, hi - lo), [], []
                if stored:
                    body = (t.encode() for t in part.to_pylist())
                    lists = [batch.column(c).slice(lo, hi - lo).to_pylist() for c in stored]
                    built = ((_cut(t, n or []), k or [], c or [], -1) for t, n, c, k in zip(body, *lists))
                else:
                    built = build(part, cache)
                for doc, (leaves, tokens, chars, n), own in zip(doc_ids[lo:hi], built, changes.slice(lo, hi - lo).to_pylist()):
                    tree = CountTree(leaves, tokens, chars, cache)
                    before = tree.n_tokens
                    for e in own or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                    whole = tree.text()
                    rows.append((doc, before, n, len(own or ()), tree.n_tokens, tree.reencoded, zlib.crc32(whole)))
                    if state:
                        k = len(tree.texts)
                        after.append((whole.decode(), [len(t) for t in tree.texts], tree.chars[tree.size : tree.size + k], tree.tokens[tree.size : tree.size + k]))
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                out = {name: pa.array(values, pa.int64()) for name, values in zip(names, zip(*rows))}
                if state:
                    out |= {name: pa.array(values, kind) for name, values, kind in zip(("text", "leaf_bytes", "leaf_chars", "leaf_tokens"), zip(*after), (pa.string(), *[pa.list_(pa.int32())] * 3))}
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), edits.cast(f"array<{EDIT}>").alias("edits"), *stored)
    return rows.mapInArrow(streamed(run), SCHEMA + (f", text string, {TREE}" if state else ""))


def _cut(text: bytes, sizes: list[int]) -> list[bytes]:
    out, at = [], 0
    for n in sizes:
        out.append(text[at : at + n])
        at += n
    return out


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with a column ``edits`` from a table doc_id, edit_no, start, stop, replacement (edits are few beside documents)."""
    each = edits.groupBy(F.col("doc_id").alias("_edited")).agg(F.sort_array(F.collect_list(F.struct("edit_no", "start", "stop", "replacement"))).alias("_e"))
    return docs.join(each, docs["doc_id"] == each["_edited"], "left").withColumn("edits", F.transform("_e", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["replacement"].alias("replacement")))).drop("_e", "_edited")


def standard_edits(text: Column) -> Column:
    """Three edits for a text: an insertion after a third, a deletion at the middle and a replacement near the end."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")
    edit = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), F.lit(new).alias("replacement"))
    third, half, late = F.floor(n / 3), F.floor(n / 2), F.floor(n * 7 / 8)
    return F.array(edit(third, third, " a new clause, it's here"), edit(half, half + 12, ""), edit(late, late + 3, "Maß.\nÉ 42"))
