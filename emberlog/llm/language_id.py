"""Language identification by a byte convolutional network in numpy.

Bytes (A-Z as a-z) are embedded; filters of several widths slide over windows of ``WINDOW`` bytes; each filter's maximum over
the window goes through a rectifier, and a softmax layer names the language. A text is cut into windows that cover all of it; the
windows' logits are averaged, weighted by the bytes they hold.

The network learns on the driver from a bounded sample: at most ``SAMPLE_DOCS`` labelled documents, taken language by
language in turn in hash order, with ``SAMPLE_WINDOWS`` windows spread evenly over each. The bound does not
depend on the size of the input. Language, source and id are never inputs of a prediction.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing could be learned; a
short text is one window filled with zero bytes; of languages with the same probability the first by name is told; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.runtime import streamed
from emberlog.llm.textblock import buffers, large, row_ranges

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS, EMBED = 12, 8
SAMPLE_DOCS, SAMPLE_WINDOWS = 3000, 6
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.004, 7
UNKNOWN = "und"
#: Windows that go through the network at once.
AT_ONCE = 192

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class ByteNet:
    """Parameters; ``filters`` holds all widths side by side, zero beyond a filter's own width."""

    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (max width * EMBED) x all filters
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = SEED) -> "ByteNet":
        r, top, n = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
        filters = np.zeros((top * EMBED, n), np.float32)
        for i, w in enumerate(WIDTHS):
            filters[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = r.normal(0, 1 / np.sqrt(w), (w * EMBED, FILTERS)) / 2
        f = np.float32
        return cls(languages, r.normal(0, 0.7, (256, EMBED)).astype(f), filters, np.zeros(n, f), r.normal(0, 0.2, (n, len(languages))).astype(f), np.zeros(len(languages), f))

    @property
    def mask(self) -> np.ndarray:
        """Which entries of ``filters`` exist."""
        out = np.zeros(self.filters.shape, bool)
        for i, w in enumerate(WIDTHS):
            out[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = True
        return out

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, bytes of a patch * EMBED); each patch is contiguous in the embedded window."""
        e, top = self.embed[windows], max(WIDTHS)
        n, positions = len(windows), windows.shape[1] - top + 1
        return np.lib.stride_tricks.as_strided(e, (n, positions, top * EMBED), (e.strides[0], e.strides[1], e.strides[2]))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), AT_ONCE):
            p = self.patches(windows[a : a + AT_ONCE])
            n, positions, k = p.shape
            z = (np.ascontiguousarray(p).reshape(n * positions, k) @ self.filters).reshape(n, positions, -1).max(axis=1)
            out[a : a + n] = np.maximum(z + self.bias, 0) @ self.dense + self.dense_bias
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
    """Adam on the cross entropy. The maximum lets a gradient reach one position of each filter only, so only those patches are gathered."""
    net, r, mask = ByteNet.fresh(languages, seed), np.random.default_rng(seed), None
    mask = net.mask
    names = ("embed", "filters", "bias", "dense", "dense_bias")
    m1, m2, step = {n: np.zeros_like(getattr(net, n)) for n in names}, {n: np.zeros_like(getattr(net, n)) for n in names}, 0
    top = max(WIDTHS)
    for epoch in range(epochs):
        order = r.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            x, y = windows[order[a : a + BATCH]], labels[order[a : a + BATCH]]
            p = net.patches(x)
            n, positions, k = p.shape
            z = (np.ascontiguousarray(p).reshape(n * positions, k) @ net.filters).reshape(n, positions, -1)
            at = z.argmax(axis=1)
            pooled = np.take_along_axis(z, at[:, None], 1)[:, 0] + net.bias
            act = np.maximum(pooled, 0)
            g = softmax(act @ net.dense + net.dense_bias)
            g[np.arange(n), y] -= 1
            g /= n
            grad = {"dense": act.T @ g, "dense_bias": g.sum(axis=0)}
            d = (g @ net.dense.T) * (pooled > 0)
            grad["bias"] = d.sum(axis=0)
            best = p[np.arange(n)[:, None], at]  # windows x filters x k
            grad["filters"] = np.einsum("nfk,nf->kf", best, d, optimize=True) * mask
            back = (d[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            which = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(top)].ravel()
            grad["embed"] = np.stack([np.bincount(which, back[:, j], 256) for j in range(EMBED)], axis=1)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for name in names:
                w, q = getattr(net, name), grad[name].astype(np.float32)
                m1[name] += 0.1 * (q - m1[name])
                m2[name] += 0.001 * (q * q - m2[name])
                w -= rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover every text, where each text's windows begin (and the end), and the bytes of each window."""
    data, off = buffers(texts)
    size = np.diff(off)
    count = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - off[:-1], size)] = _FOLD[data]
    filled = np.full(int(first[-1]), WINDOW)
    has = count > 0
    filled[first[1:][has] - 1] = size[has] - (count[has] - 1) * WINDOW
    return flat.reshape(-1, WINDOW), first, filled


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, trainable: Column, text: str = "text", label: str = "lang", sample_docs: int = SAMPLE_DOCS) -> ByteNet | None:
    """Learn from rows where ``trainable`` holds and the label is not null; None if there are none.

    Ids are chosen from narrow rows: languages are counted, each is thinned by hash to about twice ``sample_docs``, and only
    these are ranked. The chosen rows' windows, at most ``sample_docs`` x ``SAMPLE_WINDOWS``, come to the driver.
    """
    n = F.char_length(text)
    slices = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(F.col(text), (1 + F.floor(i * F.greatest(n - WINDOW, F.lit(0)) / (SAMPLE_WINDOWS - 1))).cast("int"), F.lit(WINDOW)))
    known = docs.where(trainable & F.col(label).isNotNull() & F.col(text).isNotNull())
    # a hash sample of about twice the need of each language; a sample of sample_docs rows holds no more languages than that
    named = docs.where(trainable & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("_label"))
    sizes = named.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "_label").limit(sample_docs)
    part = F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    near = named.join(F.broadcast(sizes), "_label").where(part * F.col("_n") < 2 * sample_docs)
    turn = F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = near.withColumn("_turn", turn).where(F.col("_turn") <= sample_docs).orderBy("_turn", F.xxhash64("doc_id"), "_label").limit(sample_docs)
    # at most sample_docs ids
    rows = known.where(has_letter(F.col(text))).join(F.broadcast(chosen.select(F.col("doc_id").alias("_chosen")).distinct()), F.col("doc_id").eqNullSafe(F.col("_chosen")))
    sample = rows.select("doc_id", F.col(label).alias("label"), F.array_distinct(slices).alias("slices")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    if not sample:
        return None
    languages = sorted({r["label"] for r in sample})
    number = {x: i for i, x in enumerate(languages)}
    own = [(s.encode()[:WINDOW], number[r["label"]]) for r in sample for s in r["slices"] if s]
    windows = np.zeros((len(own), WINDOW), np.uint8)
    for i, (b, _) in enumerate(own):
        windows[i, : len(b)] = _FOLD[np.frombuffer(b, np.uint8)]
    return train(windows, np.array([y for _, y in own]), languages)


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id) with ``lang_pred`` and ``score``; one pass without a shuffle."""
    keep = ["doc_id"] if keep is None else keep
    letters = has_letter(F.col(text))
    if net is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    outer, _, inner = text.partition(".")
    held = keep.index(outer) if inner and outer in keep else None  # a text within a column that travels anyway is not sent twice
    body = F.lit("") if held is not None else F.when(letters, F.col(text)).otherwise("")
    rows = docs.select(*keep, body.alias("_body"), letters.alias("_letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.languages, UNKNOWN], object)
        for batch in batches:
            texts = large(batch.column(len(keep)) if held is None else pc.struct_field(batch.column(held), inner))
            letter = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for lo, hi in row_ranges(texts, 1 << 20):
                windows, first, filled = windows_of(texts.slice(lo, hi - lo))
                has = np.flatnonzero(np.diff(first) > 0)
                if len(has):
                    weighted = net.logits(windows).astype(np.float64) * filled[:, None]
                    mean = np.add.reduceat(weighted, first[:-1][has], axis=0) / np.add.reduceat(filled, first[:-1][has])[:, None]
                    p = softmax(mean)
                    best[lo + has], score[lo + has] = p.argmax(axis=1), p.max(axis=1)
            best[~letter.astype(bool)], score[~letter.astype(bool)] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[: len(keep)], "lang_pred", "score"])

    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(streamed(run), schema)
