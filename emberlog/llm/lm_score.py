"""Language-model scoring by a weighted backoff automaton.

The model is an n-gram model over words (runs without white space, A-Z as a-z) and an end token; ``<s>`` starts a text and is only a context.

    order 1   p(w) = c(w) / (N + u) for known words; all unknown words together have u / (N + u), u = words seen once (at least 1)
    order k   p(w | h) = (c(h w) + K p(w | shorter h)) / (c(h) + K)

K is set for each order so that the mass the contexts leave to shorter ones, averaged over training tokens, equals Good and Turing's
estimate: the share of n-grams seen once. Each order sums to one over known words, the end and the class of unknown words.

As an automaton: every context that was seen is a state; an n-gram that was seen is an arc with weight log p and leads to the longest
suffix that is a state; a failure arc leads to the shorter context with weight log (K / (c(h) + K)). A text is read once from left
to right: from the current state take the word's arc or follow failure arcs until one has it, and add the weights. Tokens are read in
lanes, many at a time; a lane that starts within a text starts in the state that the words before it lead to.

Nothing holds the whole model. Each block of documents gets the counts of exactly those n-grams that occur in it (see ``keycounts``), which
are all the arcs and failure arcs its texts can take. Longer n-grams are asked for in a second round, and only where both shorter parts
occur in another block; for all others the block's own count is the whole count. Counts are taken over all training texts, without pruning.

Defined cases: a null or empty text is the end token alone; no training text leaves p(unknown) = 1 and score 0; repeated rows count and
score as often as they occur; long texts are read like any other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import keycounts
from emberlog.llm.runtime import grouped, paired
from emberlog.llm.textblock import combine, large, row_ranges, words_of

ORDER = 3
START, END = np.uint64(0xA5A5F00DBEEF0001), np.uint64(0x5A5A0FF1CEC0FFEE)
LANE = 64
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def token_keys(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the k-grams that end at each token, k = 1..order (0 where a text has too little before), and each text's first token."""
    parts, counts = [], []
    for lo, hi in row_ranges(texts):
        w = words_of(texts.slice(lo, hi - lo))
        parts.append(np.insert(w.hash, w.first[1:], END))
        counts.append(w.count + 1)
    one = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    place = np.arange(len(one)) - np.repeat(first[:-1], np.diff(first))
    keys = [one]
    for k in range(2, order + 1):
        before = [np.where(place >= j, np.concatenate([np.zeros(j, np.uint64), one])[: len(one)], START) for j in range(k - 1, 0, -1)]
        key = combine([*before, one])
        key[place < k - 2] = 0
        keys.append(key)
    return keys, first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the index of each key among them."""
    found, index = np.unique(keys, return_inverse=True)
    return found, index


def elsewhere(keys: list[np.ndarray], own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bigrams: np.ndarray) -> list[np.ndarray]:
    """For each order from 3 on, which distinct keys of a block a training text of another block may hold: those whose two shorter parts it may hold.

    All other keys have the block's own counts in the whole corpus. ``bigrams`` has the corpus-wide counts of the distinct bigrams.
    """
    out, at = [], (bigrams > own[1][2])[own[1][1]]
    for key, (found, index, _) in zip(keys[2:], own[2:]):
        at = at & np.concatenate([[False], at[:-1]]) & (key != 0)
        sent = np.zeros(len(found), bool)
        sent[index[at]] = True
        out.append(sent)
    return out


def matched_k(bins: dict[int, tuple[int, int]], once: int) -> float:
    """K with sum over contexts of c K / (c + K) = ``once``; ``bins`` has (contexts, sum of counts) by bin."""
    cells = [(n, s / n) for b, (n, s) in bins.items() if b > 0 and n]
    total = sum(n * c for n, c in cells)
    if not cells or once <= 0:
        return 0.01
    low, high = 1e-3, 1e9
    for _ in range(80):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if sum(n * c * mid / (c + mid) for n, c in cells) < min(once, 0.999 * total) else (low, mid)
    return low


class Model:
    """What scoring needs beside counts, from the statistics of the counts."""

    def __init__(self, statistics: list[tuple[int, int, int, int]], order: int = ORDER) -> None:
        bins: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in range(1, order + 1)}
        for kind, b, n, s in statistics:
            bins[kind][b] = (n, s)
        self.order = order
        self.total = sum(s for b, (_, s) in bins[1].items() if b)
        self.types = sum(n for b, (n, _) in bins[1].items() if b)
        self.unknown = max(1, bins[1].get(1, (0, 0))[0])
        self.k = {k: matched_k(bins[k - 1], bins[k].get(1, (0, 0))[0]) for k in range(2, order + 1)}

    def arcs(self, counts: list[np.ndarray], first: np.ndarray, n_train: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For each order and token: whether the n-gram was seen, the weight of its arc, the weight of the failure arc of its context."""
        seen, arc, fail = [c > 0 for c in counts], [], []
        p = np.where(counts[0] > 0, counts[0], self.unknown) / (self.total + self.unknown)
        arc.append(np.log10(p))
        fail.append(np.zeros(len(p)))
        for k in range(2, self.order + 1):
            context = np.concatenate([[0], counts[k - 2][:-1]]).astype(np.float64)
            # the first token's context is <s>; longer contexts than that do not exist there
            context[first[:-1]] = n_train if k == 2 else 0
            p = np.where(context > 0, (counts[k - 1] + self.k[k] * p) / (context + self.k[k]), p)
            arc.append(np.log10(p))
            fail.append(np.log10(self.k[k] / (context + self.k[k])))
        return seen, arc, fail

    def traverse(self, seen: list[np.ndarray], arc: list[np.ndarray], fail: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Log10 probability of each token."""
        n, order = len(arc[0]), self.order
        lanes = -(-n // LANE)
        shape = lambda x, fill: np.concatenate([x, np.full(lanes * LANE - n, fill, x.dtype)]).reshape(lanes, LANE).T.copy()
        begins = np.zeros(n, bool)
        begins[first[:-1]] = True
        depth = np.zeros(n, np.int8)  # length of the context that the tokens up to here leave
        for k in range(1, order):
            depth += seen[k - 1]
        state = np.concatenate([[0], depth[:-1]])[::LANE].copy()
        begins, seen, arc, fail = shape(begins, False), [shape(x, False) for x in seen], [shape(x, 0.0) for x in arc], [shape(x, 0.0) for x in fail]
        out = np.zeros((LANE, lanes))
        for step in range(LANE):
            state = np.where(begins[step], min(1, order - 1), state)
            at = state + 1
            for k in range(order, 1, -1):
                missing = (at == k) & ~seen[k - 1][step]
                out[step] += np.where(missing, fail[k - 1][step], 0.0)
                at = np.where(missing, k - 1, at)
            for k in range(1, order + 1):
                out[step] += np.where(at == k, arc[k - 1][step], 0.0)
            state = np.where(seen[0][step], np.minimum(at, order - 1), 0)
        return out.T.ravel()[:n]


def score(docs: DataFrame, held_out: Column, text: str = "text", order: int = ORDER) -> DataFrame:
    """Score every text with a model learned from the rows where ``held_out`` is false.

    The texts are shuffled once, by block; both passes over a block read the same shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out.alias("held_out"))
    n_blocks, n_buckets = keycounts.sizes(rows, "text", 0.2 * order)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("long"))

    def own_counts(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """``token_keys`` and, for each order, the distinct keys, each token's index among them and their counts in training texts of the block."""
        keys, first = token_keys(large(table["text"]), order)
        train = np.repeat(~table["held_out"].to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        own = []
        for key in keys:
            found, index = distinct(key)
            own.append((found, index, np.bincount(index, train & (key != 0), len(found)).astype(np.int64)))
        return keys, first, own

    def ask(table: pa.Table) -> pa.Table:
        block, out = table["block"][0].as_py(), []
        for kind, (found, _, counts) in enumerate(own_counts(table)[2][:2], 1):
            out += keycounts.ask(block, kind, found, counts, n_buckets)
        return pa.Table.from_batches(out)

    def ask_longer(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return keycounts.no_rows()
        block, out = table["block"][0].as_py(), []
        keys, _, own = own_counts(table)
        for kind, sent in enumerate(elsewhere(keys, own, keycounts.answer_for(answers, 2)), 3):
            found, _, counts = own[kind - 1]
            out += keycounts.ask(block, kind, found[sent], counts[sent], n_buckets)
            out += keycounts.ask_nothing(block, kind, counts[~sent], n_buckets)
        return pa.Table.from_batches(out)

    def read(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pydict({f.split()[0]: [] for f in SCHEMA.split(", ")}, schema=_arrow_schema())
        keys, first, own = own_counts(table)
        model = Model([(s["kind"], s["bin"], s["n_types"], s["n_sum"]) for s in answers["statistics"].drop_null()[0].as_py()], order)
        counts = [keycounts.answer_for(answers, kind) for kind in range(1, min(order, 2) + 1)]
        for kind, sent in enumerate(elsewhere(keys, own, counts[1]) if order > 2 else (), 3):
            total = own[kind - 1][2]
            total[sent] = keycounts.answer_for(answers, kind)
            counts.append(total)
        counts = [c[index] for c, (_, index, _) in zip(counts, own)]
        starts = first[:-1]
        n_train = int(counts[0][first[1] - 1])  # every training text has one end token
        token = model.traverse(*model.arcs(counts, first, n_train), first)
        base = np.log10((counts[0] + 0.1) / (model.total + 0.1 * (model.types + 1)))
        return pa.Table.from_arrays(
            [
                table["doc_id"].combine_chunks(),
                table["held_out"].combine_chunks(),
                pa.array(np.diff(first), pa.int64()),
                pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts), pa.int64()),
                pa.array(np.full(len(starts), model.total), pa.int64()),
                pa.array(np.add.reduceat(base, starts), pa.float64()),
                pa.array(np.add.reduceat(token, starts), pa.float64()),
            ],
            schema=_arrow_schema(),
        )

    asked = rows.groupBy("block").applyInArrow(grouped(ask), keycounts.ASKED)
    answers = keycounts.answered(asked, statistics=True)
    if order > 2:
        known = answers.where((F.col("block") >= 0) & (F.col("kind") == 2)).select("block", "bucket", "kind", "counts")
        longer = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(paired(ask_longer), keycounts.ASKED)
        answers = answers.unionByName(keycounts.answered(longer, statistics=True))
    bins = answers.where(F.col("block") == -1).groupBy("kind", "bin").agg(F.sum("n_types").alias("n_types"), F.sum("n_sum").alias("n_sum"))
    # one list of a few hundred bins, whatever the input, beside the answer with the end token, which every block has
    statistics = bins.agg(F.collect_list(F.struct("kind", "bin", "n_types", "n_sum")).alias("statistics"))
    home = (F.col("kind") == 1) & (F.col("bucket") == int(keycounts.bucket_of(END, n_buckets)))
    answers = answers.where(F.col("block") >= 0).select("block", "bucket", "kind", "counts").crossJoin(F.broadcast(statistics)).withColumn("statistics", F.when(home, F.col("statistics")))
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(paired(read), SCHEMA)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])
