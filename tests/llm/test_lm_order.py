import inspect

import numpy as np
import pytest
from collections import Counter
from pyspark.sql import functions as F

from emberlog.llm import keycounts, lm_score as M
from emberlog.llm.queries import crc32_of_id

from .test_models import brute_scores


def scores(df):
    return Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())


def test_contexts_longer_than_a_word(edge, edge_rows):
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(10)) == 0
    assert inspect.signature(M.score).parameters["order"].default >= 3
    assert scores(M.score(edge, held_out)) == Counter(brute_scores([(i, t) for i, t, _ in edge_rows], 3))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_many_blocks_and_buckets(edge, edge_rows, order, monkeypatch):
    monkeypatch.setattr(keycounts, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(keycounts, "BUCKET_KEYS", 30_000)
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(10)) == 0
    assert scores(M.score(edge, held_out, order=order)) == Counter(brute_scores([(i, t) for i, t, _ in edge_rows], order))
