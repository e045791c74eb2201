"""The pipeline and each of its stages against plain Python on a small fixture."""

import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from emberlog.llm import language_id as L
from emberlog.llm.runtime import tokenizer_path

from .conftest import prose
from .test_copies import brute, distance
from .test_quality import brute as counts_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    base = prose(r, 90)
    near = base.split()
    near[40] = "otherword"
    bench = [(0, prose(r, 30)), (1, prose(r, 25))]
    docs = [(10, base, "en"), (4, " ".join(near), "en"), (11, base, "en"), (12, None, "en"), (13, "", None), (14, "too short", "de"), (15, "the same again " * 30, "en"), (16, "12 34 !! " + " ".join(str(r.random()) for _ in range(60)), "en")]
    docs += [(17, prose(r, 40) + "\n" + bench[0][1] + " " + prose(r, 30), "de"), (18, prose(r, 40) + " " + bench[1][1].translate(LOWER).replace(" ", "  ", 3) + " " + prose(r, 30), None)]
    docs += [(100 + i, prose(r, r.randrange(60, 160)), r.choice(["en", "de", None])) for i in range(25)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, g, "s", None) for i, t, g in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    spark.createDataFrame([(10, 1, 0), (15, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out), docs, bench


def told(net, text):
    """Language and probability by the network's definition, window by window and position by position."""
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    data = np.frombuffer(text.translate(LOWER).encode(), np.uint8)
    total, weight = np.zeros(len(net.languages)), 0
    for a in range(0, len(data), L.WINDOW):
        own = data[a : a + L.WINDOW]
        w = np.zeros(L.WINDOW, np.uint8)
        w[: len(own)] = own
        top = max(L.WIDTHS)
        best = np.max([net.embed[w[p : p + top]].ravel() @ net.filters for p in range(L.WINDOW - top + 1)], axis=0)
        total += len(own) * (np.maximum(best + net.bias, 0) @ net.dense + net.dense_bias)
        weight += len(own)
    p = L.softmax(total / weight)
    return net.languages[int(p.argmax())], float(p.max())


def test_pipeline_matches_plain_python(spark, folder):
    path, docs, bench = folder
    got = {r["doc_id"]: r for r in C.run(spark, path).collect()}
    good = [(i, t, g) for i, t, g in docs for c in [counts_of(t)] if c[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert {12, 13, 14, 15}.isdisjoint(i for i, *_ in good)
    kept = spark.createDataFrame([(i, t, g) for i, t, g in good], "doc_id long, text string, lang string")
    net = L.fit(kept, F.lit(True))
    sure = [(i, t) for i, t, _ in good for name, p in [told(net, t)] if name != "und" and p >= C.SURE]
    assert 16 not in {i for i, _ in sure}
    component = {d: c for d, _, c in brute(sure)}
    assert component[10] == component[11] == component[4] == 4
    single = [(i, t) for i, t in sure if component[i] == i]
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.translate(LOWER))
    clean = [(i, t) for i, t in single if all(distance(plain(b), plain(t)) > 0.08 * len(b) for _, b in bench)]
    assert {17, 18} <= {i for i, _ in single} - {i for i, _ in clean}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert {i: list(r["ids"]) for i, r in got.items()} == {i: sp.encode(t) for i, t in clean}
    for i, t in clean:
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(sp.encode(t), "<u4").tobytes()) and got[i]["round_trip"] and got[i]["decoded_crc32"] == zlib.crc32(t.encode())


def test_stages_keep_the_columns(spark, folder):
    path, docs, _ = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    wide = table.withColumns({"words": F.lit(1), "n": F.lit("x"), "block": F.lit(2), "class": F.lit("c"), "size": F.lit(0), "kept": F.lit(7), "base_failed": F.lit("b"), "score": F.lit("s"), "lang_pred": F.lit("p"), "n_good": F.lit(0), "cut_upper": F.lit(1), "component": F.lit(0), "stratum": F.lit(5)})
    for source in (wide, wide.limit(0)):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, source, path)
            assert out.columns == source.columns, name
            assert out.dtypes == source.dtypes and set(map(repr, out.drop("lang").collect())) <= set(map(repr, source.drop("lang").collect()))
    assert C.STAGES[-1][1](spark, wide.limit(0), path).count() == 0
    assert C.ORACLE_SQL is None
