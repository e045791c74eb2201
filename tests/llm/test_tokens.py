import io
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import edit_counts as E
from emberlog.llm import piece_codec as P
from emberlog.llm import token_files as T
from emberlog.llm.runtime import fresh_path, tokenizer_path
from emberlog.llm.segments import Segmented, byte_bpe, cuts_at_blanks, ids_of
from emberlog.llm.textblock import large

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
CACHE = byte_bpe(BPE)
PLAIN = Tokenizer.from_file(BPE)
PLAIN.encode_special_tokens = True
TEXT = st.text(st.one_of(st.sampled_from(" \n\t'.,!|$x7éß  　日s"), st.characters(codec="utf-8")), max_size=40)


LIBRARY = Tokenizer.from_file(BPE)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_segments_give_the_ids_of_the_whole_text(texts):
    ids, first, _ = ids_of(Segmented(large(pa.array(texts, pa.string())), cuts_at_blanks), CACHE)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [plain_ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    blocks = T.encode_blocks(ids, 64, percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    assert (T.decode_blocks(memoryview(b"".join(blocks)), starts, len(ids), 64) == ids).all()


def test_file_gives_any_range():
    r = np.random.default_rng(1)
    ids = r.integers(0, 50_000, 5000).astype(np.uint32)
    f = io.BytesIO()
    w = T.Writer(f)
    w.add([5, None], np.array([3000, 0]), ids[:3000])
    w.add([9], np.array([2000]), ids[3000:])
    assert w.close() == len(f.getvalue()) < 2.2 * len(ids) + 200
    reader = T.Reader(f.getvalue())
    assert reader.docs == [5, None, 9] and reader.doc_starts.tolist() == [0, 3000, 3000, 5000]
    for a, b in ((0, 5000), (511, 513), (4999, 5000), (7, 7)):
        assert (reader.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        T.Reader(f.getvalue()[:-1])


def test_segments_seen_before_are_not_encoded_again():
    encode, asked = T.Encoder(BPE), []
    real = encode.cache.encode
    encode.cache.encode = lambda keys: asked.append(len(keys)) or real(keys)
    words = np.unique(np.random.Generator(np.random.PCG64(1)).integers(26**4, 26**5, 300_000))
    letters = lambda x: "".join(chr(97 + x // 26**i % 26) for i in range(5))
    texts = [pa.array([" ".join(map(letters, part.tolist()))], pa.large_string()) for part in np.array_split(words, 8)]
    first = [encode(t)[0] for t in texts]
    told = sum(asked)
    assert told > 250_000 and all((a == encode(t)[0]).all() for a, t in zip(first, texts)) and sum(asked) == told


def test_token_files(spark, edge, edge_rows, empty):
    manifest = T.write_tokens(edge, BPE, fresh_path(spark, "t"), file_bytes=60_000)
    assert manifest.count() > 1
    out = T.read_tokens(manifest).orderBy("start").collect()
    assert [r["start"] for r in out] == np.cumsum([0, *(r["n_tokens"] for r in out)])[:-1].tolist()
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    expected = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in edge_rows for x in [LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == expected
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)
    assert T.token_files(empty, BPE).collect() == []


def test_special_strings_are_their_tokens(spark):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "plain", None]
    rows = T.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE, with_ids=True).collect()
    expected = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == expected and 50256 in expected[0]


def test_starts_over_many_files(spark, monkeypatch):
    monkeypatch.setattr(T, "PARTS", 3)
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 5)) for i in range(300)], "doc_id long, text string")
    manifest = T.write_tokens(docs, BPE, fresh_path(spark, "t"), file_bytes=400)
    assert manifest.count() > 10
    out = T.read_tokens(manifest, with_ids=False).orderBy("doc_id").collect()
    assert [r["start"] for r in out] == np.cumsum([0, *(r["n_tokens"] for r in out)])[:-1].tolist()


def test_piece_codec(spark, edge, edge_rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = P.encode_documents(edge, PIECES)
    rows = out.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((i, tuple(sp.encode(t or ""))) for i, t, _ in edge_rows)
    assert all(r["n_differing"] == 0 for r in rows)
    assert {r["doc_id"] for r in rows if not r["round_trip"]} == {12}  # it holds the marker itself
    back = Counter((r["doc_id"], r["text"]) for r in P.decode_documents(out.where("doc_id != 12"), PIECES).collect())
    assert back == Counter((i, t or "") for i, t, _ in edge_rows if i is not None and i != 12)
    assert P.encode_documents(empty, PIECES).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=3))
def test_piece_codec_parity(texts):
    sp, codec = _both()
    texts = [t.replace("\0", "") for t in texts]
    ids, first, differing = codec.encode(large(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [sp.encode(t) for t in texts]
    assert [codec.whole.encode(t, add_special_tokens=False).ids for t in texts] == [sp.encode(t) for t in texts]


def test_ids_come_from_the_rebuilt_tokenizer(monkeypatch):
    """The other library only verifies."""

    class Other:
        def encode(self, texts, num_threads=1):
            return [[7] for _ in texts]

    codec = P.PieceCodec(PIECES)
    codec.check_bare = codec.check = Other()
    texts = ["one text", "", "two  texts é"]
    ids, first, differing = codec.encode(large(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [_both()[0].encode(t) for t in texts]
    assert (differing > 0).tolist() == [True, False, True]


def test_decoding_matches_sentencepiece():
    sp, codec = _both()
    r = np.random.default_rng(3)
    lists = [r.integers(3, 32_000, n).tolist() for n in (0, 1, 5, 40)] + [[1, 400, 2], [0, 500, 0], [3 + 0xC3, 3 + 0xA9, 600], [3 + 0xFF, 600], [29871, 29871, 400]]
    raw, edge = codec.decode(np.array([i for x in lists for i in x], np.int64), np.cumsum([0, *map(len, lists)]))
    assert [raw[a:b].decode() for a, b in zip(edge, edge[1:])] == [sp.decode(x) for x in lists]


@lru_cache(1)
def _both():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES), P.PieceCodec(PIECES)


def _proto(pieces, kind):
    import struct

    def field(number, body):
        return bytes([number << 3 | 2, len(body)]) + body

    out = b""
    for piece, score, t in pieces:
        out += field(1, field(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, t]))
    trainer = bytes([3 << 3, kind]) + b"\x98\x02\x01" + b"\xc0\x02\x00"  # type, byte fallback, unknown id
    return out + field(2, trainer) + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


def test_unigram_models(tmp_path):
    import sentencepiece

    pieces = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)] + [(f"<0x{b:02X}>", -20.0 - b / 1000, P.BYTE) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁a", -5.2, 1), ("▁ab", -6.0, 1), ("abb", -6.1, 1), ("c", -7.0, 1)]
    raw = _proto(pieces, P.UNIGRAM)
    path = tmp_path / "u.model"
    path.write_bytes(raw)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    codec = P.PieceCodec(str(path))
    r = random.Random(5)
    texts = ["", "ab", "é"] + ["".join(r.choice("aabbc  é") for _ in range(r.randrange(20))) for _ in range(60)]
    ids, first, differing = codec.encode(large(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [sp.encode(t) for t in texts]
    assert differing.sum() == 0
    raw, edge = codec.decode(ids, first)
    assert [raw[a:b].decode() for a, b in zip(edge, edge[1:])] == texts


def test_edited_counts(spark, edge, edge_rows, empty):
    def edited(text):
        for e in edits:
            n = len(text)
            a = min(max(e[0] or 0, 0), n)
            b = min(max(e[1] or 0, a), n)
            text = text[:a] + (e[2] or "") + text[b:]
        return text

    edits = [(3, 5, "new 'words'"), (0, 0, " "), (10**9, 10**9, "\nend"), (2, 1, None), (None, 1, "é"), (4, 400, "")]
    column = F.array(*[F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip(e, ("bigint", "bigint", "string"), ("start", "stop", "replacement"))]) for e in edits])
    out = E.edited_counts(edge, column, BPE, state=True)
    rows = out.collect()
    expected = Counter((i, len(plain_ids(t)), edited(t or "")) for i, t, _ in edge_rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["text"]) for r in rows) == expected
    for r in rows:
        assert r["n_tokens_after"] == len(plain_ids(r["text"])) == sum(r["leaf_tokens"])
        assert zlib.crc32(r["text"].encode()) == r["text_crc32_after"]
    big = next(r for r in rows if r["doc_id"] == 9)
    assert big["n_reencoded"] < 0.05 * big["n_segments"]
    # a second batch of edits starts from the stored trees
    again = E.edited_counts(out.select("doc_id", "text", "leaf_bytes", "leaf_chars", "leaf_tokens"), F.array(F.struct(F.lit(1).cast("bigint").alias("start"), F.lit(2).cast("bigint").alias("stop"), F.lit("Q").alias("replacement"))), BPE, state=True)
    for r in again.collect():
        assert r["n_tokens_after"] == len(plain_ids(r["text"])) and r["n_reencoded"] < 400
    assert E.edited_counts(empty, E.standard_edits(F.col("text")), BPE).collect() == []
    table = spark.createDataFrame([(5, 2, 0, 0, "B"), (5, 1, 0, 0, "A")], "doc_id long, edit_no int, start long, stop long, replacement string")
    docs = edge.select("doc_id", "text").where("doc_id in (5, 6)")
    got = {r["doc_id"]: r["text"] for r in E.edited_counts(E.attach_edits(docs, table), F.col("edits"), BPE, state=True).collect()}
    assert got == {5: "BAone", 6: "two words"}


def test_leaves_split():
    """A large insertion, and many small ones at one place, leave no leaf that later edits would encode whole."""
    text = " ".join(f"word{i}" for i in range(2000))
    ((leaves, tokens, chars, _),) = E.build(large(pa.array([text], pa.string())), CACHE)
    tree = E.CountTree(leaves, tokens, chars, CACHE)
    new = " and ".join(f"é{i}" for i in range(3000))
    tree.edit(500, 510, new)
    text = text[:500] + new + text[510:]
    for _ in range(300):
        tree.edit(700, 700, " more")
        text = text[:700] + " more" + text[700:]
    tree.edit(600, 900, "")
    text = text[:600] + text[900:]
    assert tree.text().decode() == text and tree.n_tokens == len(plain_ids(text))
    before = tree.reencoded
    for at in (0, 480, 650, 699, 705, 9000, len(text)):
        tree.edit(at, at, "x")
    assert tree.reencoded - before < 7 * 4 * E.MOST


@settings(max_examples=120, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 45), st.integers(0, 10), TEXT), max_size=5))
def test_tree_follows_any_edits(text, edits):
    ((leaves, tokens, chars, _),) = E.build(large(pa.array([text], pa.string())), CACHE)
    tree = E.CountTree(leaves, tokens, chars, CACHE)
    for start, size, new in edits:
        tree.edit(start, start + size, new)
        a = min(start, len(text))
        text = text[:a] + new + text[a + size :]
    assert tree.text().decode() == text and tree.n_tokens == len(plain_ids(text))
