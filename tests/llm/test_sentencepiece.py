import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from schedlake.llm.sentencepiece_chunks import encode_decode, op7_sentencepiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def library(text):
    ids = SP.encode(text or "", add_bos=True, add_eos=True)
    return struct.pack(f"<{len(ids)}I", *ids), SP.decode(ids)


def texts():
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "▁", "é", "語", "😀", "\x00", "the", "ing", "2024", "!!", "​", " ", "ﬁ"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [None, "", " ", "  ", "▁", "▁▁", "x", " x", "x ", "x  ", "a" * 3000, " " * 50, "ab " * 5000, "語" * 700, "x y" * 400, *made]


def test_equals_library(spark):
    given = texts()
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], "doc_id long, text string, ids string")
    for size in (1, 200_000):
        got = {r.doc_id: (bytes(r.ids), r.decoded) for r in encode_decode(rows, MODEL, table_size=size).collect()}
        assert got == {i: library(t) for i, t in enumerate(given)}


def test_repeats_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = encode_decode(rows, MODEL).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == [(0, ""), (1, "a b"), (1, "a b")]
    assert encode_decode(rows.limit(0), MODEL).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, text = library(r.text)
        want.add((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in op7_sentencepiece(spark, sf).collect()} == want


def test_model_whose_pieces_cross_spaces_is_refused(monkeypatch):
    from schedlake.llm.sentencepiece_chunks import chunk_codec

    class Crossing:
        def __init__(self, model_file): ...
        def get_piece_size(self): return 1
        def id_to_piece(self, i): return "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        chunk_codec(MODEL, 10)
