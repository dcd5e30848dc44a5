import hashlib

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from schedlake.llm.common import table
from schedlake.llm.quality import classify
from test_decontamination import brute_force
from test_exact_dedup import FOLD
from test_similar import shingles
from test_simhash import roots

SF = "/root/testdata/sf0.001"
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def exact_by_definition(docs):
    keep = {}
    for i, t in docs.items():
        fold = (t or "").translate(FOLD)
        keep[fold] = max(i, keep.get(fold, i))
    return {i: docs[i] for i in keep.values()}


def near_by_definition(docs):
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more the smallest id."""
    sets = {i: shingles(t or "") for i, t in docs.items()}
    root = roots(sorted(docs), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return {i: t for i, t in docs.items() if root[i] == i}


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    scores = classify(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()  # held-out accuracy: test_quality
    docs = {r.doc_id: docs[r.doc_id] for r in scores if r.accepted}
    docs = near_by_definition(exact_by_definition(docs))
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    bad = {d for d, _ in brute_force(docs, items)}
    want = {}
    for i, t in docs.items():
        if i not in bad:
            ids = SP.encode(t or "", add_bos=True, add_eos=True)
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            want[i] = (len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(scores)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, stage):
    rows = [
        (1, "plain words of a text " * 9, "en", "a", 9, "x"), (2, None, None, None, None, None), (None, "", "en", "a", 0, "x"), (None, None, None, None, None, "y"),
        (3, "w " * 100_000, "en", "a", 200_000, "x"), (4, "tie one two three", "en", "a", 1, "x"), (4, "tie one two three", "en", "a", 1, "x"), (4, "another text of it", "en", "b", 1, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")
    name, run = pipeline.STAGES[stage]
    got = run(spark, df, SF)
    if name == "SentencePiece encoding and decoding":
        assert got.count() == len(rows)
    else:
        assert got.columns == df.columns
        kept = got.collect()
        assert {tuple(r) for r in kept} <= set(rows)
        if name == "exact dedup":
            assert len(kept) == len({(t or "") for _, t, *_ in rows})
        if name == "benchmark decontamination":
            assert len(kept) == len(rows)
    assert run(spark, df.limit(0), SF).count() == 0
