import hashlib
import random
from collections import Counter

import pytest

from schedlake.llm.suffix_dedup import op10_suffix_dedup, remove_repeats


def by_definition(texts, least):
    raws = [(t or "").encode() for t in texts]
    windows = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if windows[r[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        out.append((len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def corpus(rng):
    alphabet = rng.choice(["ab", "abcdefgh", "aé語"])
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [make(rng.randrange(5, 40)) for _ in range(4)]
    texts = [None, "", "a", make(60) * 4, "ab" * 50]
    for _ in range(25):
        parts = [make(rng.randrange(30)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randrange(1, 7))]
        texts.append("".join(parts))
    return [*texts, texts[-1], texts[3]]


@pytest.mark.parametrize(("seed", "least", "gram", "most", "size"), [(1, 12, 4, 2000, 1 << 20), (2, 12, 4, 1, 1 << 20), (3, 20, 20, 2000, 50), (4, 7, 1, 2, 100)])
def test_equals_definition(spark, seed, least, gram, most, size):
    texts = corpus(random.Random(seed))
    rows = [(None if i == 7 else i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, h int").repartition(3)
    got = remove_repeats(df, least=least, gram=gram, most=most, shard_bytes=size).collect()
    want = {None if i == 7 else i: w for i, w in enumerate(by_definition(texts, least))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "x" * 5 + "abcdefghij"), (1, "x" * 5 + "abcdefghij"), (2, "lonely text"), (2, "other text!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in remove_repeats(df, least=10, gram=3).collect())
    assert got == [(1, 15), (1, 15), (2, 0), (2, 0)]
    assert remove_repeats(df.limit(0), least=10, gram=3).count() == 0


def test_text_longer_than_a_chunk(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_200_000))
    text += text[500_000:501_000]
    got = remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_removed, got.n_spans) == (2000, 2)
    assert bytes(got.kept).decode() == text[:500_000] + text[501_000:1_200_000]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(docs, by_definition([r.text for r in docs], 400))}
    got = op10_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert any(r.n_removed for r in got)


def test_planted_passages_of_over_fifty_words(spark):
    """A repeated passage goes if, and only if, 400 of its bytes repeat: over fifty words may be fewer bytes than that."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    filler = lambda: " ".join(word(rng.randrange(3, 10)) for _ in range(80))
    rows, long, short, clean = [], set(), set(), set()
    for i in range(60):
        passage = " ".join(word(rng.choice([4, 5]) if i % 2 else rng.choice([8, 9])) for _ in range(rng.randrange(51, 60)))
        (long if len(passage) >= 400 else short).update((2 * i, 2 * i + 1))
        rows += [(2 * i + k, f"{filler()} <{k}{passage}{k}> {filler()}") for k in (0, 1)]
    for i in range(1000, 1060):
        rows.append((i, filler()))
        clean.add(i)
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(long) > 40 and len(short) > 40
    assert all(got[i] >= 400 for i in long)  # all caught
    assert not any(got[i] for i in short | clean)  # nothing else is touched
