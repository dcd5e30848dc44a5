import random

import numpy as np
import public_tokenizers
import pytest

from schedlake.llm.token_counts import Counter, Tree, apply_edits, build_trees, count_edits, mask_addresses, op5_token_counts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def counter():
    return Counter(RANKS, PATTERN)


def edited(text, edits):
    for s, e, new in reversed(edits):
        text = text[:s] + new + text[e:]
    return text


def whole(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_random_edits_equal_counting_anew(counter):
    rng = random.Random(11)
    parts = ["a", "we", "don", "'", "'r", "e", "'ll", " ", "  ", "\n", " \n ", "7", "42", "!", "é", "語", "\x1c", " ", "😀", "Q" * 30]
    for round_ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(5)))
        edits = [(s, e, "".join(rng.choice(parts) for _ in range(rng.randrange(4)))) for s, e in zip(cuts[::2], cuts[1::2])]
        tree = Tree.of(text, counter, rng.choice([1, 2, 5]))
        assert tree.tokens[1] == whole(counter, text)
        apply_edits(text, tree, counter, edits)
        after = edited(text, edits)
        assert (tree.chars[1], tree.tokens[1]) == (len(after), whole(counter, after)), (text, edits)
        width = tree.width
        for heap in (tree.chars, tree.tokens):
            assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for i in range(1, width))
        # and once more on the tree as it now is
        at = rng.randrange(len(after) + 1)
        apply_edits(after, tree, counter, [(at, at, " x'll")])
        assert tree.tokens[1] == whole(counter, edited(after, [(at, at, " x'll")]))


def test_only_touched_regions_are_read(counter):
    text = "word and number 17, " * 20_000
    edits = [(i * 10_000, i * 10_000 + 4, "term") for i in range(1, 21)]
    tree = Tree.of(text, counter, 64)
    assert apply_edits(text, tree, counter, edits) < 20 * 1500
    assert tree.tokens[1] == whole(counter, edited(text, edits))
    with pytest.raises(ValueError):
        apply_edits(text, tree, counter, [(5, 9, ""), (7, 8, "")])


def test_long_pre_token(counter):
    text = "a" * 100_000 + " b" + "!" * 50_000
    for edits in ([(50_000, 50_000, " ")], [(100_000, 100_001, "")], [(0, 150_002, "")], [(150_002, 150_002, "x")]):
        tree = Tree.of(text, counter, 1)
        apply_edits(text, tree, counter, edits)
        assert tree.tokens[1] == whole(counter, edited(text, edits))


def test_tables(spark, counter):
    rows = [
        (1, "mail a.b@c.org now", [(5, 12, "X"), (15, 18, None)], "c"), (2, None, None, "c"), (2, "", [(0, 0, "new")], "c"),
        (None, "no edit", [], "c"), (3, "twice", [(0, 1, "T")], "c"), (3, "twice", [(0, 1, "T")], "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, n_tokens string")
    want = sorted(
        (i or 0, whole(counter, t or ""), len(e or []), whole(counter, edited(t or "", [(a, b, c or "") for a, b, c in e or []])))
        for i, t, e, _ in rows
    )
    trees = build_trees(df, RANKS, PATTERN)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in trees.collect()) == [w[:2] for w in want]
    got = count_edits(df, "edits", RANKS, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_edits, r.n_tokens_after) for r in got) == want
    kept = df.where("doc_id = 1").join(trees.select("doc_id", "tree_chars", "tree_tokens"), "doc_id")
    again = count_edits(kept, "edits", RANKS, PATTERN, trees=("tree_chars", "tree_tokens")).first()
    assert (again.n_tokens, again.n_tokens_after) == [w[1::2] for w in want if w[0] == 1][0]
    assert count_edits(df.limit(0), "edits", RANKS, PATTERN).count() == 0


def test_query(spark, counter):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        edits = mask_addresses(r.text)
        want[r.doc_id] = (whole(counter, r.text), len(edits), whole(counter, edited(r.text, edits)))
    got = op5_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.n_edits, r.n_tokens_after) for r in got} == want
    assert any(r.n_edits for r in got) and np.mean([r.n_chars_read for r in got]) < 500
