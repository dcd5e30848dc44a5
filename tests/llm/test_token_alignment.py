import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from schedlake.llm import token_alignment as T
from schedlake.llm.common import table
from schedlake.llm.queries import QUERIES

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
LETTERS = T._byte_letters()
A_BYTES = {i: bytes(LETTERS[c] for c in w) for w, i in A.get_vocab().items() if w != "<|endoftext|>"}


def b_bytes(i):
    piece = SP.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if SP.is_byte(i) else piece.replace("▁", " ").encode()


def groups_by_definition(text):
    """Groups of the whole text, from decoded bytes alone."""
    if not text:
        return []
    sides = []
    for ids, of in ((A.encode(" " + text, add_special_tokens=False).ids, A_BYTES.get), (SP.encode(text), b_bytes)):
        raw = [of(i) for i in ids]
        if b"".join(raw) != (" " + text).encode():
            return []
        sides.append((ids, np.cumsum([len(r) for r in raw]).tolist()))
    (a, ends_a), (b, ends_b) = sides
    cuts = sorted(set(ends_a) & set(ends_b))
    out, i, j = [], 0, 0
    for c in cuts:
        ni, nj = ends_a.index(c, i) + 1, ends_b.index(c, j) + 1
        out.append((a[i:ni], b[j:nj]))
        i, j = ni, nj
    return out


def by_definition(texts):
    groups = [groups_by_definition(t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(pair for l in links for pair in l)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g, l in zip(groups, links, strict=True):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), l.total(), hashlib.sha256(line.encode()).hexdigest() if g else "",
            sum(n for p, n in l.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in l.items()),
        ))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = {i: w for (i, _), w in zip(docs, by_definition([t for _, t in docs]), strict=True)}
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op11_alignment"](spark, sf).collect()}
    assert got == want and sum(w[3] > w[2] for w in want.values()) > 100


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "\n\nx \n y", "don't 'll x's", "a b  c", "日本語 テキスト", "né🙂x 🙂🙂 ꙮ𒀀b", "𒀀", "﷽ x", "a▁b c", "▁", "a <|endoftext|> b <s></s>",
    "a\x00b c", "\x1c \x1d x \x85 y", "x 　 y z w", "é á́ ‍ ﻿q", "tab\tand \t mix", "12345 67 8,9.0", "<0x41> <unk>", "same same same same", "==== ---- ====",
]


@pytest.mark.parametrize("chunk_chars,slice_pairs,parts", [(1 << 24, 10**6, 1), (300, 50, 3)])
def test_odd_texts(spark, monkeypatch, chunk_chars, slice_pairs, parts):
    monkeypatch.setattr(T, "AT_ONCE", 7)
    rng = random.Random(chunk_chars)
    letters = "ab cé \n🙂ꙮ▁ \t日'1.  "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    texts += ["".join(rng.choice(letters.replace("▁", "")) for _ in range(60)) for _ in range(120)] + [texts[-3]] * 2
    texts += ["=-" * 3000 + "a" * 900, "word " * 30_000]
    df = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(parts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = Counter((i, *w) for (i, _), w in zip(rows, by_definition([t for _, t in rows]), strict=True))
    got = Counter((r.doc_id, *(r[f] for f in FIELDS)) for r in T.align(df, *FILES, chunk_chars=chunk_chars, slice_pairs=slice_pairs).collect())
    assert got == want
    assert T.align(df.limit(0), *FILES).count() == 0
    assert [tuple(r) for r in T.align(df.where("text = '▁'"), *FILES).select(*FIELDS).collect()] == [(0, 0, 0, 0, "", 0, 0)]


def test_large_groups_pair_distinct_ids(monkeypatch):
    both = T.Aligner(*FILES)
    texts = ["=-" * 50, "plain words", "né🙂 ꙮ" * 9]
    flat, good = both.tokens(texts)
    def summed():
        found = Counter()
        for p, q, n in zip(*(x.tolist() for x in flat.links()), strict=True):
            found[p, q] += n
        return found

    every = summed()
    monkeypatch.setattr(T, "LARGE", 1)
    assert good.all() and (np.diff(flat.links()[0]) >= 0).all()
    assert summed() == every == Counter((k, (x << 32) | y) for k, t in enumerate(texts) for a, b in groups_by_definition(t) for x in a for y in b)
