import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from schedlake.llm import ranked_search as R
from schedlake.llm.common import table
from schedlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_definition(docs, items, k=10):
    """docs: (id, text); items: {id: text}."""
    bags = [(i, Counter(WORD.findall((t or "").translate(FOLD)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(s for *_, s in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = {}
    for item, text in items.items():
        rows = []
        for i, bag, size in bags:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in set(WORD.findall((text or "").translate(FOLD))) if w in bag)
            if score > 0:
                rows.append((score, i))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out[item] = rows[:k]
    return {(item, rank, i, score) for item, rows in out.items() for rank, (score, i) in enumerate(rows, 1)}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_quadtree_cells():
    rng = np.random.default_rng(1)
    for size, points in ((1, 1), (2, 3), (40, 200), (5000, 700)):
        cells = np.unique(rng.integers(0, size, (points, 2)), axis=0)
        codes = (R._spread(cells[:, 0]) << np.uint64(1)) | R._spread(cells[:, 1])
        codes.sort()
        assert sorted(zip(R._gather(codes >> np.uint64(1)).tolist(), R._gather(codes).tolist())) == sorted(map(tuple, cells.tolist()))
        impacts = rng.integers(1, 1000, len(codes)).astype(np.int32)
        levels, firsts, kids, most = R.quadtree(codes, impacts)
        assert len(levels) < len(codes) and len(most) == len(codes) + len(levels) and ((kids >= 0).sum(axis=1) >= 2).all()
        inside = {}  # the points of every cell, and the largest impact among them
        for node, (level, first, own) in enumerate(zip(levels.tolist(), firsts.tolist(), kids.tolist()), len(codes)):
            want = np.flatnonzero(codes >> np.uint64(2 * level) == codes[first] >> np.uint64(2 * level))
            got = np.concatenate([inside.get(c, np.array([c])) for c in own if c >= 0])
            inside[node] = np.sort(got)
            assert inside[node].tolist() == want.tolist() and most[node] == impacts[want].max()
        assert not len(levels) or len(inside[len(most) - 1]) == len(codes)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    assert found(QUERIES["op12_search"](spark, sf)) == by_definition(docs, items)


@pytest.mark.parametrize("block,points,slice_bytes,parts", [(1, 10**6, 10**6, 1), (64, 10**6, 60, 3), (10**6, 300, 10**6, 2)])
def test_blocks_slices_and_ties(spark, block, points, slice_bytes, parts):
    rng = random.Random(block)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Éa", "日本", "x1Y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(1000, docs[7][1]), (None, docs[7][1]), (None, docs[7][1])]  # ties, repeated rows, no ids
    docs += [(2000, None), (2001, ""), (2002, " ,.\t"), (2003, "w2 " * 60_000 + "rare"), (2004, "W2,w3;rare-ÉA")]
    items = {i: " ".join(rng.choices(words, k=12)) for i in range(12)} | {50: docs[7][1], 51: "rare éa Éa", 52: None, 53: "nothing here is known", 54: "w2 " * 300, None: "w3 x1y"}
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, rank string").repartition(parts)
    asked = spark.createDataFrame([(*i, "c") for i in items.items()], "item_id long, text string, score string")
    index = R.build_index(df, block_docs=block, block_points=points)
    assert found(R.search(index, asked, slice_bytes=slice_bytes)) == by_definition(docs, items)
    assert found(R.search(index, asked, k=70)) == by_definition(docs, items, 70)
    both = asked.unionByName(spark.createDataFrame([(51, "w1 rare", "d"), (51, "w1 rare", "d")], asked.schema))
    assert found(R.search(index, both)) == by_definition(docs, items | {51: "rare éa Éa w1"})  # rows that share an id are one item
    assert R.search(index, asked.limit(0)).count() == R.search(R.build_index(df.limit(0)), asked).count() == 0


def test_ranges_that_cannot_win_are_left_alone():
    rng = random.Random(2)
    kinds = [[f"{a}{i}" for i in range(60)] for a in "pqrs"]
    docs = [" ".join(rng.choices(kinds[i * 4 // 4096], k=30)) for i in range(4096)]
    codes, impacts, words = [], [], sorted({w for d in docs for w in d.split()})
    for col, d in enumerate(docs):
        for w, tf in Counter(d.split()).items():
            codes.append((words.index(w), col))
            impacts.append(10**9 * tf // (1000 * tf + 800))
    where = np.array(codes)
    z = (R._spread(where[:, 0]) << np.uint64(1)) | R._spread(where[:, 1])
    by = np.argsort(z)
    z, impacts = z[by], np.array(impacts, np.int32)[by]
    levels, firsts, kids, most = R.quadtree(z, impacts)
    row = {"doc_ids": list(range(4096)), "vocabulary": R._pack(np.frombuffer("\n".join(words).encode(), np.uint8)), "codes": R._pack(z, True), "impacts": R._pack(most), "levels": R._pack(levels), "firsts": R._pack(firsts), "kids": R._pack(kids.reshape(-1))}
    block = R.Block(row)
    seen = []
    split = block._split
    block._split = lambda level, *rest: seen.append(len(level)) or split(level, *rest)
    best = R.Best(10)
    block.search(np.array([words.index("p1"), words.index("p2")]), np.array([5, 7]), best)
    assert len(best.rows()) == 10 and sum(seen) < 2048  # of 4,095 ranges
