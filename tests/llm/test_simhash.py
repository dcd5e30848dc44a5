import random

import pytest
import xxhash
from pyspark.sql import functions as F

from schedlake.llm import simhash as simhash_module
from schedlake.llm.components import components
from schedlake.llm.simhash import near_classes, near_links, op2_simhash, simhash


def by_definition(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("most", [2048, 2])
def test_links_have_the_components_of_all_pairs(spark, most):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    flips = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    values = {0, (1 << 64) - 1, *base, *(flips(rng.choice(base), rng.randrange(1, 6)) for _ in range(300))}
    values |= {base[0] ^ (b << 32) for b in range(60)}  # one half in common: a hot bucket
    values = sorted(values, key=signed)
    links = near_links(spark.createDataFrame([(signed(v),) for v in values], "fingerprint long"), most=most)
    assert all(0 < ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3 for r in links.collect())
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    values = [signed(v) for v in values]
    want = roots(values, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    assert want == {v: got.get(v, v) for v in values}


def test_probes_are_never_sent_to_the_driver(spark, monkeypatch):
    """66 exploded probes of a fingerprint count as one row in Spark's estimates."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], simhash_module.written
    monkeypatch.setattr(simhash_module, "written", lambda df, name: plans.append(plan(df)) or write(df, name))
    prints = spark.range(3000).select(F.xxhash64("id").alias("fingerprint"))
    prints = prints.unionByName(prints.select(F.expr("fingerprint ^ 5L").alias("fingerprint")))
    links = near_links(prints, most=2)
    assert links.distinct().count() >= 3000
    assert any("Generate" in p for p in plans) and not any("BroadcastExchange" in p for p in [*plans, plan(links)])


def test_components_of_long_paths_and_hot_nodes(spark):
    path = [(i, i + 1) for i in range(0, 100)]
    hub = [(1000, i) for i in range(1001, 1500)]
    rows = spark.createDataFrame([*path, *hub, (2000, 2000), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(rows, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 1000 for i in range(1000, 1500)}, 2000: 2000}


def test_classes_equal_brute_force(spark):
    base = " ".join(f"Word{i}" for i in range(400))
    texts = [base, base.lower(), base + " tail", "x " + base, None, "", " \t ", "one", "ONE", "one two", "a b c", "é É", "q" * 9000]
    rows = [(i + 10, t, "clash") for i, t in enumerate(texts)] + [(None, "one", "x"), (10, base, "clash"), (None, "lonely", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    prints = [by_definition(t) for _, t, _ in rows]
    root = roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _, _), p in zip(rows, prints):
        least[root[p]] = min((x for x in (least.get(root[p]), i) if x is not None), default=None)
    want = [(i, signed(p), least[root[p]]) for (i, _, _), p in zip(rows, prints)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, near_classes(df).collect()), key=key) == sorted(want, key=key)
    assert near_classes(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: by_definition(r.text) for r in docs}
    root = roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert {tuple(r) for r in op2_simhash(spark, sf).collect()} == {(i, f"{p:016x}", least[root[p]]) for i, p in prints.items()}


def test_long_text_is_hashed_whole():
    text = "a b c " * 40_000 + "end of it"
    assert simhash(text) == signed(by_definition(text))
