import hashlib
import random
import re
import string

import pytest

from schedlake.llm.secret_scan import op1_secrets, samples, scan, train

BASE = [
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


WORDS = "the customer identifier handler returns configuration of international understanding for several applications".split()


def random_text(rng):
    bits = [
        "password=hunter22", "PASSWD : 'abc'", 'Api_Key"="x/y+z==', "apikey=12345", "token:token:password1", "secret:secret=abcdefg",
        "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 15, "AKIASHORT", "deadbeef" * 3, "DEADBEEF" * 3, "0" * 23, "f" * 60, "é語😀", "ſecret=abcdefg", "toKen=abcdef",
        "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(8, 40))), *WORDS,
    ]
    return "".join(rng.choice(bits) + rng.choice([" ", "\n", "", ", "]) for _ in range(rng.randrange(60)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [None, "", "x" * 50_000 + " token=abcdefgh " + "é" * 50_000, "token=abcdef " * 3000, *(random_text(rng) for _ in range(300))]


def test_base_spans_equal_the_patterns(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, kind string, model int")
    rows = scan(df, train(samples(df))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = [f"{x.kind}:{x.start}:{x.end}" for x in r.found]
        assert [s for s in spans if not s.startswith("markov")] == base(texts[r.doc_id])
        assert r.n_assign == sum(s.startswith("assign") for s in spans) and r.n_markov == sum(s.startswith("markov") for s in spans)
        starts = [x.start for x in r.found]
        assert starts == sorted(starts)
        text = texts[r.doc_id] or ""
        for x in r.found:
            if x.kind == "markov":
                assert re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", text[x.start : x.end])
                assert not any(y.start < x.end and x.start < y.end for y in r.found if y.kind != "markov")


def test_markov_tells_random_strings_from_identifiers(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["in", "ter", "na", "tion", "al", "con", "fig", "er", "ing", "the", "re"]) for _ in range(8))
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(28))
    labelled = [(word(), False) for _ in range(300)] + [(key(), True) for _ in range(100)] + [(None, True), ("é", False), ("ab", None)]
    model = train(spark.createDataFrame(labelled, "sample string, random boolean"))
    held = [(i, f"see {key()} or {word()}") for i in range(200)]
    got = scan(spark.createDataFrame(held, "doc_id long, text string"), model).collect()
    right = sum([x.start for x in r.found] == [4] for r in got)
    assert right >= 198
    untrained = train(spark.createDataFrame([("only", False)], "sample string, random boolean"))
    assert all(not r.found for r in scan(spark.createDataFrame(held, "doc_id long, text string"), untrained).collect())


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "token=abcdef"), (1, "token=abcdef"), (None, "token=abcdef")], "doc_id long, text string")
    model = train(samples(df))
    assert sorted((r.doc_id or 0, r.n_assign) for r in scan(df, model).collect()) == [(0, 1), (1, 1), (1, 1)]
    assert scan(df.limit(0), train(samples(df.limit(0)))).count() == 0


def test_ordinary_tokens_come_from_all_documents(spark):
    docs = [(1, "token=Zx81kQp0vBn3 beside"), (2, "identifier_of_plain words"), (3, "another_identifier"), (4, None)]
    got = samples(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.sample, r.random) for r in got) == [("Zx81kQp0vBn3", True), ("another_identifier", False), ("identifier_of_plain", False)]
    # without any labelled secret there is nothing to compare with: base columns are empty, and no span is added
    plain = spark.createDataFrame([(2, "identifier_of_plain Zx81kQp0vBn3Zx81kQp0vBn3"), (3, "")], "doc_id long, text string")
    assert [(r.found, r.n_assign, r.n_markov) for r in scan(plain, train(samples(plain))).collect()] == [([], 0, 0)] * 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op1_secrets(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == want
