import base64
import collections
import hashlib
import math
import random

import numpy as np
import pytest

from schedlake.llm import improbable_digest as D
from schedlake.llm.common import table
from schedlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def entropy_by_definition(raw):
    out = []
    for s in range(len(raw) - D.WINDOW + 1):
        counts = collections.Counter(raw[s : s + D.WINDOW]).values()
        # the costs are rounded to 2**-20 so that equal windows have equal classes wherever they stand
        spent = sum(round(c * math.log2(c) * 2**20) for c in counts)
        out.append(int((round(D.WINDOW * math.log2(D.WINDOW) * 2**20) - spent) * (1000 / round(D.WINDOW * math.log2(D.WINDOW) * 2**20))))
    return out


def features_by_definition(raw, rank):
    """Places of the features: votes of every run of windows, also of those that reach over an end."""
    classes = entropy_by_definition(raw)
    votes = collections.Counter()
    for s in range(1 - D.RUN, len(classes)):
        run = range(max(s, 0), min(s + D.RUN, len(classes)))
        votes[min(run, key=lambda i: (rank[classes[i]], i))] += 1
    most = max(votes.values())
    return sorted(i for i, v in votes.items() if v >= min(D.VOTES, most))


def test_entropies_and_features_equal_the_definition():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde fgh é\n") for _ in range(n)) for n in (16, 17, 40, 333, 900)] + ["w " * 200, "x" * 90, "-" * 15 + "ab" * 30]
    hist = np.zeros(D.CLASSES, np.int64)
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        assert D.entropies(data).tolist() == entropy_by_definition(t.encode())
        hist += np.bincount(D.entropies(data), minlength=D.CLASSES)
    rank = D.ranks(hist)
    assert sorted(rank) == list(range(D.CLASSES)) and rank[: D.WEAK].min() == D.CLASSES - D.WEAK
    for t in texts:
        raw = t.encode()
        data = np.frombuffer(raw, np.uint8)
        got = D.features(data, D.entropies(data), rank)
        places = features_by_definition(raw, rank)
        single = [D.features(w, D.entropies(w), rank)[0] for w in (data[p : p + D.WINDOW] for p in places)]
        assert got.tolist() == list(dict.fromkeys(int(x) for x in single))


def test_likeness():
    rng = np.random.default_rng(5)
    rank = D.ranks(np.zeros(D.CLASSES, np.int64))

    def digest(data):
        return D.Digest(data, D.entropies(data), rank)

    long = rng.integers(97, 123, 60_000, np.uint8)
    other = digest(rng.integers(97, 123, 60_000, np.uint8))
    whole, part, empty = digest(long), digest(long[20_000:40_000]), digest(long[:0])
    assert len(whole.rows) > 5 and whole.n > 5 * D.FEATURES
    assert D.likeness(whole, whole) == D.likeness(empty, empty) == 1 and D.likeness(empty, whole) == D.likeness(whole, empty) == 0
    assert D.likeness(whole, other) < 0.02 and D.likeness(whole, part) == D.likeness(part, whole) > 0.3
    # many filters are compared in blocks: as each by itself
    best = 0.0
    for i, (row, size) in enumerate(zip(whole.rows, whole.size)):
        scores = []
        for r, s in zip(other.rows, other.size):
            common, most, chance = int(np.bitwise_count(row & r).sum()), min(size, s), size * s / D.FILTER_BITS
            floor = chance + D.ALPHA * (most - chance)
            scores.append(min(1.0, max(0.0, (common - floor) / (most - floor))))
        best += max(scores) * min(D.FEATURES, whole.n - i * D.FEATURES)
    if (whole.n, whole.rows.tobytes()) <= (other.n, other.rows.tobytes()):
        assert abs(D.likeness(whole, other) - best / whole.n) < 1e-12


def edited_by_definition(rows):
    """rows: (id, text) along descending ids."""
    for k, (i, t) in enumerate(rows):
        third, after = len(t) // 3, rows[(k + 1) % len(rows)][1]
        yield i, len(t), hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]
    rows.sort(key=lambda r: -r[0])
    got = {r.doc_id: r for r in QUERIES["op13_fingerprints"](spark, SF).collect()}
    assert {(i, got[i].n_chars, got[i].edited_sha256) for i in got} == set(edited_by_definition(rows)) and len(got) == len(rows)
    hist = D.entropy_histogram(table(spark, SF, "documents"))
    brute = collections.Counter(c for _, t in rows for c in entropy_by_definition(t.encode()))
    assert {c: n for c, n in enumerate(hist.tolist()) if n} == dict(brute)
    rank = D.ranks(hist)
    prints = {}
    for k, (i, t) in enumerate(rows):
        data = np.frombuffer(t.encode(), np.uint8)
        digest = D.Digest(data, D.entropies(data), rank)
        after = rows[(k + 1) % len(rows)][1]
        edited = np.frombuffer((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode(), np.uint8)
        theirs, nexts = (D.Digest(x, D.entropies(x), rank) for x in (edited, np.frombuffer(after.encode(), np.uint8)))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (str(digest), str(theirs), D.likeness(digest, theirs), D.likeness(digest, nexts))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint  # equal texts, equal fingerprints
        n, chain = r.fingerprint.split(":")
        assert len(base64.b64decode(chain)) == -(-int(n) // D.FEATURES) * D.FILTER_BITS // 8


def test_edited_texts_are_told_from_other_texts(spark):
    got = [r for r in D.digest_with_next(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.n_chars >= 200]
    same = sum(r.near_next > 0.9 for r in got)  # copies that follow each other
    assert sum(r.near_edited > 0.3 for r in got) > 0.97 * len(got)
    assert sum(r.near_next < 0.1 for r in got) > 0.97 * (len(got) - same)


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_rows(spark, parts):
    rows = [
        (3, "plain words of a text " * 9, "x"), (3, "plain words of a text " * 9, "x"), (3, "another text", "y"), (None, None, None), (None, "né🙂" * 30, None),
        (7, None, "z"), (9, "", "z"), (-2, "w " * 150_000, "n"), (2**63 - 1, "short", "m"), (-(2**63), "least of all", "m"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(parts)
    got = D.digest_with_next(df).collect()
    order = sorted(df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = sorted(edited_by_definition([(r.doc_id, r.text) for r in order]), key=repr)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = D.digest_with_next(df.where("doc_id = 9")).collect()
    assert [(r.doc_id, r.near_edited, r.near_next, r.fingerprint) for r in one] == [(9, 1.0, 1.0, "0:")]
    assert D.digest_with_next(df.limit(0)).count() == 0
