import hashlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from schedlake.llm.exact_dedup import exact_dedup, exact_groups
from schedlake.plans.registry import connect

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    (1, "Abc", "x"), (2, "aBC", "x"), (3, "abc ", "x"), (4, None, "x"), (5, "", "x"), (6, "É", "x"), (7, "é", "x"),
    (8, "q" * 5000 + "r", "x"), (9, "q" * 5000 + "s", "x"), (10, "Q" * 5000 + "r", "x"), (11, "twin", "b"), (11, "twin", "a"),
    (12, "alone", "x"), (None, "ABC", "x"), (13, "\u212a", "x"), (14, "K", "x"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, source string, text_sha256 string")


def test_groups_equal_brute_force(rows):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[(t or "").translate(FOLD)].append(i)
    want = set()
    for t, ids in groups.items():
        if len(ids) > 1:
            keep = max(i for i in ids if i is not None)
            want |= {(i, hashlib.sha256(t.encode()).hexdigest(), keep, len(ids), ids.count(i)) for i in ids}
    assert {tuple(r) for r in exact_groups(rows).collect()} == want


def test_one_row_of_each_text_stays_whole(rows):
    got = exact_dedup(rows)
    assert got.columns == rows.columns
    assert sorted((r.doc_id, r.source) for r in got.collect()) == [
        (2, "x"), (3, "x"), (5, "x"), (6, "x"), (7, "x"), (9, "x"), (10, "x"), (11, "a"), (12, "x"), (13, "x"), (14, "x"),
    ]
    assert exact_dedup(rows.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op9_exact_dedup"](spark, sf)
    want = connect(sf).execute(entry.oracle_sql()["op9_exact_dedup"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
