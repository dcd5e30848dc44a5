import random

import numpy as np
import pytest

from schedlake.llm.decontamination import _Words, contaminated, op6_decontamination, template

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and reaches Albany after 5 hours of steady travel along the river."),
    (2, "If Maria buys 12 apples and Peter buys 7 apples, how many apples do Maria and Peter own when 3 rot?"),
    (3, "short item of seven words only here"),
    (4, "12 34 56 78 90 11 22 33 44 55 66 77"),
    (5, None), (6, "too few"), (None, "an item without any id that still has quite enough words to be found"),
]
DOCS = [
    (10, "Intro text. " + ITEMS[0][1] + " More text follows here."),
    (11, "a TRAIN leaves Chicago at 95 mi per hour and reaches Denver after 8 hours of steady travel along the river"),
    (12, "If Laura buys 30 apples and Simon buys 9 apples, how many apples do Laura and Simon own when 4 rot?"),
    (13, "If Laura buys 30 apples and Simon buys 9 apples, how many apples do Simon and Laura own when 4 rot?"),  # slots cross
    (14, "prefix " + ITEMS[2][1] + " suffix"), (15, "short item of seven words only"), (16, ITEMS[3][1]), (17, "99 88 77 66 55 44 33 22 11 12 13 14"),
    (18, None), (19, ""), (20, "nothing in common with any of the items " * 300), (20, "nothing in common with any of the items " * 300),
    (21, "x " * 5000 + ITEMS[0][1] + " y" * 5000), (None, ITEMS[1][1]), (22, "said Anna: " + ITEMS[-1][1]), (23, "If Maria buys 12 apples and Peter"),
]
WANT = {
    (10, 1, True), (11, 1, False), (12, 2, False), (14, 3, True), (16, 4, True), (21, 1, True), (None, 2, True), (22, None, True),
}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_cases(spark, most):
    docs = spark.createDataFrame([(*d, "clash", 7) for d in DOCS], "doc_id long, text string, item_id string, pos int")
    items = spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id long, text string, slots string")
    got = contaminated(docs, items, most_broadcast=most).collect()
    assert {(r.doc_id, r.item_id, r.same_slots) for r in got} == WANT and len(got) == len(WANT)
    assert contaminated(docs.limit(0), items, most_broadcast=most).count() == 0
    assert contaminated(docs, items.limit(0), most_broadcast=most).count() == 0


def test_template_types_words():
    words, frame, literal, slot = template('The cost is 5 km. Paris saw Anna "run" 3,5 % | of km', _Words())
    assert words == ["The", "cost", "is", "5", "km.", "Paris", "saw", "Anna", '"run"', "3,5", "of", "km"]
    assert frame[slot].tolist() == [1, 2, 3, 1] and np.flatnonzero(slot).tolist() == [3, 4, 7, 9]


def brute_force(texts, items, window=8, enough=13):
    """For texts without numbers, units or names: runs of equal words."""
    fold = lambda t: [w.strip(".,;:!?|'\"*$%&#-").casefold() for w in (t or "").split()]
    items = {i: [w for w in fold(t) if w] for i, t in items.items()}
    at = {}
    for i, words in items.items():
        for p in range(len(words) - window + 1):
            at.setdefault(tuple(words[p : p + window]), []).append((i, p))
    found = set()
    for d, text in texts.items():
        words, hits = [w for w in fold(text) if w], {}
        for p in range(len(words) - window + 1):
            for i, q in at.get(tuple(words[p : p + window]), ()):
                hits.setdefault((i, p - q), set()).update(range(q, q + window))
        found |= {(d, i) for (i, _), c in hits.items() if len(c) >= min(enough, max(-(-len(items[i]) // 2), window))}
    return found


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = brute_force(docs, items)
    assert want and {(r.doc_id, r.item_id) for r in op6_decontamination(spark, sf).collect()} == want


def test_random_text_is_left_alone(spark):
    rng = random.Random(2)
    words = [f"w{i}x" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(50)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.count() == 0
