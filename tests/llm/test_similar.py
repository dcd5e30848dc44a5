import random

import corpus_pipeline
from schedlake.llm.common import table
from schedlake.llm.simhash import one_of_each
from test_simhash import by_definition, roots


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_of_each_equals_brute_force_jaccard(spark):
    rng = random.Random(8)
    texts = ["", None, " \t", "one two", "ONE two", "one two three"]
    for i in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randrange(1, max(2, len(copy) // 20))):
                copy[at] = "new"
            texts.append(" ".join(copy))
    sets = [shingles(t or "") for t in texts]
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = roots(range(len(texts)), alike)
    far = [(a, b) for a in range(len(texts)) for b in range(a) if alike(a, b) and (by_definition(texts[a]) ^ by_definition(texts[b])).bit_count() > 3]
    assert len(far) > 20  # pairs that three differing bits miss
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = one_of_each(docs).collect()
    assert {r.doc_id for r in got} == set(root.values()) and len(got) == len(set(root.values()))


def test_stage_finds_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t or "") for i, t in texts.items()}
    root = roots(sorted(texts), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == set(root.values())
