import random

import numpy as np

from schedlake.llm.quality import N_TEXT, classify, op4_quality, text_features

SF = "/root/testdata/sf0.1"


def test_features_are_finite_and_count_whole_texts():
    for text in ("", " ", "a", "语言 " * 9, "x" * 100_000, "A!! B!!\n" * 5000, "\x00"):
        x = text_features(text)
        assert len(x) == N_TEXT and np.isfinite(x).all()
    assert text_features("a b " * 1000) != text_features("a b " * 1000 + "!!! " * 1000)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = classify(docs, fit).join(held, "doc_id").select("accepted", "quality").collect()
    good = [r.accepted for r in found if r.quality == 1]
    bad = [r.accepted for r in found if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.05


def make(n, rng):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = [rng.choice(["plain", "calm", "words", "tell", "more"]) if good else rng.choice(["BUY!!", "NOW$$", "BUY!!"]) for _ in range(40)]
        rows.append((i, " ".join(words), "en", "a" if good else "b", 100 if good else 900, "clash"))
        if i % 4 == 0:
            labels.append((i, int(good)))
    return rows, labels


def test_views_cases_and_extra_columns(spark):
    rng = random.Random(1)
    rows, labels = make(400, rng)
    rows += [(None, None, None, None, None, None), (500, "", None, "a", -5, "x"), (500, "", None, "a", -5, "x"), (501, "z" * 200_000, "en", "a", 1, "x")]
    labels += [(0, 1 - dict(labels)[0]), (4, None), (9999, 1), (None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_x string")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    got = classify(docs, given).collect()
    assert len(got) == len(rows) and all(r.p_quality is not None for r in got)
    truth = {r[0]: r[3] == "a" for r in rows[:400]}
    assert np.mean([r.accepted == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.99
    # either view alone would do here
    assert np.mean([(r.p_meta >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.99
    assert np.mean([(r.p_text >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.99
    one_class = classify(docs, given.where("quality = 1")).collect()
    assert len(one_class) == len(rows) and all(r.accepted and r.p_quality is None for r in one_class)
    assert classify(docs.limit(0), given).count() == 0


def test_query_scores_every_row(spark):
    sf = "/root/testdata/sf0.001"
    assert op4_quality(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_co_training_beats_each_view_alone(spark):
    """Few labels, two weak views that err apart: what one view is sure of teaches the other."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(6000):
        good = i % 2 == 0
        # the text says it in most documents, the source in most others; each view sees many kinds that no label shows
        kind = rng.randrange(3)
        words = ["plain", "calm", "tell", "more"] if good else ["Buy!!", "NOW$$", "WIN##", "Go!!"]
        text = " ".join(rng.choice(words if kind != 0 else ["plain", "Buy!!", "calm", "NOW$$"]) for _ in range(30))
        source = f"{'ab'[good]}{rng.randrange(12)}" if kind != 1 else f"c{rng.randrange(12)}"
        rows.append((i, text, "en", source, 100))
        if i < 60:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    right = {}
    for rounds in (0, 3):
        got = [r for r in classify(docs, given, rounds=rounds, sure=0.9).collect() if r.doc_id >= 60]
        for name in ("p_text", "p_meta", "p_quality"):
            right[rounds, name] = np.mean([(r[name] >= 0.5) == (r.doc_id % 2 == 0) for r in got])
    assert right[3, "p_meta"] > right[0, "p_meta"] + 0.01  # sources that no label shows are learned from texts
    assert right[3, "p_quality"] > max(right[3, "p_text"], right[3, "p_meta"], right[0, "p_text"], right[0, "p_meta"]) + 0.05
    assert right[3, "p_quality"] > right[0, "p_quality"] + 0.03


def test_all_confident_rows_count(spark):
    """Newton sums over tasks equal a fit on all rows at once."""
    from pyspark.sql import functions as F

    from schedlake.llm.quality import Logistic, Pseudo

    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=9000) > 0).astype(float)
    places = rng.integers(0, 2, (9000, 2)) + [0, 2]
    rows = spark.createDataFrame([(a, b, c) for a, b, c in zip(x[500:].tolist(), places[500:].tolist(), y[500:].tolist())], "x array<double>, b array<int>, y double").repartition(7)
    hot = np.zeros((9000, 4))
    hot[np.arange(9000)[:, None], places] = 1
    for n, wide in ((0, x), (4, np.c_[x, hot])):
        some = Logistic(wide[:500], y[:500], more=Pseudo(rows if n else rows.withColumn("b", F.array().cast("array<int>")), n))
        every = Logistic(wide, y)
        assert np.allclose(some.logit(wide), every.logit(wide), atol=1e-3)
