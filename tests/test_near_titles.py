"""Similar titles of one instant, found through segments."""

import random

from pyspark.sql import functions as F

from schedlake.operators import calendar as L

AT = ["calendar_id", "start_ms"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def similar(a, b):
    return a == b or bool(a and b) and 1.0 - distance(a, b) / max(len(a), len(b)) >= 0.85


def edited(rng, text):
    out = list(text)
    for _ in range(rng.randrange(0, max(2, len(text) // 5))):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abc"))
        elif out and kind == 1:
            del out[min(at, len(out) - 1)]
        elif out:
            out[min(at, len(out) - 1)] = rng.choice("abc")
    return "".join(out)


def test_all_similar_pairs_and_no_others(spark):
    rng = random.Random(6)
    old = ["", "a", "ab", "abcdef", "abcdefg"] + ["weekly meeting " + "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    old += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 45))) for _ in range(60)]
    new = old[:20] + [edited(rng, rng.choice(old)) for _ in range(250)]
    rows = lambda keys, name: spark.createDataFrame([(1, 2, k) for k in dict.fromkeys(keys)], f"calendar_id int, start_ms long, {name} string")
    pairs = L.near_keys(rows(new, "new_key"), rows(old, "old_key"), AT)
    got = {(r.new_key, r.old_key) for r in pairs.collect()}
    want = {(a, b) for a in new for b in old if a and b and similar(a, b)}
    assert want <= got and len(want) > 200
    planned = spark.createDataFrame([(f"e{i}", 1, 2, k) for i, k in enumerate(new)], "entry_id string, calendar_id int, start_ms long, title string")
    there = spark.createDataFrame([(i, 1, 2, k, False, None) for i, k in enumerate(old)], "event_id int, calendar_id int, start_ms long, title string, deleted boolean, app_uri string")
    key = lambda t: "".join(c for c in " ".join(t.split()).lower() if c.isalnum() or c == " ").strip()
    first = {}
    for i, k in enumerate(new):
        hits = [j for j, o in enumerate(old) if similar(key(o), key(k))]
        if hits:
            first[f"e{i}"] = min(hits)
    assert {r.entry_id: r.event_id for r in L.find_duplicates(planned, there).collect()} == first


def test_very_many_titles_at_one_instant(spark, n=100_000, asked=1000):
    """A hundred thousand different titles that begin alike: pairs to verify stay few."""
    word = "translate(conv(CAST(pmod(xxhash64(id, {0}), 2000000000) AS STRING), 10, 36), '0123456789', 'klmnopqrst')"
    title = f"lower(concat('weekly review ', {word.format(1)}, {word.format(2)}, {word.format(3)}))"
    old = spark.range(n).selectExpr("1 AS calendar_id", "2L AS start_ms", f"{title} AS old_key").distinct()
    new = old.selectExpr("calendar_id", "start_ms", "concat(substring(old_key, 1, 25), 'x', substring(old_key, 27, 99)) AS new_key").distinct().limit(asked)
    pairs = L.near_keys(new, old, AT)
    close = pairs.withColumn("near", L.similarity(F.col("old_key"), F.col("new_key")) >= L.SIMILAR)
    counts = close.agg(F.count("*").alias("n"), F.count_if("near").alias("near")).first()
    assert counts.near >= asked and counts.n < 200 * asked  # of 100,000 for each


def test_one_shared_segment_is_too_little(spark):
    """Of 32 letters at most four may be edited, and six segments are looked up: a pair must share two."""
    key = "abcdefghijklmnopqrstuvwxyz012345"
    rows = lambda keys, name: spark.createDataFrame([(1, 2, k) for k in keys], f"calendar_id int, start_ms long, {name} string")
    one = {key[:4] + "#" * 28, "#" * 28 + key[28:], "#" * 12 + key[12:16] + "#" * 16}
    near = {key, key[:10] + "####" + key[14:], "##" + key + "#", "#" + key[1:8] + "#" + key[9:16] + "#" + key[17:24] + "#" + key[25:]}
    pairs = L.near_keys(rows(sorted(one | near), "new_key"), rows([key], "old_key"), AT)
    assert {r.new_key for r in pairs.collect()} == near
