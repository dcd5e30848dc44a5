"""Range-cut scans equal plain windows, whatever the ranges and the input order."""

import itertools
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schedlake.functions.ordered import last_before, ordered_scan
from schedlake.operators import geometry as G
from schedlake.operators import resolve as R


def test_scan_equals_window(spark):
    rng = random.Random(7)
    data = [(k, p, rng.choice([None, rng.randint(0, 9)])) for k in range(3) for p in rng.sample(range(500), 120)]
    df = spark.createDataFrame(data, "k int, p int, v int").repartition(5)
    got = ordered_scan(df, ["k"], ["p"], F.floor(F.col("p") / 16), {"total": F.coalesce("v", F.lit(0))}, {"prev": ["p", "v"]})
    got = last_before(got, ["k"], ["p"], F.col("v"), "filled", F.floor(F.col("p") / 16))
    w = W.partitionBy("k").orderBy("p")
    want = df.select(
        "*", F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"),
        F.lag(F.struct("p", "v")).over(w).alias("prev"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("filled"),
    )
    cols = ["k", "p", "v", "total", "prev", "filled"]
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))


def brute(column):
    """Every morning/evening split of a column of (hour, marker), as the rule states it."""
    solutions = set()
    for split in range(len(column) + 1):
        times = []
        for i, (hour, marker) in enumerate(column):
            late = marker == "Pm" if marker != "Unstated" else i >= split
            times.append((hour % 12 + (12 if late else 0)) * 60)
        if all(a < b for a, b in itertools.pairwise(times)):
            solutions.add(tuple(times))
    return solutions.pop() if len(solutions) == 1 and len(column) >= 3 else None


def test_meridiem_bounds_equal_enumeration(spark):
    rng = random.Random(3)
    columns = []
    for _ in range(300):
        n = rng.randint(2, 7)
        start = rng.randint(1, 12)
        columns.append([((start + i * rng.choice([1, 1, 1, 2])) % 12 or 12, rng.choice(["Unstated"] * 5 + ["Am", "Pm"])) for i in range(n)])
    rows = [
        (c, i, mer, None if mer == "Unstated" else (h % 12 + (12 if mer == "Pm" else 0)) * 60, h * 60, True, h % 12 * 60, False)
        for c, column in enumerate(columns) for i, (h, mer) in enumerate(column)
    ]
    df = spark.createDataFrame(rows, "c int, i int, mer string, written int, literal int, valid boolean, am int, proof boolean")
    got = {}
    for r in R.resolve_meridiem(df, ["c"], ["i"], F.floor(F.col("i") / 2)).collect():
        got.setdefault(r.c, {})[r.i] = r.minutes
    solved = 0
    for c, column in enumerate(columns):
        if all(mer != "Unstated" for _, mer in column):
            continue
        want = brute(column)
        for i, (_, mer) in enumerate(column):
            if mer == "Unstated":
                assert got[c][i] == (want[i] if want else None), (column, want, got[c])
        solved += want is not None
    assert solved > 20


def test_lines_follow_the_running_mean_in_any_input_order(spark):
    rng = random.Random(5)
    runs = [(1, 0, i, "w", float(i), t := rng.uniform(0, 60), float(i) + 5, t + 10, None, "Ocr") for i in range(60)]
    schema = "doc_id int, page int, run_id int, text string, l double, t double, r double, b double, conf double, origin string"
    lines, total, count, line = {}, 0.0, 0, -1
    for r in sorted(runs, key=lambda r: (r[5] + r[7]) / 2):
        c = (r[5] + r[7]) / 2
        if count == 0 or abs(c - total / count) > 6:
            total, count, line = 0.0, 0, line + 1
        total, count = total + c, count + 1
        lines[r[2]] = line
    for seed in (1, 2):
        random.Random(seed).shuffle(runs)
        df = spark.createDataFrame(runs, schema).repartition(3)
        got = {r.run_id: r.line for r in G.cluster_lines(df, G.page_units(df)).collect()}
        assert got == lines


def test_one_hot_document(spark):
    """One document with nearly all lines resolves like the small ones."""
    lines = spark.range(3000).selectExpr(
        "IF(id < 2900, 1, id) AS doc_id", "id AS line_no",
        "concat('due ', lpad(1 + id % 12, 2, '0'), '/', lpad(1 + id div 12 % 12, 2, '0'), '/', 2000 + id div 144) AS text",
    )
    dates = R.locate_dates(lines, ["doc_id", "line_no"])
    out = R.resolve_dates(dates, ["doc_id"], ["line_no", "start"], F.floor(F.col("line_no") / 64)).where("doc_id = 1")
    kinds = {r.evidence for r in out.select("evidence").distinct().collect()}
    assert "SequenceCoherence" in kinds and None not in kinds
    assert out.count() == 2900
