"""Lines of a page against the sequential rule they follow."""

import random

from schedlake.operators import geometry as G
from schedlake.session import written

SCHEMA = "doc_id string, page int, run_id long, text string, l double, t double, r double, b double, conf double, origin string"


def by_rule(runs, unit):
    """(run, line): centres in order; one joins the line while it is near the line's mean."""
    out, line, centres = {}, -1, []
    for run, c in sorted(runs, key=lambda x: x[1]):
        if not centres or abs(c - sum(centres) / len(centres)) > unit * G.TOLERANCE:
            line, centres = line + 1, []
        centres.append(c)
        out[run] = line
    return out


def page(doc, number, tops):
    return [(doc, number, i, f"w{i}", 0.0, float(t), 10.0, float(t + 10), None, "PdfTextLayer") for i, t in enumerate(tops)]


def test_lines_equal_the_rule(spark):
    rng = random.Random(11)
    pages = {("d", p): [rng.choice([rng.randrange(0, 4000) / 8, 20.0 * rng.randrange(30), rng.randrange(0, 60) * 3.25]) for _ in range(rng.choice([1, 7, 200]))] for p in range(12)}
    pages["e", 0] = [i * 1.25 for i in range(4000)]  # one band: every centre within reach of the one before
    rows = [r for (doc, p), tops in pages.items() for r in page(doc, p, tops)]
    runs = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in G.cluster_lines(runs, G.page_units(runs)).collect():
        got.setdefault((r.doc_id, r.page), {})[r.run_id] = r.line
    assert got == {k: by_rule(list(enumerate(t + 5 for t in tops)), 10.0) for k, tops in pages.items()}
    assert max(got["e", 0].values()) > 300


def test_a_band_of_very_many_centres(spark):
    n = 200_000
    runs = spark.range(n).selectExpr(
        "'d' AS doc_id", "0 AS page", "id AS run_id", "'w' AS text", "0D AS l", "id * 1.5D AS t", "10D AS r", "id * 1.5D + 10 AS b", "CAST(NULL AS DOUBLE) AS conf", "'PdfTextLayer' AS origin"
    )
    lines = written(G.cluster_lines(runs, G.page_units(runs)), "lines")
    assert lines.count() == n and lines.select("line").distinct().count() > n / 20
