"""What must not reach the driver or be computed once a row, however small Spark takes its input to be."""

import time

from pyspark.sql import functions as F

from schedlake.functions import dates as D
from schedlake.functions import once as once_module
from schedlake.functions.ordered import in_one_range
from schedlake.operators import calendar as L
from schedlake.operators import geometry as G
from schedlake.operators import quality as Q
from schedlake.operators import pages as P
from schedlake.operators import resolve as R
from schedlake.operators import schedules as S
from schedlake.operators import tokens as K
from schedlake.plans import resolution
from schedlake import session
from schedlake.session import written
from schedlake.sources import rendered


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_surroundings_of_cells_are_shuffled_and_whole(spark):
    cells = spark.range(400).selectExpr("id % 2 AS doc_id", "'s' AS sheet", "CAST(id div 2 % 20 AS INT) AS row_no", "CAST(id div 40 AS INT) AS col", "CAST(id AS STRING) AS text")
    focus = spark.createDataFrame([(0, "s", 0, 0), (1, "s", 9, 5), (1, "s", 21, 9), (0, "s", -2, 3), (0, "s", -9, 3)], "doc_id long, sheet string, row_no int, col int")
    for reach in (1, 3):
        out = Q.cell_context(focus, cells, reach)
        assert "BroadcastHashJoin" not in _plan(out)
        got = sorted((r.doc_id, r.focus_row, r.focus_col, r.row_no, r.col) for r in out.collect())
        want = sorted(
            (f.doc_id, f.row_no, f.col, c.row_no, c.col) for f in focus.collect() for c in cells.collect()
            if f.doc_id == c.doc_id and abs(f.row_no - c.row_no) <= reach and abs(f.col - c.col) <= reach
        )
        assert got == want


def test_duplicates_are_met_by_shuffles(spark):
    rows = spark.range(50).selectExpr("CAST(id AS STRING) AS entry_id", "id AS event_id", "1 AS calendar_id", "7L AS start_ms", "concat('meeting ', id) AS title", "false AS deleted", "CAST(NULL AS STRING) AS app_uri")
    found = L.find_duplicates(rows, rows)
    rest = L.skip_duplicates(rows, found, found.where("event_id = 3").select("entry_id"))
    assert found.count() == 50
    assert "BroadcastHashJoin" not in _plan(found) and "BroadcastHashJoin" not in _plan(rest)


def test_a_long_line_of_digits_is_no_long_search(spark):
    text = spark.range(8).select(F.repeat(F.lit("7 x "), 20_000).alias("text"))
    begin = time.time()
    assert text.selectExpr(f"size({D.date_tokens('text')}) AS n").agg(F.sum("n")).first()[0] == 0
    assert text.selectExpr(f"{D.holds_reading('text')} AS r").where("r").count() == 0
    assert time.time() - begin < 20


def test_equal_lines_are_read_once(spark):
    lines = spark.range(3000).selectExpr("id AS doc_id", "1 AS line_no", "concat('Due date: ', 1 + id % 3, ' May 2026') AS text")
    read = S.prose_dates(lines)
    assert read.count() == 3000
    folder = next(f for f in read.inputFiles() if "date-texts" in f).rsplit("/", 1)[0]
    assert spark.read.parquet(folder).count() == 3


def test_equal_cells_are_read_once(spark):
    cells = spark.range(3000).selectExpr("id AS doc_id", "'s' AS sheet", "1 AS row_no", "1 AS col", "concat('9:', 10 + id % 3, ' 12/05/2026') AS text")
    at = ["doc_id", "sheet", "row_no", "col"]
    for read, folder in ((S.cell_features(cells), "cell-texts"), (S.cell_dates(cells, at), "cell-date-texts")):
        assert read.count() == 3000
        written = next(f for f in read.inputFiles() if folder in f).rsplit("/", 1)[0]
        assert spark.read.parquet(written).count() == 3


def test_borders_of_a_page_are_grouped_after_no_union(spark, monkeypatch):
    """A union of rows dealt by page is not dealt by page once its inputs are coalesced apart, yet is grouped as if it were."""
    rows = [("d", p, i, "word", 100.0 * (i % 3), 20.0 * (i // 3), 100.0 * (i % 3) + 40, 20.0 * (i // 3) + 10, None, "PdfTextLayer") for p in range(4) for i in range(12)]
    runs = spark.createDataFrame(rows, "doc_id string, page int, run_id long, text string, l double, t double, r double, b double, conf double, origin string")
    units, plans = G.page_units(runs), []
    lines = written(G.cluster_lines(runs, units), "lines")
    monkeypatch.setattr(G, "written", lambda df, name: plans.append(_plan(df)) or written(df, name))
    spans = G.column_spans(lines, units).groupBy("doc_id", "page").count().collect()
    assert [r["count"] for r in spans] == [3] * 4
    assert plans and not any("Union" in p for p in plans)


def test_boxes_of_a_line_move_once(spark):
    """Phrases over borders of ranges are whole, and boxes are dealt out once and not again for every step."""
    def box(line, pos, left):
        return (line, pos, f"w{pos}", float(left), 0.0, left + 40.0, 10.0, 0.9)
    far = [(1, i, 60 * i + 30 * (i % 3 == 0)) for i in range(1, 6000)]  # 20 or 50 apart, three ranges of x and more
    one_phrase = [(2, i, 50 * i) for i in range(4000)]  # 10 apart, from one end to the other
    boxes = spark.createDataFrame([box(*b) for b in [*far, *one_phrase, (3, 0, 0), (3, 1, 200_000)]], "line long, pos int, text string, l double, t double, r double, b double, conf double").withColumn("space", F.lit(8.0))
    for merged, reach in ((P.merge_glyphs(boxes, ["line"]), 32), (P.merge_phrases(boxes, ["line"], 1.5), None)):
        got = {}
        for r in merged.collect():
            got.setdefault(r.line, []).append((r.part, r.l, r.r, r.n, r.text.replace(" ", "")))
        for line, rows in (("far", far), ("one", one_phrase)):
            line, want, prev = rows[0][0], [], None
            limit = reach or 1.5 * sum(40 / len(f"w{i}") for _, i, _ in rows) / len(rows)
            for _, i, left in rows:
                if prev is None or left - prev > limit:
                    want.append([len(want) + 1, float(left), 0, 0, ""])
                want[-1][2], want[-1][3], want[-1][4], prev = left + 40.0, want[-1][3] + 1, want[-1][4] + f"w{i}", left + 40
            assert sorted(got[line]) == [tuple(w) for w in want]
        assert [x[0] for x in sorted(got[3])] == [1, 2]
        assert _plan(merged).count("Exchange hashpartitioning") <= 6


def test_rows_to_search_are_spread_over_tasks(spark, monkeypatch):
    """A file of few bytes holds many rows: no task gets more than its number of them."""
    monkeypatch.setattr(rendered, "ROWS_A_TASK", 500)
    monkeypatch.setattr(rendered, "_ROWS", {})
    lines = rendered.rendered(spark, "/root/testdata/sf0.01", "notices")
    sizes = lines.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == lines.count() // 500 and max(r["count"] for r in sizes) <= 600


def test_dates_of_a_sequence_are_read_once(spark):
    plan = _plan(resolution.date_order_sequence(spark, "/root/testdata/sf0.001"))
    assert "dates-" in plan and "regexp" not in plan.lower()


def test_overlaps_are_searched_once(spark):
    lines = spark.range(5).selectExpr("id AS doc_id", "id AS line_no", "IF(id = 4, 'none', concat('due 0', id + 1, '/02/2026')) AS text")
    report = K.overlap_report(lines, ["doc_id", "line_no"])
    assert sorted((r.line_no, r.found, r.kept, r.kept_raw) for r in report.collect()) == [(i, 1, 1, f"0{i + 1}/02/2026") for i in range(4)]
    assert not any("RLIKE" in x for x in _plan(report).splitlines() if "Filter" in x)


def test_pieces_of_a_cell_are_sorted_once(spark):
    sizes = {0: 1, 1: 5, 2: G.STRETCH, 3: G.STRETCH + 1, 4: 3 * G.STRETCH + 7}
    pieces = [(c, i, None if i % 50 == 3 else f"w{i}", 10.0 * i, 0.0, 10.0 * i + 5, 8.0, 1.0 - i / 9999, "Ocr" if i == 4 else "Pdf", i == 2) for c, n in sizes.items() for i in range(n)]
    rows = spark.createDataFrame(pieces, "cell int, run_id int, text string, l double, t double, r double, b double, conf double, origin string, spanning boolean")
    out = G.cell_texts(rows.repartition(5), ["cell"])
    assert "ObjectHashAggregate" not in _plan(out) and _plan(out).count("Sort [") == 1
    for r in out.collect():
        mine = [p for p in pieces if p[0] == r.cell]
        # no space behind a missing piece
        text = "".join("" if p[2] is None else p[2] if i == 0 or mine[i - 1][2] is None else " " + p[2] for i, p in enumerate(mine))
        assert (r.text, r.l, r.t, r.r, r.b, r.runs) == (text, 0.0, 0.0, mine[-1][5], 8.0, len(mine))
        assert (r.min_conf, r.has_ocr, r.spanning) == (mine[-1][7], len(mine) > 4, len(mine) > 2)
    assert out.count() == len(sizes)


def test_cells_of_dated_tables_are_dealt_by_rows(spark, monkeypatch):
    """Layouts of many sheets are not sent to every task, and no task gets more than its number of cells."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    cells = spark.range(400).selectExpr("id AS doc_id", "explode(array(0L, 1L, 2L)) AS row_no", "'s' AS sheet").selectExpr(
        "*", "posexplode(IF(row_no = 0, array('Event', 'Date', 'Time'), array(concat('Review ', row_no), '2026-03-12', '14:35'))) AS (col, text)"
    )
    layout = written(S.dated_layout(cells), "layout")
    short = S.dated_table(cells, layout).collect()
    monkeypatch.setattr(session, "SENT_ROWS", 100)
    entries = S.dated_table(cells, layout)
    assert sorted(entries.collect()) == sorted(short) and len(short) == 800
    assert session.dealt(cells, ["doc_id"], cells.count()).rdd.getNumPartitions() == 36
    rows = session.met(cells, layout, ["doc_id", "sheet", "col"], 3600, layout.count())
    assert "SortMergeJoin" in _plan(rows) and rows.count() == 3600


def test_lines_of_prose_are_dealt_out_once(spark, monkeypatch):
    """What a document's lines say together is found in one walk; documents over several ranges are read as before, with the same rows."""
    docs = [
        ["Subject: Board review", "Due date: 12 May 2026", "Reporting time: 9:30 am"],
        ["Annual General", "Meeting 05/06/2026 14:35", None, "06/06/2026", "Last date for", "payment 13/06/2026"],
        ["Mathematics", "12/05/2026", "13/05/2026 10:00-11:30", "13/05/2026 10:00-11:30", "", "Mathematics", "05/05/2026"],
        ["31/01/2026", "2026", "03/04/2026"],
        ["Reporting time: 7 pm", "Slot: 8 pm", "Viva on 4 October 1996"],
        ["Project demo", "nothing here"],
    ]
    rows = [(d, n, text) for d, texts in enumerate(docs) for n, text in enumerate(texts * (1 + 3 * (d == 2)))]
    lines = written(spark.createDataFrame([*rows, (None, 1, "Due date: 1 May 2026")], "doc_id long, line_no long, text string"), "lines")
    far = written(lines.selectExpr("doc_id", "line_no + 4090 AS line_no", "text"), "lines")
    assert in_one_range(lines, "line_no") and not in_one_range(far, "line_no")
    plans = []
    for module in (S, R, once_module):
        monkeypatch.setattr(module, "written", lambda df, name: plans.append(_plan(df)) or written(df, name))
    short = S.prose_events(lines)
    dealt = sum(p.count("Exchange hashpartitioning(doc_id") for p in [*plans, _plan(short)])
    plans.clear()
    long = S.prose_events(far).withColumn("line_no", F.col("line_no") - 4090)
    assert dealt <= 7 < sum(p.count("Exchange hashpartitioning(doc_id") for p in plans)
    got = sorted(map(repr, short.collect()))
    assert got == sorted(map(repr, long.select(*short.columns).collect())) and len(got) >= 8
    assert {r.kind for r in short.collect()} > {"Deadline"}
