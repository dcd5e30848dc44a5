"""Cases beyond limits that once cut results, and documents that hold most of the rows."""

import pytest
from pyspark.sql import functions as F

from schedlake.operators import calendar as L
from schedlake.operators import geometry as G
from schedlake.operators import resolve as R
from schedlake.operators import schedules as S
from schedlake.operators import tokens as K
from schedlake.session import written
from schedlake.sources import intake as N


def test_date_over_a_line_break(spark):
    rows = spark.createDataFrame([(0, "due 14\nSep 2026"), (1, "Sep\n14, 2026"), (2, "x\n14 Sep")], "id int, text string")
    found = K.date_tokens(rows, ["id"]).collect()
    assert sorted((r.id, r.day1, r.month1) for r in found) == [(0, 14, 9), (1, 14, 9), (2, 14, 9)]


def test_gates_change_nothing(spark):
    import random

    from schedlake.functions import dates as D

    rng = random.Random(1)
    parts = ["14", "3", "Sep", "sept.", " ", "\n", "/", "-", "2026", "26", "Mon", "th", ",", "a", ". "]
    texts = [(i, "".join(rng.choice(parts) for _ in range(12))) for i in range(1500)]
    rows = spark.createDataFrame(texts, "id int, text string")
    with_gates = rows.selectExpr("id", f"{D.date_tokens('text')} AS t").collect()
    gates = dict(D._GATES)
    try:
        D._GATES.update(dict.fromkeys(gates, "(?s).*"))
        without = rows.selectExpr("id", f"{D.date_tokens('text')} AS t").collect()
    finally:
        D._GATES.update(gates)
    assert sorted(with_gates) == sorted(without)


def test_columns_right_of_any_number_of_buckets(spark):
    rows = [("d", 0, f"w{x}{y}", float(x), float(y * 20), x + 20.0, y * 20 + 10.0, None, "PdfTextLayer") for x in (0, 60_000, 60_400) for y in range(6)]
    runs = spark.createDataFrame(rows, "doc_id string, page int, text string, l double, t double, r double, b double, conf double, origin string")
    units = G.page_units(runs)
    spans = G.column_spans(written(G.cluster_lines(runs, units), "lines"), units).orderBy("col").collect()
    assert [s.left_x for s in spans] == [0.0, 60_000.0, 60_400.0]


def test_repeats_beyond_two_thousand_and_only_inside_the_window(spark):
    events = spark.createDataFrame([("e", 3_000_000_000, [20_000], 5)], "entry_id string, event_ms long, offsets array<int>, repeat_min int")
    every = [r.due_ms for r in L.ladder_rungs(events, ["entry_id"]).collect()]
    assert len(every) == 4000 and max(every) < 3_000_000_000
    inside = L.ladder_rungs(events, ["entry_id"], 2_900_000_000, 2_950_000_000).collect()
    assert sorted(r.due_ms for r in inside) == sorted(x for x in every if 2_900_000_000 <= x < 2_950_000_000)


def test_delimiter_settled_by_line_twenty_one(spark):
    lines = [(1, i, "a,b;c") for i in range(20)] + [(1, 20, "a;b")]
    found = N.infer_delimiters(spark.createDataFrame(lines, "file_id int, line_no int, text string")).first()
    assert (found.lines, found.delimiter) == (21, ";")


def test_blank_lines_have_no_row_number(spark):
    lines = [(1, 0, "a,b"), (1, 1, ""), (1, 2, "c,\"d"), (1, 3, ""), (1, 4, "e\""), (1, 5, "")]
    df = spark.createDataFrame(lines, "file_id int, line_no long, text string")
    kinds = spark.createDataFrame([(1, ",")], "file_id int, delimiter string")
    got = sorted((r.row_no, r.col, r.text) for r in N.delimited_cells(df, kinds).collect())
    assert got == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d\n\ne")]


def test_nul_far_into_a_file_and_files_of_any_size(spark):
    files = spark.createDataFrame([("a", bytearray(b"x" * 5000 + b"\0")), ("b", bytearray(b"x" * 5000))], "path string, content binary")
    assert {r.path: r.encoding for r in N.decode_text(files).collect()} == {"a": "refused", "b": "utf-8"}
    sizes = spark.createDataFrame([("Csv", True, 30 << 20), ("Pdf", True, 500 << 20)], "format string, present boolean, size_bytes long")
    assert [r.refusal for r in N.intake_gate(sizes).collect()] == [None, None]
    assert [r.refusal for r in N.intake_gate(sizes, {"Csv": 20}, 100).collect()] == ["TooLarge", "TooLarge"]


def test_header_below_row_fifty(spark):
    cells = [("d", "s", 60, c, t) for c, t in enumerate(("Time", "Monday", "Tuesday"))] + [("d", "s", 61, 0, "9:00"), ("d", "s", 61, 1, "Maths")]
    df = spark.createDataFrame(cells, "doc_id string, sheet string, row_no int, col int, text string")
    rows = S.row_features(S.cell_features(df))
    assert S.sheet_shapes(rows).first().shape == "HeaderList"


def test_cue_over_two_lines_and_punctuation_is_no_header(spark):
    lines = spark.createDataFrame([("d", 0, "please visit"), ("d", 1, "us soon"), ("e", 0, "visit"), ("e", 1, "it")], "doc_id string, line_no int, text string")
    assert {r.doc_id: r.kind for r in K.document_kind(lines, ["doc_id"]).collect()} == {"d": "Appointment", "e": "Unknown"}
    heads = spark.createDataFrame([("Date Time",), ("Date - Time",), ("Date: Time",)], "text string")
    assert [r[0] for r in heads.select(K.is_column_header(F.col("text"))).collect()] == [True, False, True]


def test_open_time_of_a_line_is_not_replaced(spark):
    lines = [("d", 0, "Reporting time: 8:00 AM"), ("d", 1, "Viva voce on 18/09/2026 at 9:30"), ("e", 0, "Reporting time: 8:00 AM"), ("e", 1, "Viva voce on 18/09/2026")]
    got = S.prose_events(spark.createDataFrame(lines, "doc_id string, line_no int, text string")).collect()
    assert {r.doc_id: (r.start_min, r.start_level) for r in got} == {"d": (None, "Missing"), "e": (480, "Medium")}


def test_low_values_count_as_none_when_copies_collapse(spark):
    entry = ["d", "s", "x", 0, 0, "Maths", 1, 540, 600, None, None]
    levels = ["High", "Medium", "Medium", "Medium", "Missing", "Missing"]
    low = [*levels[:3], "Low", *levels[4:]]
    schema = "doc_id string, sheet string, entry_id string, row_no int, col int, title string, weekday int, start_min int, end_min int, location string, instructor string, " + ", ".join(f"{f}_level string" for f in S.VALUES)
    rows = [tuple(entry + levels), tuple([*entry[:3], 1, *entry[4:], *low]), tuple([*entry[:3], 2, *entry[4:8], 660, *entry[9:], *low])]
    got = S.dedupe(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.row_no, r.end_min) for r in got) == [(0, 600), (1, 600)]


@pytest.fixture
def skewed(spark):
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_document_is_split_when_its_dates_are_resolved(spark, skewed):
    rows = spark.range(60_000).selectExpr(
        "IF(id % 5 < 4, 0, id) AS doc_id", "id AS line_no", "concat('on ', id % 28 + 1, '/0', id % 9 + 1, '/2026') AS text"
    )
    dates = written(R.locate_dates(rows.repartition(6), ["doc_id", "line_no"]), "dates")
    out = R.resolve_dates(dates, ["doc_id"], ["line_no"], F.floor(F.col("line_no") / 4096))
    assert out.where("doc_id = 0 AND resolved IS NULL").count() == 0
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan()
    out.collect()
    assert "skew" in plan.toString().lower()


def test_audit_finds_nothing_in_what_the_gate_lets_through(spark):
    from schedlake.operators.quality import invariant_audit
    from schedlake.plans import review
    from schedlake.sources.rendered import rendered

    sf = "/root/testdata/sf0.001"
    found = invariant_audit(rendered(spark, sf, "entries"), review.candidates(spark, sf)).collect()
    assert len(found) == 6 and all(r.n == 0 for r in found)
