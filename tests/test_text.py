"""Small literal cases for the text rules."""

from pyspark.sql import functions as F

from schedlake.functions import times as T
from schedlake.operators import tokens as K
from schedlake.sources import intake as N


def dates_of(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = K.date_tokens(rows, ["id"]).orderBy("id", "start").collect()
    return [[r for r in found if r.id == i] for i in range(len(texts))]


def test_date_forms(spark):
    iso, dmy, both, same, name, month_first, weekday, none = dates_of(
        spark, "2026-09-18", "18/09/2026", "03/04/2026", "03/03/2026", "18th Sept 2026", "Sep 18, 26", "every Thurs", "no date"
    )
    assert (iso[0].day1, iso[0].month1, iso[0].year) == (18, 9, 2026)
    assert dmy[0].n_readings == 1 and dmy[0].proven_order == "DayFirst"
    assert both[0].n_readings == 2 and (both[0].day1, both[0].month1) == (3, 4)
    assert same[0].n_readings == 1 and same[0].proven_order is None
    assert (name[0].day1, name[0].month1, name[0].year) == (18, 9, 2026)
    assert (month_first[0].day1, month_first[0].month1, month_first[0].year) == (18, 9, 2026)
    assert weekday[0].weekday == 4 and weekday[0].n_readings == 0
    assert none == []


def test_impossible_dates_are_never_coerced(spark):
    feb30, month13, leap, yearless = dates_of(spark, "30/02/2026", "2026-13-05", "29/02/2027", "29/02")
    assert feb30[0].invalid_reason == "February doesn't have 30 days"
    assert month13[0].invalid_reason == "there is no month 13"
    assert leap[0].invalid_reason == "February 29 isn't a real date in 2027"
    assert yearless[0].n_readings == 1 and yearless[0].invalid_reason is None


def test_longer_match_wins_an_overlap(spark):
    (found,) = dates_of(spark, "2026-09-18 and 18.09")
    assert [f.raw for f in found] == ["2026-09-18", "18.09"]
    assert found[1].start == 15


def times_of(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = K.time_tokens(rows, ["id"]).orderBy("id", "start").collect()
    return [[r for r in found if r.id == i] for i in range(len(texts))]


def test_time_forms(spark):
    rng, marked, glued, bare, single = times_of(spark, "9-10 AM", "10.30 pm", "18.09.2026", "Room 14", "14:30")
    assert rng[0].is_range and rng[0].start_mer == "Am" and rng[0].end_hour == 10
    assert marked[0].start_hour == 10 and marked[0].start_minute == 30 and marked[0].start_mer == "Pm"
    assert glued == [] and bare == []
    assert single[0].start_hour == 14 and not single[0].is_range


def test_noon_and_midnight(spark):
    row = spark.range(1).selectExpr(
        f"{T.as_written('12', '0', repr('Am'))} AS midnight", f"{T.as_written('12', '0', repr('Pm'))} AS noon",
        f"{T.as_written('9', '0', repr('Unstated'))} AS open",
    ).first()
    assert (row.midnight, row.noon, row.open) == (0, 720, None)


def test_subject_split(spark):
    rows = spark.createDataFrame(
        [("DSA / K10",), ("Maths (Dr. Rao) Room 204",), ("K10",), ("Physics, Lab 2, Prof. Iyer",)], "text string"
    )
    got = [(r.subject, r.location, r.instructor) for r in K.subject_parts(rows).collect()]
    assert got == [("DSA", "K10", None), ("Maths", "Room 204", "Dr. Rao"), (None, None, None), ("Physics", "Lab 2", "Prof. Iyer")]


def test_titles(spark):
    texts = ["Last date for payment is on the", "The notice", "28,000 payable", "Viva"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        K.trim_title(F.col("t")).alias("trimmed"), K.names_something(F.col("t")).alias("names")
    ).collect()
    assert rows[0].trimmed == "Last date for payment"
    assert [r.names for r in rows] == [True, False, False, True]


def test_cell_references(spark):
    rows = spark.createDataFrame([("C25",), ("AA1",), ("25",), ("ABC",)], "ref string")
    got = [(r.row_no, r.col) for r in rows.withColumns(K.cell_reference(F.col("ref"))).collect()]
    assert got[:2] == [(24, 2), (0, 26)] and got[2] == (None, None) and got[3] == (None, None)
    assert [r[0] for r in spark.createDataFrame([(0,), (25,), (26,), (702,)], "i int").select(K.column_letters(F.col("i"))).collect()] == [
        "A", "Z", "AA", "AAA",
    ]


def test_files_of_spaces_alone_are_no_text(spark):
    files = {"nbsp": " ", "wide": "　  ", "word": " a ", "lines": "a,b\n \nc,d\n　\ne,f\ng,h\n"}
    rows = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in files.items()], "path string, content binary")
    assert {r.path: r.format for r in N.sniff_format(rows).collect()} == {"nbsp": "Unsupported", "wide": "Unsupported", "word": "PlainText", "lines": "Csv"}
