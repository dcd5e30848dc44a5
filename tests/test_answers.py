"""Answers as a key: every combination settled in one pass, questions raised once."""

import pytest

from schedlake.operators import quality as Q
from schedlake.operators import candidates as A
from schedlake.operators import resolve as R
from schedlake.operators import schedules as S

CELLS = "doc_id string, sheet string, row_no long, col int, text string"


def sheet(doc, *rows):
    return [(doc, "s", r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row) if t]


HEAD = ("Event", "Date", "Time")
TABLES = [
    *sheet("plain", HEAD, ("Sprint demo", "25/03/2026", "14:00")),
    *sheet("order", HEAD, ("Sprint demo", "05/10/2026", "14:00"), ("Board review", "06/10/2026", "")),
    *sheet("year", HEAD, ("Sprint demo", "25 March", "14:00")),
    *sheet("leap", HEAD, ("Sprint demo", "29 February", "14:00")),
    *sheet("both", HEAD, ("Sprint demo", "05/10", "14:00")),
    *sheet("bill", ("Power bill",), ("Ref", "Billdate", "Due date"), ("R-1", "05/10/2026", "06/10/202614:35")),
    *sheet("nothing", HEAD, ("", "05/10/2026", "")),
]
LINES = [("letter", 0, "Viva voce"), ("letter", 1, "Held on 04/05/2026 at 14:00"), ("proved", 0, "Viva on 25/03/2026"), ("proved", 1, "Talk on 04/05/2026"), ("bare", 0, "Viva voce on 25 March at 9:30 AM")]


@pytest.fixture(scope="module")
def answered(spark):
    cells = spark.createDataFrame(TABLES, CELLS)
    lines = spark.createDataFrame(LINES, "doc_id string, line_no int, text string")
    entries, asks = S.answered_readings(cells, S.dated_layout(cells), lines, [2027, 2028])
    entries = entries.selectExpr("*", "answer AS group_id").drop("group")
    terms = spark.createDataFrame([], "doc_id string, term_start date, term_end date")
    rows = Q.answerability(A.gate(entries, terms), asks).collect()
    return entries.collect(), {r.doc_id: (r.asks_order, r.asks_year) for r in asks.collect()}, rows


def test_every_combination(answered):
    entries, asks, _ = answered
    got = {}
    for r in entries:
        got.setdefault((r.doc_id, r.answer), set()).add((r.title, str(r.date), r.start_min))
    assert asks == {
        "plain": (False, False), "order": (True, False), "year": (False, True), "leap": (False, True), "both": (True, True), "bill": (True, False),
        "nothing": (True, False), "letter": (True, False), "proved": (False, False), "bare": (False, True),
    }
    assert got["plain", "any/any"] == {("Sprint demo", "2026-03-25", 840)} and ("plain", "DayFirst/any") not in got
    assert got["order", "DayFirst/any"] == {("Sprint demo", "2026-10-05", 840), ("Board review", "2026-10-06", None)}
    assert got["order", "MonthFirst/any"] == {("Sprint demo", "2026-05-10", 840), ("Board review", "2026-06-10", None)}
    assert got["year", "any/2027"] == {("Sprint demo", "2027-03-25", 840)} and ("leap", "any/2027") not in got
    assert got["leap", "any/2028"] == {("Sprint demo", "2028-02-29", 840)}
    assert got["both", "MonthFirst/2028"] == {("Sprint demo", "2028-05-10", 840)} and ("both", "MonthFirst/any") not in got
    assert got["bill", "DayFirst/any"] == {("Power bill · Bill date", "2026-10-05", None), ("Power bill · Due date", "2026-10-06", 875)}
    assert got["letter", "MonthFirst/any"] == {("Viva voce", "2026-04-05", 840)} or got["letter", "MonthFirst/any"] == {("Held", "2026-04-05", 840)}
    assert {d for _, d, _ in got["proved", "any/any"]} == {"2026-03-25", "2026-05-04"}
    assert got["bare", "any/2027"] == {("Viva voce", "2027-03-25", 570)}


def test_answers_that_lead_somewhere(answered):
    rows = {(r.doc_id, r.answer): (r.asks, r.candidates, str(r.first_start)) for r in answered[2]}
    assert rows["nothing", None] == ("Order", None, "None")  # an answer leads nowhere here
    assert {d for d, _ in rows} == {"order", "year", "leap", "both", "bill", "nothing", "letter", "bare"}
    assert rows["order", "DayFirst/any"] == ("Order", 2, "2026-10-05") and rows["order", "MonthFirst/any"] == ("Order", 2, "2026-05-10")
    assert rows["both", "DayFirst/2027"] == ("Order+Year", 1, "2027-10-05")


def test_questions_come_once(spark):
    lines = [("d", 0, "on 04/05/2026 and 04/05/2026"), ("d", 1, "on 14 March"), ("e", 0, "on 04/05/2026"), ("e", 1, "25/05/2026")]
    dates = R.locate_dates(spark.createDataFrame(lines, "doc_id string, line_no int, text string"), ["doc_id", "line_no"])
    got = R.date_questions(R.resolve_dates(dates, ["doc_id"], ["line_no", "start"]), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.asks, r.raw, str(r.day_first), str(r.month_first)) for r in got) == [
        ("d", "Order", "04/05/2026", "2026-05-04", "2026-04-05"), ("d", "Year", "14 March", "None", "None"),
    ]
