"""Texts that repeat are read once, whatever the number of cells."""

import pytest

from schedlake.functions import once
from schedlake.operators import schedules as S
from schedlake.operators import tokens as K


@pytest.fixture
def read(monkeypatch):
    """How many different texts each step has read."""
    counts, write = {}, once.written

    def counted(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(once, "written", counted)
    return counts


def test_column_roles_read_a_text_once(spark, read):
    cells = spark.range(200).selectExpr("1L AS doc_id", "'s' AS sheet", "id AS row_no", "CAST(id % 2 AS INT) AS col", "IF(id % 2 = 0, ' 12/03/2026 ', 'Room 4') AS text")
    roles = K.column_roles(cells, ["doc_id", "sheet", "col"]).select("col", "n", "role").collect()
    assert sorted(map(tuple, roles)) == [(0, 100, "Date"), (1, 100, "Location")]
    assert read == {"role-texts": 2}


def test_dated_tables_read_a_time_once(spark, read):
    head = spark.createDataFrame([(1, "s", 0, 0, "Event"), (1, "s", 0, 1, "Date"), (1, "s", 0, 2, "Time")], "doc_id long, sheet string, row_no long, col int, text string")
    body = spark.range(1, 101).selectExpr("1L AS doc_id", "'s' AS sheet", "id AS row_no", "posexplode(array('Review', '2026-03-12', '14:35')) AS (col, text)")
    cells = head.unionByName(body)
    rows = S.dated_table(cells, S.dated_layout(cells)).select("title", "start_min").distinct().collect()
    assert [tuple(r) for r in rows] == [("Review", 875)]
    assert read == {"cell-date-texts": 1, "cell-time-texts": 1}


def test_subjects_are_split_once(spark, read):
    cells = spark.range(50).selectExpr(
        "1L AS doc_id", "'s' AS sheet", "id AS row_no", "1 AS col", "'Physics / K12' AS text", "1 AS weekday", "540 AS start_min", "600 AS end_min"
    )
    found = S._entries(cells, "row_no").select("title", "location").collect()
    assert [tuple(r) for r in found] == [("Physics", "K12")] * 50
    assert read == {"subject-texts": 1}


def test_cues_are_searched_once_and_over_a_line_break(spark, read):
    rows = [(1, i, "Bring the form") for i in range(20)] + [(2, 0, "Pay before the LAST"), (2, 1, "Day of May"), (3, 0, "Reporting"), (3, 1, "atlas of gates")]
    rows += [(4, 0, "last"), (4, 1, None), (4, 2, "day"), (5, 0, "the last"), (5, 1, "holiday")]
    kinds = K.document_kind(spark.createDataFrame(rows, "doc_id long, line_no long, text string"), ["doc_id"])
    assert sorted(map(tuple, kinds.collect())) == [(1, "Unknown"), (2, "Deadline"), (3, "Travel"), (4, "Unknown"), (5, "Unknown")]
    assert read == {"cue-texts": 10}
