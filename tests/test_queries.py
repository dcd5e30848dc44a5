"""Registered queries against their checking SQL on the smallest tables.

SCHEDLAKE_ALL=1 runs every query; by default one of each family keeps this short.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from schedlake.plans.registry import CHECKS, QUERIES, compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
SHORT = (
    "format_sniff", "decode_text", "delimiter_inference", "snapshot_write", "page_crop", "page_unit", "cell_text",
    "date_matches", "time_matches", "title_trim", "date_resolution", "meridiem_monotonic", "orientation", "dated_table",
    "candidate_gate", "assumption_questions", "apply_edits", "occurrences", "reminder_plan", "calendar_duplicates",
    "slot_merge", "slot_changes", "busiest_page", "invariant_audit", "corpus_summary", "stream_history",
    "csv_cells", "document_kind", "document_candidates", "undo_import", "stream_dedupe",
    "section_schedules", "date_questions", "sink_timetables", "cell_context", "merged_periods", "field_table",
)
entry.queries()
REGISTERED = sorted(QUERIES)
NAMES = REGISTERED if os.environ.get("SCHEDLAKE_ALL") else SHORT


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_check(spark, duck, name):
    got, want = compare(spark, duck, name, SF)
    assert got == want


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
