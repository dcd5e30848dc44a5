"""Provenance and corpus quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import candidates as A
from schedlake.operators import quality as Q
from schedlake.plans import review, tables
from schedlake.plans.registry import query
from schedlake.session import written
from schedlake.sources.rendered import duck, rendered


def sources(spark, sf_dir):
    origin = "named_struct('kind', 'PdfSpan', 'page', CAST(p AS INT), 'l', l, 't', t, 'r', r, 'b', b)"
    return rendered(spark, sf_dir, "sources").withColumn(
        "origins", F.expr(f"transform(split(from_pages, ','), p -> {origin})")
    )


PLACES = f"""src AS ({duck('sources')}), pl AS (
      SELECT entry_id, pos, 0 AS part, kind, page, l, t, r, b FROM src WHERE kind NOT IN ('Derived', 'UserProvided', 'Assumed')
      UNION ALL SELECT entry_id, pos, i, 'PdfSpan', CAST(split_part(from_pages, ',', i + 1) AS INT), l, t, r, b FROM (SELECT *, unnest([0, 1]) AS i FROM src WHERE kind = 'Derived'))"""


@query("placeable_sources", f"WITH {PLACES} SELECT entry_id, pos, part, kind, page, l, t, r, b FROM pl")
def placeable_sources(spark, sf_dir):
    return Q.placeable(sources(spark, sf_dir))


@query(
    "busiest_page",
    f"""WITH {PLACES}, g AS (SELECT entry_id, page, count(*) AS n, min(pos * 2 + part) AS seen, min(l) FILTER (r > l OR b > t) AS l, min(t) FILTER (r > l OR b > t) AS t,
        max(r) FILTER (r > l OR b > t) AS r, max(b) FILTER (r > l OR b > t) AS b FROM pl WHERE kind IN ('PdfSpan', 'ImageRegion') GROUP BY ALL)
    SELECT entry_id, page, n, l, t, r, b FROM g QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY n DESC, seen) = 1""",
)
def busiest_page(spark, sf_dir):
    return Q.busiest_page(Q.placeable(sources(spark, sf_dir)))


# Every event names the cell it falls into.
FOCUS = "SELECT DISTINCT user_id AS doc_id, 'Week' AS sheet, CAST(hour(ts) % 11 AS INT) AS row_no, CAST(day(ts) % 7 AS INT) AS col FROM {events}"


@query(
    "cell_context",
    f"""WITH c AS MATERIALIZED ({duck('sheet_cells')}), f AS MATERIALIZED ({FOCUS.format(events='events')}),
    w AS (SELECT doc_id, sheet, row_no AS focus_row, col AS focus_col, row_no + dr AS row_no, col + dc AS col FROM f, generate_series(-3, 3) a(dr), generate_series(-3, 3) b(dc))
    SELECT doc_id, focus_row, focus_col, CAST(row_no AS INT) AS row_no, CAST(col AS INT) AS col, text FROM w JOIN c USING (doc_id, sheet, row_no, col)""",
)
def cell_context(spark, sf_dir):
    focus = spark.sql(FOCUS.format(events=f"parquet.`{sf_dir}/events.parquet`"))
    return Q.cell_context(focus, rendered(spark, sf_dir, "sheet_cells")).drop("sheet")


@query(
    "corrections",
    f"""SELECT entry_id, field, at_ms, pos, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY at_ms DESC, pos) AS INT) AS rank FROM ({duck('sources')}) s WHERE kind = 'UserProvided'""",
)
def corrections(spark, sf_dir):
    return Q.corrections(sources(spark, sf_dir))


# Every rule is broken in some rows, so that the audit has something to count: what is changed, by entry number.
KEY_NO = "CAST(substr(entry_id, 2) AS BIGINT) % 10"
BROKEN = {
    "status": f"CASE WHEN {KEY_NO} = 1 THEN 'Ready' ELSE status END",
    "end_date": f"CASE WHEN {KEY_NO} = 2 THEN start_date ELSE end_date END",
    "end_min": f"CASE WHEN {KEY_NO} = 2 THEN start_min ELSE end_min END",
    "until": f"CASE WHEN {KEY_NO} = 3 THEN NULL ELSE until END",
}
BROKEN_LEVEL = f"CASE WHEN {KEY_NO} = 5 THEN 'Missing' ELSE title_level END"
MISSING = " OR ".join(
    f"(({level} = 'Missing') <> ({column} IS NULL))"
    for level, column in ((BROKEN_LEVEL, "title"), ("date_level", "date"), ("weekday_level", "weekday"), ("start_level", "start_min"), ("end_level", "end_min"), ("location_level", "location"))
)


@query(
    "invariant_audit",
    f"""WITH {review.GATE}, b AS (SELECT all_day, start_date, start_min, by_weekday, weak, CASE WHEN {KEY_NO} <> 4 THEN rule END AS rule, {', '.join(f'{e} AS {c}' for c, e in BROKEN.items())} FROM cand)
    SELECT 'missing-has-no-value' AS rule, count(*) FILTER ({MISSING}) AS n FROM ({duck('entries')}) e
    UNION ALL SELECT 'assumed-needs-attention', count(*) FILTER (rule IS NOT NULL AND status <> 'NeedsAttention') FROM b
    UNION ALL SELECT 'end-after-start', count(*) FILTER (NOT all_day AND date_diff('day', start_date, end_date) * 1440 + end_min <= start_min) FROM b
    UNION ALL SELECT 'recurrence-is-bounded', count(*) FILTER (by_weekday IS NOT NULL AND until IS NULL) FROM b
    UNION ALL SELECT 'all-day-is-assumed', count(*) FILTER (all_day AND rule IS DISTINCT FROM 'all-day-from-date-only') FROM b
    UNION ALL SELECT 'weak-is-not-ready', count(*) FILTER (weak AND status = 'Ready') FROM b""",
)
def invariant_audit(spark, sf_dir):
    entries = rendered(spark, sf_dir, "entries").withColumn("title_level", F.expr(BROKEN_LEVEL))
    rows = review.candidates(spark, sf_dir).withColumns({c: F.expr(e) for c, e in BROKEN.items()})
    rows = rows.withColumn("assumptions", F.expr(f"IF({KEY_NO} = 4, array(), assumptions)"))
    return Q.invariant_audit(entries, rows)


@query(
    "answerability",
    f"""WITH RECURSIVE {tables.ANSWERED}, ag AS (SELECT *, answer || '/' || doc_id || '/' || entry_id AS eid, answer AS group_id, NULL::INT AS weekday, 'Missing' AS weekday_level FROM ae),
    {review.gate_sql('SELECT * EXCLUDE (entry_id), eid AS entry_id FROM ag', duck('terms'))},
    per AS (SELECT doc_id, group_id AS answer, count(*) AS candidates, min(start_date) AS lo, max(start_date) AS hi FROM cand GROUP BY ALL)
    SELECT aq.doc_id, concat_ws('+', CASE WHEN asks_order THEN 'Order' END, CASE WHEN asks_year THEN 'Year' END) AS asks, answer, candidates, CAST(lo AS VARCHAR) AS first_start, CAST(hi AS VARCHAR) AS last_start
    FROM aq LEFT JOIN per USING (doc_id) WHERE (asks_order OR asks_year) AND aq.doc_id NOT IN (SELECT doc_id FROM per WHERE answer = 'any/any')""",
)
def answerability(spark, sf_dir):
    """Documents that ask for a date order or a year and give nothing until they are told: what each answer leads to."""
    entries, asks = tables.answered(spark, sf_dir)
    entries = entries.withColumns({"entry_id": F.expr("concat(answer, '/', doc_id, '/', entry_id)"), "group_id": F.col("answer")})
    gated = written(A.gate(entries, rendered(spark, sf_dir, "terms")), "answered-gate")
    return Q.answerability(gated, asks).selectExpr(
        "doc_id", "asks", "answer", "candidates", "CAST(first_start AS STRING) AS first_start", "CAST(last_start AS STRING) AS last_start"
    )
