"""Candidate, assumption and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import candidates as A
from schedlake.plans.registry import query
from schedlake.sources.rendered import duck, rendered


def gated(spark, sf_dir):
    return A.gate(rendered(spark, sf_dir, "entries"), rendered(spark, sf_dir, "terms"))


def candidates(spark, sf_dir):
    return A.accepted(gated(spark, sf_dir))


OK = lambda f: f"{f}_level IN ('High', 'Medium')"


def gate_sql(entries: str, terms: str) -> str:
    """CTEs ``gate`` (field set: a question) and ``cand`` over entries and terms (SQL)."""
    return f"""base AS (SELECT e.*, t.term_start, t.term_end, {OK('weekday')} AS rec,
      CASE WHEN {OK('weekday')} THEN term_start + CAST((weekday - isodow(term_start) + 7) % 7 AS INT) WHEN {OK('date')} THEN date END AS fd,
      CASE WHEN {OK('start')} THEN start_min END AS s, CASE WHEN {OK('end')} THEN end_min WHEN end_level = 'Missing' AND {OK('start')} THEN (start_min + 60) % 1440 END AS en
    FROM ({entries}) e LEFT JOIN ({terms}) t USING (doc_id)),
    gate AS (SELECT *, CASE WHEN title_level IN ('Low', 'Missing') THEN 'Title' WHEN rec AND (term_end IS NULL OR fd > term_end) THEN 'Recurrence'
        WHEN NOT rec AND fd IS NULL THEN 'Date' WHEN s IS NULL AND (rec OR start_level = 'Low') THEN 'StartTime'
        WHEN s IS NOT NULL AND (en IS NULL OR s = en) THEN 'EndTime' END AS field FROM base),
    cand AS (SELECT entry_id, doc_id, group_id, kind, title, s IS NULL AS all_day, fd AS start_date, s AS start_min,
        CASE WHEN s IS NULL OR en < s THEN fd + 1 ELSE fd END AS end_date, CASE WHEN s IS NOT NULL THEN en END AS end_min,
        CASE WHEN {OK('location')} THEN location END AS location, CASE WHEN rec THEN weekday END AS by_weekday, CASE WHEN rec THEN term_end END AS until,
        CASE WHEN s IS NULL THEN 'all-day-from-date-only' WHEN end_level = 'Missing' THEN 'assumed-duration' END AS rule,
        start_level = 'Low' OR end_level = 'Low' OR location_level = 'Low' AS weak,
        CASE WHEN start_level = 'Low' OR end_level = 'Low' OR location_level = 'Low' OR s IS NULL OR end_level = 'Missing' THEN 'NeedsAttention' ELSE 'Ready' END AS status
      FROM gate WHERE field IS NULL)"""


GATE = gate_sql(duck("entries"), duck("terms"))


@query(
    "candidate_gate",
    f"""WITH {GATE} SELECT entry_id, field, CASE field WHEN 'Title' THEN 'What is this called?'
          WHEN 'Recurrence' THEN CASE WHEN term_end IS NULL THEN 'When does this schedule end? Weekly classes need an end date.' ELSE 'This class doesn''t occur before the term ends.' END
          WHEN 'Date' THEN 'What date is this on?' WHEN 'StartTime' THEN 'When does this start?'
          WHEN 'EndTime' THEN CASE WHEN en IS NULL THEN 'When does this end?' ELSE 'This starts and ends at the same time.' END END AS question FROM gate""",
)
def candidate_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("entry_id", "field", "question")


@query(
    "assumption_fill",
    f"WITH {GATE} SELECT entry_id, all_day, CAST(start_date AS VARCHAR) AS start_date, start_min, end_min, coalesce(rule, '') AS assumed, status FROM cand",
)
def assumption_fill(spark, sf_dir):
    return candidates(spark, sf_dir).selectExpr(
        "entry_id", "all_day", "CAST(start_date AS STRING) AS start_date", "start_min", "end_min",
        "array_join(assumptions, ',') AS assumed", "status",
    )


@query(
    "assumption_strict",
    f"""WITH {GATE} SELECT coalesce(CASE WHEN field IS NOT NULL THEN field WHEN s IS NULL THEN 'StartTime' WHEN end_level = 'Missing' THEN 'EndTime' END, 'accepted') AS outcome, count(*) AS n FROM gate GROUP BY 1""",
)
def assumption_strict(spark, sf_dir):
    """The strict policy assumes nothing: no all-day items, no lengths."""
    strict = A.gate(rendered(spark, sf_dir, "entries"), rendered(spark, sf_dir, "terms"), None, False)
    return strict.groupBy(F.coalesce("field", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "first_occurrence",
    f"""SELECT entry_id, CAST(term_start + CAST((weekday - isodow(term_start) + 7) % 7 AS INT) AS VARCHAR) AS first_date
        FROM ({duck('entries')}) e JOIN ({duck('terms')}) t USING (doc_id) WHERE weekday IS NOT NULL""",
)
def first_occurrence(spark, sf_dir):
    rows = rendered(spark, sf_dir, "entries").where("weekday IS NOT NULL").join(rendered(spark, sf_dir, "terms"), "doc_id")
    return rows.selectExpr(
        "entry_id", f"CAST({A.first_occurrence('weekday', 'term_start')} AS STRING) AS first_date"
    )


@query(
    "midnight_cross",
    f"""WITH {GATE} SELECT entry_id, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date,
        CAST(date_diff('day', start_date, end_date) * 1440 + end_min - start_min AS INT) AS minutes FROM cand WHERE NOT all_day""",
)
def midnight_cross(spark, sf_dir):
    return candidates(spark, sf_dir).where("NOT all_day").selectExpr(
        "entry_id", "CAST(start_date AS STRING) AS start_date", "CAST(end_date AS STRING) AS end_date",
        "datediff(end_date, start_date) * 1440 + end_min - start_min AS minutes",
    )


TODAY = "2026-08-10"


@query(
    "needs_term",
    f"""WITH {GATE}, t AS (SELECT group_id, count(*) AS unresolved, bool_or(field = 'Recurrence' AND term_end IS NULL) AS needs_term
        FROM gate WHERE field IS NOT NULL GROUP BY group_id)
    SELECT *, CASE WHEN needs_term THEN '{TODAY}' END AS offered_start, CASE WHEN needs_term THEN CAST(CAST('{TODAY}' AS DATE) + 105 AS VARCHAR) END AS offered_end FROM t""",
)
def needs_term(spark, sf_dir):
    return A.term_questions(gated(spark, sf_dir), TODAY).withColumns(
        {c: F.col(c).cast("string") for c in ("offered_start", "offered_end")}
    )


@query(
    "assumption_questions",
    f"""WITH {GATE}, t AS (SELECT rule, title, count(*) AS n, min(CAST(substr(entry_id, 2) AS BIGINT)) AS f FROM cand WHERE rule IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY f) AS k FROM t)
        SELECT rule, CASE rule WHEN 'all-day-from-date-only' THEN 'StartTime' ELSE 'EndTime' END AS field, CAST(sum(n) AS BIGINT) AS affected,
          string_agg(title, '|' ORDER BY k) FILTER (k <= 3) AS examples FROM r GROUP BY rule""",
)
def assumption_questions(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("pos", F.expr("CAST(substring(entry_id, 2) AS BIGINT)"))
    return A.assumption_questions(rows, "pos")


ANSWERS = """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'all-day-from-date-only' ELSE 'assumed-duration' END AS rule,
    CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'Individually' WHEN 1 THEN 'Accept' WHEN 2 THEN 'UseTime' ELSE 'Accept' END AS answer,
    600 AS use_start, 60 + CAST(c_custkey % 3 AS INT) * 500 AS use_minutes FROM {customer}"""
ANSWERED = f"""{GATE}, ans AS (SELECT c.*, coalesce(answer = 'Accept', false) AS takes, coalesce(answer = 'UseTime' AND all_day, false) AS timed, use_minutes
      FROM cand c LEFT JOIN ({ANSWERS.format(customer='customer')}) a ON a.doc_id = c.doc_id AND a.rule = c.rule),
    done AS (SELECT entry_id, doc_id, title, weak, all_day AND NOT timed AS all_day, CASE WHEN timed THEN 600 ELSE start_min END AS start_min,
       CASE WHEN timed THEN (600 + use_minutes) % 1440 ELSE end_min END AS end_min,
       CASE WHEN timed THEN start_date + CAST((600 + use_minutes) // 1440 AS INT) ELSE end_date END AS end_date,
       CASE WHEN takes OR timed THEN NULL ELSE rule END AS rule,
       CASE WHEN takes THEN 'assumption:' || rule WHEN timed THEN 'startTime,endTime' ELSE '' END AS provided,
       CASE WHEN weak OR (rule IS NOT NULL AND NOT takes AND NOT timed) THEN 'NeedsAttention' ELSE 'Ready' END AS status FROM ans)"""


def answered(spark, sf_dir):
    answers = spark.sql(ANSWERS.format(customer=f"parquet.`{sf_dir}/customer.parquet`"))
    return A.answer_assumptions(candidates(spark, sf_dir), answers)


@query(
    "assumption_answers",
    f"WITH {ANSWERED} SELECT entry_id, all_day, start_min, CAST(end_min AS INT) AS end_min, CAST(end_date AS VARCHAR) AS end_date, coalesce(rule, '') AS assumed, provided, status FROM done",
)
def assumption_answers(spark, sf_dir):
    return answered(spark, sf_dir).selectExpr(
        "entry_id", "all_day", "start_min", "end_min", "CAST(end_date AS STRING) AS end_date",
        "array_join(assumptions, ',') AS assumed", "array_join(provided, ',') AS provided", "status",
    )


EDITED = f"""WITH {GATE}, j0 AS (SELECT c.*, new_title, new_date, new_start, new_end, new_location, coalesce(to_all_day, false) AS to_day,
      (new_title IS NOT NULL OR new_date IS NOT NULL OR new_start IS NOT NULL OR new_location IS NOT NULL OR coalesce(to_all_day, false)) AS asked,
      all_day AND new_start IS NULL OR coalesce(to_all_day, false) AS day_form, date_diff('day', start_date, end_date) AS span,
      new_location IS NOT NULL AND new_location IS DISTINCT FROM location AS moved
      FROM cand c LEFT JOIN ({duck('edits')}) e USING (entry_id)),
    j AS (SELECT *, trim(coalesce(new_title, title)) AS t2, coalesce(new_date, start_date) AS d2, CASE WHEN NOT day_form THEN coalesce(new_start, start_min) END AS s2, CASE WHEN NOT day_form THEN coalesce(new_end, end_min) END AS e2 FROM j0),
    k AS (SELECT *, CASE WHEN day_form THEN d2 + 1 WHEN new_end IS NOT NULL THEN d2 ELSE d2 + CAST(span AS INT) END AS ed2 FROM j),
    l AS (SELECT *, coalesce(asked AND (t2 = '' OR (NOT day_form AND NOT date_diff('day', d2, ed2) * 1440 + e2 > s2)), false) AS refused,
      list_filter([CASE WHEN t2 <> title THEN 'title' END, CASE WHEN day_form AND (NOT all_day OR d2 <> start_date) THEN 'date' END,
        CASE WHEN NOT day_form AND (d2 <> start_date OR s2 IS DISTINCT FROM start_min) THEN 'start' END,
        CASE WHEN NOT day_form AND (ed2 <> end_date OR e2 IS DISTINCT FROM end_min) THEN 'end' END, CASE WHEN moved THEN 'location' END], lambda x: x IS NOT NULL) AS changed FROM k),
    m AS (SELECT *, coalesce(asked, false) AND NOT refused AND len(changed) > 0 AS applied FROM l)
    SELECT entry_id, CASE WHEN applied THEN t2 ELSE title END AS title, CAST(CASE WHEN applied THEN d2 ELSE start_date END AS VARCHAR) AS start_date,
      CASE WHEN applied THEN s2 ELSE start_min END AS start_min, CAST(CASE WHEN applied THEN ed2 ELSE end_date END AS VARCHAR) AS end_date,
      CASE WHEN applied THEN e2 ELSE end_min END AS end_min, CASE WHEN applied THEN day_form ELSE all_day END AS all_day, CASE WHEN applied AND moved THEN nullif(trim(new_location), '') ELSE location END AS location,
      CAST(CASE WHEN applied AND by_weekday IS NOT NULL AND NOT day_form THEN isodow(d2) ELSE by_weekday END AS INT) AS by_weekday,
      CASE WHEN applied AND NOT day_form AND ((rule = 'assumed-duration' AND list_contains(changed, 'end')) OR (rule = 'all-day-from-date-only' AND list_contains(changed, 'start')))
        THEN '' ELSE coalesce(rule, '') END AS assumed, CASE WHEN applied AND NOT day_form THEN 'Ready' ELSE status END AS status,
      CASE WHEN applied THEN array_to_string(changed, ',') ELSE '' END AS changed, refused FROM m"""


@query("apply_edits", EDITED)
def apply_edits(spark, sf_dir):
    out = A.apply_edits(candidates(spark, sf_dir), rendered(spark, sf_dir, "edits"))
    return out.selectExpr(
        "entry_id", "title", "CAST(start_date AS STRING) AS start_date", "start_min", "CAST(end_date AS STRING) AS end_date",
        "end_min", "all_day", "location", "by_weekday", "array_join(assumptions, ',') AS assumed", "status",
        "array_join(changed, ',') AS changed", "refused",
    )


@query(
    "reminder_candidates",
    f"""SELECT entry_id, CASE WHEN NOT {OK('title')} THEN 'Title' WHEN NOT {OK('date')} THEN 'Date' END AS field,
        CASE WHEN {OK('title')} AND {OK('date')} THEN title END AS title, CAST(CASE WHEN {OK('title')} AND {OK('date')} THEN date END AS VARCHAR) AS due_date,
        CASE WHEN {OK('start')} THEN start_min ELSE 540 END AS due_min, NOT {OK('start')} AS all_day,
        CASE WHEN 'Low' IN (title_level, date_level, start_level) THEN 'NeedsAttention' ELSE 'Ready' END AS status FROM ({duck('entries')}) e""",
)
def reminder_candidates(spark, sf_dir):
    out = A.reminder_candidates(rendered(spark, sf_dir, "entries"))
    return out.withColumn("due_date", F.col("due_date").cast("string")).drop("doc_id")


FORMS = """SELECT 'm' || CAST(s_suppkey AS STRING) AS entry_id, s_suppkey AS doc_id, 'manual' AS group_id, 'Event' AS kind,
    CASE WHEN s_suppkey % 6 = 0 THEN '  ' ELSE ' ' || s_name END AS title,
    CASE WHEN s_suppkey % 3 > 0 THEN CAST('2026-09-01' AS DATE) + CAST(s_suppkey % 90 AS INT) END AS date,
    CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 7 + 1 AS INT) END AS weekday,
    CASE WHEN s_suppkey % 3 < 2 THEN CAST(s_suppkey % 20 * 60 AS INT) END AS start_min,
    CASE WHEN s_suppkey % 5 < 3 AND s_suppkey % 3 < 2 THEN CAST(s_suppkey % 18 * 70 AS INT) END AS end_min,
    CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE ' Hall 1' END AS location FROM {supplier}"""


@query(
    "manual_entries",
    f"""WITH f AS (SELECT *, nullif(trim(title), '') AS t, CASE WHEN weekday IS NOT NULL THEN DATE '2026-08-17' + weekday - 1 ELSE date END AS fd FROM ({FORMS.format(supplier='supplier')}) s)
    SELECT entry_id, t AS title, CASE WHEN t IS NULL THEN 'Title' WHEN start_min IS NULL AND weekday IS NOT NULL THEN 'StartTime'
        WHEN start_min IS NOT NULL AND (end_min IS NULL OR end_min = start_min) THEN 'EndTime' END AS field,
      CAST(CASE WHEN t IS NOT NULL AND NOT (start_min IS NOT NULL AND (end_min IS NULL OR end_min = start_min)) THEN fd END AS VARCHAR) AS start_date, nullif(trim(location), '') AS location
    FROM f""",
)
def manual_entries(spark, sf_dir):
    forms = spark.sql(FORMS.format(supplier=f"parquet.`{sf_dir}/supplier.parquet`"))
    entries = A.manual_entries(forms)
    terms = entries.selectExpr("doc_id", "DATE'2026-08-17' AS term_start", "DATE'2026-12-05' AS term_end").distinct()
    out = A.gate(entries, terms, None, True).select("entry_id", "field", F.col("start_date").cast("string").alias("start_date"))
    return out.join(entries.select("entry_id", "title", "location"), "entry_id")


@query(
    "review_summary",
    f"""WITH {GATE} SELECT doc_id, CAST(coalesce(by_weekday, isodow(start_date)) AS INT) AS day, count(*) FILTER (status = 'Ready') AS ready,
        count(*) FILTER (status = 'NeedsAttention') AS attention, count(*) FILTER (status = 'Ready' OR (NOT weak AND coalesce(rule, 'assumed-duration') = 'assumed-duration')) AS ticked
        FROM cand GROUP BY ALL""",
)
def review_summary(spark, sf_dir):
    return A.review_summary(candidates(spark, sf_dir))
