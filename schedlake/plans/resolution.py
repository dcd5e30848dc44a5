"""Queries that settle ambiguous dates and times from evidence in the document."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import resolve as R
from schedlake.operators import tokens as K
from schedlake.plans import checking as C
from schedlake.plans.registry import query
from schedlake.session import written
from schedlake.sources.rendered import duck, rendered

DOC = ["doc_id"]
ORDER = ["line_no", "start"]


def notice_bucket():
    """Line numbers of date-ordered notices carry the day above 10^9; both scales grow with the order."""
    return F.expr("CASE WHEN line_no >= 1000000000000 THEN line_no div 1000000000000 ELSE line_no div 65536 END")


def notice_dates(spark, sf_dir):
    return R.locate_dates(rendered(spark, sf_dir, "notices"), ["doc_id", "line_no"])


DATES = f"""src AS ({duck('notices')}), {C.date_tokens('src', 'doc_id, line_no')},
    wd AS (SELECT doc_id, line_no, min_by(weekday, st) AS stated FROM t_read WHERE family = 4 GROUP BY ALL),
    dates AS (SELECT t.doc_id, t.line_no, st, raw, n_readings, proven_order, stated, {C.as_date('day1', 'month1', 'year')} AS d1, {C.as_date('day2', 'month2', 'year')} AS d2
      FROM t_read t LEFT JOIN wd USING (doc_id, line_no) WHERE family <> 4),
    sib AS (SELECT doc_id, any_value(proven_order) AS o FROM dates WHERE proven_order IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT proven_order) = 1),
    votes AS (SELECT *, CASE WHEN n_readings = 2 AND isodow(d1) = stated AND isodow(d2) <> stated THEN 'DayFirst'
        WHEN n_readings = 2 AND isodow(d2) = stated AND isodow(d1) <> stated THEN 'MonthFirst' END AS vote FROM dates),
    wk AS (SELECT doc_id, any_value(vote) AS o FROM votes WHERE vote IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT vote) = 1),
    seq0 AS (SELECT doc_id, d1, d2, lag(d1) OVER w AS p1, lag(d2) OVER w AS p2 FROM dates WHERE n_readings = 2 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, st)),
    seq1 AS (SELECT doc_id, count(*) AS n, bool_and(p1 IS NULL OR p1 < d1) AS u1, bool_and(p2 IS NULL OR p2 < d2) AS u2, bool_and(d1 IS NOT NULL AND d2 IS NOT NULL) AS whole FROM seq0 GROUP BY doc_id),
    seq AS (SELECT doc_id, CASE WHEN u1 THEN 'DayFirst' ELSE 'MonthFirst' END AS o FROM seq1 WHERE n >= 4 AND whole AND u1 <> u2)"""


@query("date_order_sibling", f"WITH RECURSIVE {DATES} SELECT doc_id, o AS sibling FROM sib")
def date_order_sibling(spark, sf_dir):
    return R.sibling_order(notice_dates(spark, sf_dir), DOC)


@query("date_order_weekday", f"WITH RECURSIVE {DATES} SELECT doc_id, o AS by_weekday FROM wk")
def date_order_weekday(spark, sf_dir):
    return R.weekday_order(notice_dates(spark, sf_dir), DOC)


@query("date_order_sequence", f"WITH RECURSIVE {DATES} SELECT doc_id, o AS by_sequence FROM seq")
def date_order_sequence(spark, sf_dir):
    dates = written(notice_dates(spark, sf_dir).where("n_readings = 2"), "dates")  # the scan reads them twice
    return R.sequence_order(dates, DOC, ORDER, notice_bucket())


RESOLVED = f"""{DATES},
    res AS (SELECT v.*, CASE WHEN (d1 IS NULL) <> (d2 IS NULL) THEN 'Unambiguous' WHEN d1 IS NULL THEN NULL
          WHEN vote IS NOT NULL THEN 'WeekdayAgreement' WHEN sib.o IS NOT NULL THEN 'SiblingDate'
          WHEN wk.o IS NOT NULL THEN 'WeekdayAgreement' WHEN seq.o IS NOT NULL THEN 'SequenceCoherence' END AS evidence,
        CASE WHEN d2 IS NULL THEN d1 WHEN d1 IS NULL THEN d2 WHEN coalesce(vote, sib.o, wk.o, seq.o) = 'DayFirst' THEN d1
             WHEN coalesce(vote, sib.o, wk.o, seq.o) = 'MonthFirst' THEN d2 END AS resolved
      FROM votes v LEFT JOIN sib USING (doc_id) LEFT JOIN wk USING (doc_id) LEFT JOIN seq USING (doc_id))"""


@query(
    "date_resolution",
    f"WITH RECURSIVE {RESOLVED} SELECT doc_id, line_no, raw, evidence, CAST(resolved AS VARCHAR) AS resolved FROM res",
)
def date_resolution(spark, sf_dir):
    dates = written(notice_dates(spark, sf_dir), "dates")
    out = R.resolve_dates(dates, DOC, ORDER, notice_bucket())
    return out.selectExpr("doc_id", "line_no", "raw", "evidence", "CAST(resolved AS STRING) AS resolved")


@query(
    "date_questions",
    f"""WITH RECURSIVE {RESOLVED.replace(duck('notices'), duck('date_lines'))} SELECT DISTINCT doc_id, CASE WHEN d1 IS NULL THEN 'Year' ELSE 'Order' END AS asks, raw,
      CASE WHEN d1 IS NOT NULL THEN CAST(d1 AS VARCHAR) END AS day_first, CASE WHEN d1 IS NOT NULL THEN CAST(d2 AS VARCHAR) END AS month_first
    FROM res WHERE n_readings > 0 AND (d1 IS NULL OR d2 IS NOT NULL AND resolved IS NULL)""",
)
def date_questions(spark, sf_dir):
    """What documents of mixed dates ask: a year where none is written, the order where nothing proves it."""
    dates = written(R.locate_dates(rendered(spark, sf_dir, "date_lines"), ["doc_id", "line_no"]), "dates")
    return R.date_questions(R.resolve_dates(dates, DOC, ORDER), DOC).selectExpr(
        "doc_id", "asks", "raw", "CAST(day_first AS STRING) AS day_first", "CAST(month_first AS STRING) AS month_first"
    )


# ---- answers applied on a rerun ----

ANSWERS = """SELECT c_custkey AS doc_id, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'DayFirst' WHEN 1 THEN 'MonthFirst' END AS user_order,
    2024 + CAST(c_custkey % 2 AS INT) AS assumed_year FROM {customer} WHERE c_custkey % 7 <> 0"""


@query(
    "answers_rerun",
    f"""WITH RECURSIVE src AS ({duck('date_lines')}), {C.date_tokens('src', 'doc_id, line_no')},
    a AS (SELECT t.*, user_order, coalesce(year, assumed_year) AS y FROM t_read t LEFT JOIN ({ANSWERS.format(customer='customer')}) c USING (doc_id) WHERE n_readings > 0)
    SELECT doc_id, line_no, st AS start, raw, CAST(CASE WHEN n_readings = 1 OR user_order = 'DayFirst' THEN {C.as_date('day1', 'month1', 'y')}
       WHEN user_order = 'MonthFirst' THEN {C.as_date('day2', 'month2', 'y')} END AS VARCHAR) AS date,
       n_readings = 2 AND user_order IS NULL AS asks_order, y IS NULL AS asks_year FROM a""",
)
def answers_rerun(spark, sf_dir):
    answers = spark.sql(ANSWERS.format(customer=f"parquet.`{sf_dir}/customer.parquet`"))
    tokens = K.date_tokens(rendered(spark, sf_dir, "date_lines"), ["doc_id", "line_no"]).where("n_readings > 0")
    return R.apply_answers(tokens, answers, DOC).selectExpr(
        "doc_id", "line_no", "start", "raw", "CAST(date AS STRING) AS date", "asks_order", "asks_year"
    )


# ---- morning or evening ----

COLUMN = ["doc_id", "col"]


def column_starts(spark, sf_dir):
    times = K.time_tokens(rendered(spark, sf_dir, "time_cols"), ["doc_id", "col", "row_no"])
    return R.side_tokens(times, COLUMN, ["row_no", "start"], "start", "end")


TOKENS = f"""src AS ({duck('time_cols')}), {C.time_tokens('src', 'doc_id, col, row_no')},
    tok AS (SELECT doc_id, col, row_no, st, start_mer AS mer, {C.written('start_hour', 'start_minute', 'start_mer')} AS w,
        start_hour BETWEEN 0 AND 23 AND start_minute BETWEEN 0 AND 59 AS ok, start_hour AS h, start_minute AS mi,
        (start_mer = 'Unstated' AND (start_hour BETWEEN 13 AND 23 OR start_padded AND start_hour BETWEEN 0 AND 12))
         OR coalesce(end_mer = 'Unstated' AND (end_hour BETWEEN 13 AND 23 OR end_padded AND end_hour BETWEEN 0 AND 12), false) AS proof FROM c_read),
    nota AS (SELECT doc_id, col, bool_and(w IS NOT NULL) AS aw, bool_or(proof) AS pr, bool_and(ok) AS ok, count(*) AS n FROM tok GROUP BY ALL)"""


@query(
    "meridiem_24h",
    f"""WITH {TOKENS} SELECT doc_id, col, row_no, CAST(coalesce(w, CASE WHEN ok THEN h * 60 + mi END) AS INT) AS minutes, w IS NULL AS inferred,
       CASE WHEN w IS NULL THEN 'this column uses 24-hour times' END AS reason
       FROM (SELECT t.*, n.aw, n.pr FROM tok t JOIN nota n USING (doc_id, col)) WHERE aw OR pr""",
)
def meridiem_24h(spark, sf_dir):
    tokens = column_starts(spark, sf_dir)
    notation = R.column_notation(tokens, COLUMN).where("all_written OR proof").select(*COLUMN)
    return tokens.join(notation, COLUMN).selectExpr(
        *COLUMN, "row_no", "coalesce(written, literal) AS minutes", "written IS NULL AS inferred",
        f"IF(written IS NULL, '{R.REASONS[R.BY_24H]}', NULL) AS reason",
    )


@query(
    "meridiem_monotonic",
    f"""WITH {TOKENS}, und AS (SELECT t.*, n.n, row_number() OVER (PARTITION BY doc_id, col ORDER BY row_no, st) - 1 AS i
        FROM tok t JOIN nota n USING (doc_id, col) WHERE NOT aw AND NOT pr),
    trial AS (SELECT doc_id, col, row_no, i, split, CASE WHEN mer <> 'Unstated' THEN w ELSE h % 12 * 60 + mi + CASE WHEN i >= split THEN 720 ELSE 0 END END AS t
        FROM (SELECT *, unnest(generate_series(0, n)) AS split FROM und WHERE (doc_id, col) IN (SELECT (doc_id, col) FROM nota WHERE n >= 3 AND ok))),
    rising AS (SELECT doc_id, col, split, list(t ORDER BY i) AS times FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id, col, split ORDER BY i) AS p FROM trial)
        GROUP BY doc_id, col, split HAVING bool_and(p IS NULL OR p < t)),
    one AS (SELECT doc_id, col, any_value(times) AS times FROM rising GROUP BY doc_id, col HAVING count(DISTINCT times) = 1)
    SELECT doc_id, col, row_no, CAST(coalesce(w, times[i + 1]) AS INT) AS minutes, w IS NULL AND times IS NOT NULL AS inferred,
      CASE WHEN w IS NOT NULL THEN NULL WHEN times IS NOT NULL THEN 'read from the order of times in this column' ELSE 'couldn''t tell if this is morning or evening' END AS reason
    FROM und LEFT JOIN one USING (doc_id, col)""",
)
def meridiem_monotonic(spark, sf_dir):
    tokens = column_starts(spark, sf_dir)
    settled = R.column_notation(tokens, COLUMN).where("all_written OR proof").select(*COLUMN)
    undecided = written(tokens.join(settled, COLUMN, "left_anti"), "times")
    return R.resolve_meridiem(undecided, COLUMN, ["row_no", "start"]).select(
        *COLUMN, "row_no", "minutes", "inferred", "reason"
    )
