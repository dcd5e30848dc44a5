"""Schedule reconstruction queries: grids, dated tables, sections, prose, and the choice among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.functions import vocabulary as V
from schedlake.operators import schedules as S
from schedlake.operators import tokens as K
from schedlake.plans import checking as C
from schedlake.plans import tokens
from schedlake.plans.registry import query
from schedlake.plans.tokens import LABELLED, NAMES, TITLE_TRIM
from schedlake.session import written
from schedlake.sources.rendered import duck, rendered

SHEET = S.SHEET


def features(spark, sf_dir, name="sheet_cells"):
    cells = written(rendered(spark, sf_dir, name), "cells")  # rendered once: they are read for their texts and joined to them
    return written(S.cell_features(cells), name)


def layout_of(f):
    return written(S.orientations(f), "layout")


DAY = f"regexp_matches(text, '{V.WEEKDAY_NAME}')"
CELL_KEYS = "doc_id, sheet, row_no, col"


def feats(name: str, p: str = "") -> str:
    """CTEs ending in ``{p}f``: cells with is_day, weekday, is_date, is_time and the first time."""
    return f"""{p}src AS (SELECT * FROM ({duck(name)}) c WHERE trim(text) <> ''), {C.date_tokens(f'{p}src', CELL_KEYS, p + 't_')}, {C.time_tokens(f'{p}src', CELL_KEYS, p + 'c_')},
    {p}dd AS (SELECT DISTINCT {CELL_KEYS} FROM {p}t_read WHERE n_readings > 0),
    {p}ft AS (SELECT *, count(*) FILTER (is_range) OVER (PARTITION BY {CELL_KEYS}) AS n_ranges FROM {p}c_read QUALIFY row_number() OVER (PARTITION BY {CELL_KEYS} ORDER BY st) = 1),
    {p}f AS (SELECT s.*, {DAY} AS is_day, CASE WHEN {DAY} THEN CAST((instr({C.DAY_STEMS}, lower(substr(regexp_extract(text, '{V.WEEKDAY_NAME}'), 1, 3))) + 2) / 3 AS INT) END AS weekday,
      dd.doc_id IS NOT NULL AS is_date, ft.doc_id IS NOT NULL AS is_time, coalesce(n_ranges, 0) AS n_ranges,
      start_hour, start_minute, start_mer, start_padded, end_hour, end_minute, end_mer, end_padded
      FROM {p}src s LEFT JOIN {p}dd dd USING ({CELL_KEYS}) LEFT JOIN (SELECT * EXCLUDE (text) FROM {p}ft) ft USING ({CELL_KEYS}))"""


LAYOUT_OF = """br AS (SELECT doc_id, sheet, arg_max(row_no, n * 1000 - row_no) AS day_row, max(n) AS in_row FROM (SELECT doc_id, sheet, row_no, count(*) FILTER (is_day) AS n FROM f GROUP BY ALL) GROUP BY ALL),
    bc AS (SELECT doc_id, sheet, arg_max(col, n * 1000 - col) AS day_col, max(n) AS in_col FROM (SELECT doc_id, sheet, col, count(*) FILTER (is_day) AS n FROM f GROUP BY ALL) GROUP BY ALL),
    sz AS (SELECT doc_id, sheet, max(row_no) + 1 AS n_rows, max(col) + 1 AS n_cols FROM f GROUP BY ALL),
    ph AS (SELECT doc_id, sheet, min(row_no) AS period_row FROM (SELECT f.doc_id, f.sheet, row_no FROM f JOIN bc USING (doc_id, sheet) WHERE col <> day_col AND is_time GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL),
    lay AS (SELECT doc_id, sheet, day_row, day_col, in_row, in_col, period_row, CASE WHEN n_rows < 2 OR n_cols < 2 OR greatest(in_row, in_col) < 2 THEN 'None' WHEN in_row >= in_col THEN 'ColumnOriented'
        WHEN period_row IS NOT NULL THEN 'PeriodColumns' ELSE 'RowOriented' END AS orientation FROM sz JOIN br USING (doc_id, sheet) JOIN bc USING (doc_id, sheet) LEFT JOIN ph USING (doc_id, sheet))"""
LAYOUT = f"""{feats('sheet_cells')}, {LAYOUT_OF}"""


@query("orientation", f"WITH RECURSIVE {LAYOUT} SELECT doc_id, orientation, CAST(in_row AS BIGINT) AS in_row, CAST(in_col AS BIGINT) AS in_col FROM lay")
def orientation(spark, sf_dir):
    return S.orientations(features(spark, sf_dir)).select("doc_id", "orientation", "in_row", "in_col")


@query(
    "weekly_decline",
    f"""WITH RECURSIVE {feats('dated_cells')} SELECT doc_id, count(DISTINCT row_no) AS dated_rows FROM f WHERE is_date AND NOT is_time GROUP BY doc_id HAVING count(DISTINCT row_no) >= 3""",
)
def weekly_decline(spark, sf_dir):
    return S.dated_sheets(features(spark, sf_dir, "dated_cells")).select("doc_id", "dated_rows")


W_START = C.written("start_hour", "start_minute", "start_mer")
W_END = C.written("end_hour", "end_minute", "end_mer")
PROOF = "(({s}_mer = 'Unstated' AND ({s}_hour BETWEEN 13 AND 23 OR {s}_padded AND {s}_hour BETWEEN 0 AND 12)))"


def slots(src: str, at: str, p: str) -> str:
    """Start and end minutes by trying every morning/evening split of the column (CTEs ending in ``{p}slot``)."""
    def side(x: str, w: str) -> str:
        q = f"{p}{x}"
        return f"""
    {q}k AS (SELECT doc_id, sheet, {at} AS pos, {w} AS w, {x}_hour AS h, {x}_minute AS mi, {x}_mer AS mer FROM {src} WHERE {x}_hour IS NOT NULL),
    {q}n AS (SELECT doc_id, sheet, bool_and(w IS NOT NULL) AS aw, count(*) AS n FROM {q}k GROUP BY ALL),
    {q}u AS (SELECT k.*, n, aw, pr, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY pos) - 1 AS i FROM {q}k k JOIN {q}n USING (doc_id, sheet) JOIN {p}pr USING (doc_id, sheet)),
    {q}tr AS (SELECT doc_id, sheet, pos, i, split, CASE WHEN mer <> 'Unstated' THEN w ELSE h % 12 * 60 + mi + CASE WHEN i >= split THEN 720 ELSE 0 END END AS t
      FROM (SELECT *, unnest(generate_series(0, n)) AS split FROM {q}u WHERE NOT aw AND NOT pr AND n >= 3)),
    {q}ri AS (SELECT doc_id, sheet, split, list(t ORDER BY i) AS ts FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id, sheet, split ORDER BY i) AS pt FROM {q}tr) GROUP BY doc_id, sheet, split HAVING bool_and(pt IS NULL OR pt < t)),
    {q}on AS (SELECT doc_id, sheet, any_value(ts) AS ts FROM {q}ri GROUP BY ALL HAVING count(DISTINCT ts) = 1),
    {q}o AS (SELECT doc_id, sheet, pos, CAST(coalesce(w, CASE WHEN aw THEN NULL WHEN pr THEN h * 60 + mi ELSE ts[i + 1] END) AS INT) AS m, w IS NULL AS inf FROM {q}u LEFT JOIN {q}on USING (doc_id, sheet))"""

    return f"""{p}pr AS (SELECT doc_id, sheet, bool_or(coalesce({PROOF.format(s='start')}, false) OR coalesce({PROOF.format(s='end')}, false)) AS pr FROM {src} GROUP BY ALL),
    {side('start', W_START)}, {side('end', W_END)},
    {p}slot AS (SELECT a.doc_id, a.sheet, a.pos, a.m AS start_min, b.m AS end_min, a.inf AS start_inf FROM {p}starto a LEFT JOIN {p}endo b USING (doc_id, sheet, pos))"""


def parsed(src: str, p: str) -> str:
    """Subject, room and instructor of each cell (CTE ``{p}sub``)."""
    k = "doc_id, sheet, row_no, col"
    return f"""
    {p}pa AS (SELECT {k}, i, regexp_replace(trim(pp[i]), '^[()\\[\\]\\-,]+|[()\\[\\]\\-,]+$', '', 'g') AS part FROM (SELECT *, unnest(range(1, len(pp) + 1)) AS i FROM (SELECT *, string_split_regex(text, '{V.SUBJECT_SPLITTERS}') AS pp FROM {src}))),
    {p}kp AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY i) AS pos FROM {p}pa WHERE part <> ''),
    {p}lo AS (SELECT {k}, max_by(part, {C.room_score('part')} * 10 + pos) AS loc FROM {p}kp WHERE {C.room_score('part')} > 0 GROUP BY ALL),
    {p}pl AS (SELECT a.*, loc FROM {p}kp a LEFT JOIN {p}lo USING ({k})),
    {p}in AS (SELECT {k}, min_by(part, pos) AS ins FROM {p}pl WHERE part IS DISTINCT FROM loc AND regexp_matches(part, '{V.INSTRUCTOR_PREFIX}') GROUP BY ALL),
    {p}sub AS (SELECT {k}, min_by(part, pos) FILTER (part IS DISTINCT FROM loc AND part IS DISTINCT FROM ins) AS subject, any_value(loc) AS loc, any_value(ins) AS ins FROM {p}pl LEFT JOIN {p}in USING ({k}) GROUP BY ALL)"""


DAYNAME = "split_part('monday,tuesday,wednesday,thursday,friday,saturday,sunday', ',', weekday)"
FIELDS = {"title": "title", "weekday": "weekday", "start": "start_min", "end": "end_min", "location": "location", "instructor": "instructor"}
OUT = f"doc_id, entry_id, {', '.join(FIELDS.values())}, {', '.join(f'{f}_level' for f in FIELDS)}"


def levels(fields: dict[str, str], **named: str) -> str:
    """Level columns in SQL: as named, High otherwise, Missing without a value."""
    return ", ".join(f"CASE WHEN {c} IS NULL THEN 'Missing' ELSE {named.get(f, repr('High'))} END AS {f}_level" for f, c in fields.items())


INFERRED = "CASE WHEN start_inf THEN 'Medium' ELSE 'High' END"
DERIVED = {"start": "'Medium'", "end": "'Medium'"}
GRID = f"""gm AS (SELECT f.*, day_row FROM f JOIN lay USING (doc_id, sheet) WHERE orientation = 'ColumnOriented'),
    gh AS (SELECT doc_id, sheet, col, weekday FROM gm WHERE row_no = day_row AND is_day),
    gc AS (SELECT doc_id, sheet, arg_max(col, n * 1000 - col) AS time_col FROM (SELECT doc_id, sheet, col, count(*) FILTER (row_no <> day_row AND is_time) AS n FROM gm WHERE (doc_id, sheet, col) NOT IN (SELECT (doc_id, sheet, col) FROM gh) GROUP BY ALL) GROUP BY ALL),
    gb AS (SELECT gm.* FROM gm JOIN gc USING (doc_id, sheet) WHERE col = time_col AND row_no <> day_row AND is_time), {slots('gb', 'row_no', 'g_')},
    gs AS (SELECT * FROM g_slot WHERE doc_id IN (SELECT doc_id FROM g_slot WHERE start_min IS NOT NULL)),
    gx AS (SELECT gm.doc_id, gm.sheet, gm.row_no, gm.col, gm.text, gh.weekday, start_min, end_min FROM gm JOIN gh ON gm.doc_id = gh.doc_id AND gm.col = gh.col JOIN gs ON gs.doc_id = gm.doc_id AND gs.pos = gm.row_no), {parsed('gx', 'g_')},
    grid0 AS (SELECT doc_id, sheet, row_no, col, {DAYNAME} || '-' || row_no || '-' || col AS entry_id, coalesce(subject, text) AS title, weekday, start_min, end_min, CASE WHEN subject IS NOT NULL THEN loc END AS location, CASE WHEN subject IS NOT NULL THEN ins END AS instructor
      FROM gx LEFT JOIN g_sub USING (doc_id, sheet, row_no, col)),
    grid AS (SELECT *, {levels(FIELDS, weekday=repr('Medium'), **DERIVED)} FROM grid0)"""


@query("weekly_grid", f"WITH RECURSIVE {LAYOUT}, {GRID} SELECT {OUT} FROM grid")
def weekly_grid(spark, sf_dir):
    f = features(spark, sf_dir)
    return S.weekly_grid(f, layout_of(f)).select(*OUT.split(", "))


PERIOD = f"""pm AS (SELECT f.*, day_col, period_row FROM f JOIN lay USING (doc_id, sheet) WHERE orientation = 'PeriodColumns'),
    pb AS (SELECT * FROM pm WHERE row_no = period_row AND col <> day_col AND n_ranges = 1 AND end_hour IS NOT NULL), {slots('pb', 'col', 'p_')},
    px AS (SELECT pm.doc_id, pm.sheet, pm.row_no, pm.col, pm.text, d.weekday, start_min, end_min FROM pm JOIN p_slot s ON s.doc_id = pm.doc_id AND s.pos = pm.col JOIN (SELECT * FROM pm WHERE col = day_col AND is_day) d ON d.doc_id = pm.doc_id AND d.row_no = pm.row_no WHERE pm.row_no <> pm.period_row), {parsed('px', 'p_')},
    period0 AS (SELECT doc_id, sheet, row_no, col, {DAYNAME} || '-' || row_no || '-' || col AS entry_id, coalesce(subject, text) AS title, weekday, start_min, end_min, CASE WHEN subject IS NOT NULL THEN loc END AS location, CASE WHEN subject IS NOT NULL THEN ins END AS instructor
      FROM px LEFT JOIN p_sub USING (doc_id, sheet, row_no, col)),
    period AS (SELECT *, {levels(FIELDS, **DERIVED)} FROM period0)"""


@query("period_grid", f"WITH RECURSIVE {LAYOUT}, {PERIOD} SELECT {OUT} FROM period")
def period_grid(spark, sf_dir):
    f = features(spark, sf_dir)
    return S.period_grid(f, layout_of(f)).select(*OUT.split(", "))


@query(
    "merged_periods",
    f"WITH RECURSIVE {LAYOUT} SELECT doc_id, count(*) AS skipped, count(*) || ' period column(s) couldn''t be told apart and were skipped' AS reason FROM f JOIN lay USING (doc_id, sheet) WHERE orientation = 'PeriodColumns' AND row_no = period_row AND col <> day_col AND n_ranges > 1 GROUP BY doc_id",
)
def merged_periods(spark, sf_dir):
    f = features(spark, sf_dir)
    return S.merged_periods(f, layout_of(f)).select("doc_id", "skipped", "reason")


ROWS = f"""lm AS (SELECT f.* FROM f JOIN lay USING (doc_id, sheet) WHERE orientation = 'RowOriented'),
    lr AS (SELECT doc_id, sheet, col, CASE WHEN count(*) FILTER (is_day) / count(*) >= 0.6 THEN 'Weekday' WHEN count(*) FILTER (is_time) / count(*) >= 0.6 THEN 'Time' WHEN count(*) FILTER (is_date) / count(*) >= 0.6 THEN 'Date'
      WHEN count(*) FILTER ({C.room_score('trim(text)')} > 0) / count(*) >= 0.6 THEN 'Location' WHEN count(*) FILTER (regexp_matches(trim(text), '{V.INSTRUCTOR_PREFIX}')) / count(*) >= 0.6 THEN 'Instructor' ELSE 'Subject' END AS role FROM lm GROUP BY ALL),
    lp AS (SELECT doc_id, sheet, min(col) FILTER (role = 'Weekday') AS wc, min(col) FILTER (role = 'Date') AS dc, min(col) FILTER (role = 'Time') AS tc, min(col) FILTER (role = 'Subject') AS sc, min(col) FILTER (role = 'Location') AS lc FROM lr GROUP BY ALL
      HAVING count(*) FILTER (role = 'Subject') > 0 AND count(*) FILTER (role = 'Time') > 0 AND count(*) FILTER (role IN ('Weekday', 'Date')) > 0),
    lb AS (SELECT lm.* FROM lm JOIN lp USING (doc_id, sheet) WHERE col = tc AND is_time), {slots('lb', 'row_no', 'l_')},
    lx AS (SELECT lm.doc_id, lm.sheet, lm.row_no, any_value(sc) AS col, max(text) FILTER (col = sc) AS text, max(weekday) FILTER (col = wc) AS weekday, max(text) FILTER (col = lc) AS place FROM lm JOIN lp USING (doc_id, sheet) GROUP BY lm.doc_id, lm.sheet, lm.row_no),
    ly AS (SELECT lx.*, start_min, end_min, start_inf FROM lx JOIN l_slot s ON s.doc_id = lx.doc_id AND s.pos = lx.row_no WHERE text IS NOT NULL), {parsed('ly', 'l_')},
    rowlist0 AS (SELECT doc_id, sheet, row_no, col, start_inf, 'row-' || row_no AS entry_id, coalesce(subject, text) AS title, weekday, start_min, end_min, coalesce(place, CASE WHEN subject IS NOT NULL THEN loc END) AS location, NULL::VARCHAR AS instructor FROM ly LEFT JOIN l_sub USING (doc_id, sheet, row_no, col)),
    rowlist AS (SELECT * EXCLUDE (start_inf), {levels(FIELDS, start=INFERRED)} FROM rowlist0)"""


@query("row_list", f"WITH RECURSIVE {LAYOUT}, {ROWS} SELECT {OUT} FROM rowlist")
def row_list(spark, sf_dir):
    f = features(spark, sf_dir)
    return S.row_list(f, layout_of(f)).select(*OUT.split(", "))


def lone(side: str, other: str, w: str) -> str:
    proof = f"coalesce({PROOF.format(s=side)}, false) OR coalesce({PROOF.format(s=other)}, false)"
    return f"CAST(coalesce({w}, CASE WHEN ({proof}) AND {side}_hour BETWEEN 0 AND 23 THEN {side}_hour * 60 + {side}_minute END) AS INT)"


ROSTER = f"""oc AS (SELECT f.* FROM f JOIN lay USING (doc_id, sheet)), oh AS (SELECT doc_id, sheet, f.col, f.weekday FROM f JOIN lay USING (doc_id, sheet) WHERE row_no = day_row AND is_day),
    oe AS (SELECT doc_id FROM oh GROUP BY doc_id HAVING count(*) >= 2),
    onm AS (SELECT doc_id, min(i) AS name_col FROM (SELECT doc_id, unnest(range(0, n_cols)) AS i FROM sz WHERE n_cols >= 3 AND n_rows >= 2) WHERE (doc_id, i) NOT IN (SELECT (doc_id, col) FROM oh) GROUP BY doc_id),
    rost AS (SELECT c.doc_id, c.sheet, c.row_no, c.col, 'roster-' || c.row_no || '-' || c.col AS entry_id, trim(p.text) AS title, oh.weekday, {lone('c.start', 'c.end', C.written('c.start_hour', 'c.start_minute', 'c.start_mer'))} AS start_min,
        {lone('c.end', 'c.start', C.written('c.end_hour', 'c.end_minute', 'c.end_mer'))} AS end_min, NULL::VARCHAR AS location, NULL::VARCHAR AS instructor
      FROM oc c JOIN lay ON lay.doc_id = c.doc_id JOIN oh ON oh.doc_id = c.doc_id AND oh.col = c.col JOIN onm ON onm.doc_id = c.doc_id JOIN oc p ON p.doc_id = c.doc_id AND p.row_no = c.row_no AND p.col = name_col
      WHERE c.row_no <> lay.day_row AND c.doc_id IN (SELECT doc_id FROM oe) AND c.end_hour IS NOT NULL AND {C.letters('p.text')} >= 2),
    roster AS (SELECT *, {levels(FIELDS)} FROM rost WHERE start_min IS NOT NULL AND end_min IS NOT NULL)"""


@query("roster", f"WITH RECURSIVE {LAYOUT}, {ROSTER} SELECT doc_id, entry_id, title, weekday, start_min, end_min FROM roster")
def roster(spark, sf_dir):
    f = features(spark, sf_dir)
    return S.roster(f, layout_of(f)).select("doc_id", "entry_id", "title", "weekday", "start_min", "end_min")


ORDINARY_OF = f"""{LAYOUT_OF}, {GRID}, {PERIOD}, {ROWS}, {ROSTER},
    ord AS (SELECT *, 'Weekly' AS kind FROM grid UNION ALL SELECT *, 'Unknown' FROM period UNION ALL SELECT *, 'Unknown' FROM rowlist),
    al AS (SELECT * FROM ord UNION ALL SELECT *, 'Weekly' FROM roster WHERE doc_id NOT IN (SELECT doc_id FROM ord)),
    ded AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY doc_id, title, weekday, start_min, end_min ORDER BY row_no, col) = 1),
    pls AS (SELECT doc_id, count(*) AS n FROM ded GROUP BY doc_id HAVING count(*) >= 3 AND count(weekday) >= count(*) * 0.6 AND count(DISTINCT weekday) >= 2 AND count(DISTINCT start_min) >= 2
      AND bool_or(length(title) >= 2 AND {C.letters('title')} >= 3 AND {C.letters('title')} * 2 >= {C.solid('title')}))"""
ORDINARY = f"""{feats('sheet_cells')}, {ORDINARY_OF}"""


@query("plausible_week", f"WITH RECURSIVE {ORDINARY} SELECT doc_id, n FROM pls")
def plausible_week(spark, sf_dir):
    return S.plausible_groups(all_entries(spark, sf_dir)).select("doc_id", "n")


def all_entries(spark, sf_dir):
    f = features(spark, sf_dir)
    layout = layout_of(f)
    ordinary = written(
        S.weekly_grid(f, layout).unionByName(S.period_grid(f, layout)).unionByName(S.row_list(f, layout)), "entries"
    )
    second = S.roster(f, layout.join(ordinary.select(*SHEET).distinct(), SHEET, "left_anti"))
    return S.dedupe(ordinary.unionByName(second))


# Every sheet twice, the copy shifted down: what a merged cell read twice looks like.
@query(
    "entry_dedupe",
    f"WITH RECURSIVE {LAYOUT}, {PERIOD} SELECT doc_id, title, weekday, start_min, end_min, min(row_no) AS row_no FROM period GROUP BY ALL",
)
def entry_dedupe(spark, sf_dir):
    f = features(spark, sf_dir)
    entries = S.period_grid(f, layout_of(f))
    twice = entries.unionByName(entries.withColumn("row_no", F.expr("CAST(row_no + 100 AS INT)")))
    return S.dedupe(twice).select("doc_id", "title", "weekday", "start_min", "end_min", "row_no")


# ---- dated tables ----

HEADER = f"""dc AS (SELECT * FROM ({duck('dated_cells')}) c WHERE trim(text) <> ''),
    hd AS (SELECT doc_id, min(row_no) AS header FROM (SELECT doc_id, row_no FROM dc GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER ({C.header_role('text')} = 'Date') > 0) GROUP BY 1),
    ro AS (SELECT doc_id, col, {C.header_role('text')} AS role, trim(text) AS heading, header FROM dc JOIN hd USING (doc_id) WHERE row_no = header),
    ug AS (SELECT doc_id, row_no, col, regexp_replace(text, '(\\d{{4}})(\\d{{1,2}}:\\d{{2}})', '\\1 \\2', 'g') AS text, role, header, heading FROM dc JOIN ro USING (doc_id, col) WHERE row_no > header),
    dcol AS (SELECT doc_id, min(col) AS date_col FROM ro WHERE role = 'Date' GROUP BY 1), {C.date_tokens('ug', 'doc_id, row_no, col', 'z_')},
    cd AS (SELECT doc_id, row_no, col, n_readings, {C.as_date('day1', 'month1', 'year')} AS d1, {C.as_date('day2', 'month2', 'year')} AS d2 FROM z_read WHERE n_readings > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, row_no, col ORDER BY st) = 1),
    {C.time_tokens('ug', 'doc_id, row_no, col', 'y_')},
    ct AS (SELECT * EXCLUDE (text) FROM y_read QUALIFY row_number() OVER (PARTITION BY doc_id, row_no, col ORDER BY st) = 1)"""


def dated_rows(order: str) -> str:
    """CTE ``dt``: one entry per readable row under the user's order (SQL text, NULL for none)."""
    return f"""dj AS (SELECT doc_id, row_no, min_by(trim(text), col) FILTER (role = 'Subject') AS title, min(col) FILTER (role = 'Time') AS tcol, min_by(trim(text), col) FILTER (role = 'Place') AS location FROM ug GROUP BY ALL),
    dd2 AS (SELECT cd.doc_id, cd.row_no, CASE WHEN n_readings = 1 OR {order} = 'DayFirst' THEN d1 WHEN {order} = 'MonthFirst' THEN d2 END AS date FROM cd JOIN dcol ON dcol.doc_id = cd.doc_id AND cd.col = date_col),
    dt AS (SELECT dj.doc_id, dj.row_no, 'dated-' || dj.row_no AS entry_id, title, date, {lone('start', 'end', W_START)} AS start_min, {lone('end', 'start', W_END)} AS end_min, location, {W_START} IS NULL AS start_inf
      FROM dj JOIN dd2 USING (doc_id, row_no) LEFT JOIN ct ON ct.doc_id = dj.doc_id AND ct.row_no = dj.row_no AND ct.col = tcol
      WHERE date IS NOT NULL AND length(title) >= 3 AND {C.letters('title')} >= 3 AND {C.letters('title')} * 2 >= {C.solid('title')} AND {C.header_role('title')} = 'Subject')"""


def dated(spark, sf_dir, answers=None):
    cells = written(rendered(spark, sf_dir, "dated_cells"), "cells")
    layout = written(S.dated_layout(cells), "layout")
    return cells, layout, written(S.dated_table(cells, layout, answers), "dated")


DATED_FIELDS = {"title": "title", "date": "date", "start": "start_min", "end": "end_min", "location": "location"}
DATED_LEVELS = levels(DATED_FIELDS, start=INFERRED)
DATED_OUT = ["doc_id", "entry_id", "title", "CAST(date AS STRING) AS date", "start_min", "end_min", "location", *[f"{f}_level" for f in DATED_FIELDS]]


@query(
    "dated_table",
    f"WITH RECURSIVE {HEADER}, {dated_rows('NULL')} SELECT doc_id, entry_id, title, CAST(date AS VARCHAR) AS date, start_min, end_min, location, {DATED_LEVELS} FROM dt",
)
def dated_table(spark, sf_dir):
    return dated(spark, sf_dir)[2].selectExpr(*DATED_OUT)


def user_orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS doc_id", USER.replace("dj.doc_id", "c_custkey") + " AS user_order"
    )


USER = "CASE CAST(dj.doc_id % 3 AS INT) WHEN 0 THEN 'DayFirst' WHEN 1 THEN 'MonthFirst' END"


@query(
    "dated_table_answered",
    f"WITH RECURSIVE {HEADER}, {dated_rows(USER.replace('dj.', 'cd.'))} SELECT doc_id, entry_id, title, CAST(date AS VARCHAR) AS date, start_min, end_min, location, {DATED_LEVELS} FROM dt",
)
def dated_table_answered(spark, sf_dir):
    return dated(spark, sf_dir, user_orders(spark, sf_dir))[2].selectExpr(*DATED_OUT)


SPLIT = "heading"
for _w in V.GLUED_WORDS:
    SPLIT = f"regexp_replace({SPLIT}, '(?i)([a-z])({_w})\\b', '\\1 \\2', 'g')"


def field_rows(order: str) -> str:
    """CTE ``ev``: the field events of sheets without rows in ``dt``, under the user's order (SQL text, NULL for none)."""
    return f"""nw AS (SELECT doc_id, count(*) AS width FROM ro GROUP BY 1),
    rc AS (SELECT doc_id, row_no FROM dc JOIN hd USING (doc_id) JOIN nw USING (doc_id) WHERE row_no > header AND doc_id NOT IN (SELECT doc_id FROM dt) GROUP BY doc_id, row_no, width HAVING count(*) * 2 >= width),
    sb AS (SELECT doc_id, trim(split_part(split_part(min_by(trim(text), row(row_no, col)), '—', 1), ' - ', 1)) AS subject FROM dc JOIN hd USING (doc_id) WHERE row_no < header AND {C.letters('text')} >= 4 GROUP BY 1),
    fl AS (SELECT doc_id, col, trim(regexp_replace({SPLIT}, '\\s+', ' ', 'g')) AS field FROM ro WHERE role = 'Date'),
    ev AS (SELECT cd.doc_id, cd.row_no, cd.col, CASE WHEN subject IS NULL THEN '' ELSE subject || ' · ' END || upper(substr(field, 1, 1)) || substr(field, 2) AS title,
        CASE WHEN n_readings = 1 OR {order} = 'DayFirst' THEN d1 WHEN {order} = 'MonthFirst' THEN d2 END AS date, {lone('start', 'end', W_START)} AS start_min
      FROM cd JOIN rc USING (doc_id, row_no) JOIN fl USING (doc_id, col) LEFT JOIN sb USING (doc_id) LEFT JOIN ct USING (doc_id, row_no, col))"""


FIELD_LEVELS = "'High' AS title_level, 'High' AS date_level, CASE WHEN start_min IS NULL THEN 'Missing' ELSE 'High' END AS start_level, 'Missing' AS end_level"
FIELD_OUT = f"SELECT doc_id, title, CAST(date AS VARCHAR) AS date, start_min, min_by('field-' || row_no || '-' || col, row(row_no, col)) AS entry_id, {FIELD_LEVELS} FROM ev WHERE date IS NOT NULL GROUP BY ALL"


def field_events(spark, sf_dir, answers=None):
    cells, layout, produced = dated(spark, sf_dir, answers)
    return S.field_table(cells, layout, produced, answers).selectExpr(
        "doc_id", "title", "CAST(date AS STRING) AS date", "start_min", "entry_id", "title_level", "date_level", "start_level", "end_level"
    )


@query("field_table", f"WITH RECURSIVE {HEADER}, {dated_rows('NULL')}, {field_rows('NULL')} {FIELD_OUT}")
def field_table(spark, sf_dir):
    return field_events(spark, sf_dir)


@query(
    "field_table_answered",
    f"WITH RECURSIVE {HEADER}, {dated_rows(USER.replace('dj.', 'cd.'))}, {field_rows(USER.replace('dj.', 'cd.'))} {FIELD_OUT}",
)
def field_table_answered(spark, sf_dir):
    return field_events(spark, sf_dir, user_orders(spark, sf_dir))


@query(
    "ambiguity_questions",
    f"""WITH RECURSIVE {HEADER}, {dated_rows('NULL')}, {field_rows('NULL')}
    SELECT cd.doc_id, min_by(trim(c.text), cd.row_no) AS example, CAST(min_by(d1, cd.row_no) AS VARCHAR) AS day_first, CAST(min_by(d2, cd.row_no) AS VARCHAR) AS month_first
    FROM cd JOIN dcol ON dcol.doc_id = cd.doc_id AND cd.col = date_col JOIN dc c ON c.doc_id = cd.doc_id AND c.row_no = cd.row_no AND c.col = cd.col
    WHERE n_readings = 2 AND cd.doc_id NOT IN (SELECT doc_id FROM dt UNION SELECT doc_id FROM ev WHERE date IS NOT NULL) GROUP BY cd.doc_id""",
)
def ambiguity_questions(spark, sf_dir):
    cells, layout, rows = dated(spark, sf_dir)
    produced = rows.select(*SHEET).unionByName(S.field_table(cells, layout, rows).select(*SHEET))
    return S.date_questions(cells, layout, produced).selectExpr(
        "doc_id", "example", "CAST(day_first AS STRING) AS day_first", "CAST(month_first AS STRING) AS month_first"
    )


# ---- sections and shapes ----

ROWF = """rf AS (SELECT doc_id, sheet, row_no, bool_or(is_day) AS day_row, bool_or(is_date) AS date_row, count(*) FILTER (is_time) AS times, count(*) FILTER (is_day) AS days, count(*) AS filled, string_agg(trim(text), ' · ' ORDER BY col) AS label FROM f GROUP BY ALL)"""


@query(
    "section_split",
    f"""WITH RECURSIVE {feats('section_cells')}, {ROWF}, hd AS (SELECT doc_id, min(row_no) AS header FROM rf WHERE times >= 3 GROUP BY 1),
    bl AS (SELECT rf.*, header FROM rf JOIN hd USING (doc_id) WHERE row_no > header),
    dy AS (SELECT *, row_no - row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS isl FROM bl WHERE day_row),
    sc AS (SELECT doc_id, isl, any_value(header) AS header, min(row_no) AS first_row, max(row_no) AS last_row, CAST(sum(filled - 1) AS BIGINT) AS size FROM dy GROUP BY doc_id, isl)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_row) AS section,
      coalesce((SELECT max_by(label, row_no) FROM bl b WHERE b.doc_id = sc.doc_id AND NOT b.day_row AND b.row_no < sc.first_row), 'Schedule ' || row_number() OVER (PARTITION BY doc_id ORDER BY first_row)) AS label,
      first_row, last_row, size FROM sc""",
)
def section_split(spark, sf_dir):
    rows = written(S.row_features(features(spark, sf_dir, "section_cells")), "rows")
    headers = rows.where("times >= 3").groupBy(*SHEET).agg(F.min("row_no").alias("header"))
    return S.sections(rows, headers).select("doc_id", "section", "label", "first_row", "last_row", "size")


# In the check a section is a document of its own, numbered 100,000 times the document plus the section.
SECTION_FEATS = f"""{feats('section_cells', 'x')}, {ROWF.replace('rf AS', 'xrf AS').replace('FROM f', 'FROM xf')},
    xhd AS (SELECT doc_id, min(row_no) AS header FROM xrf WHERE times >= 3 GROUP BY 1),
    xbl AS (SELECT xrf.*, header FROM xrf JOIN xhd USING (doc_id) WHERE row_no > header),
    xdy AS (SELECT *, row_no - row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS isl FROM xbl WHERE day_row),
    xsc AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_row) AS section FROM (SELECT doc_id, any_value(header) AS header, min(row_no) AS first_row, max(row_no) AS last_row FROM xdy GROUP BY doc_id, isl)),
    f AS MATERIALIZED (SELECT xf.* REPLACE (xf.doc_id * 100000 + section AS doc_id, CASE WHEN row_no = header THEN 0 ELSE row_no - first_row + 1 END AS row_no)
      FROM xf JOIN xsc ON xf.doc_id = xsc.doc_id AND (row_no = header OR row_no BETWEEN first_row AND last_row))"""


@query(
    "section_schedules",
    f"""WITH RECURSIVE {SECTION_FEATS}, {ORDINARY_OF},
    xlb AS (SELECT xsc.*, coalesce((SELECT max_by(label, row_no) FROM xbl b WHERE b.doc_id = xsc.doc_id AND NOT b.day_row AND b.row_no < xsc.first_row), 'Schedule ' || section) AS label FROM xsc)
    SELECT xlb.doc_id, section, label, entry_id, title, weekday, start_min, end_min, location, CAST(first_row + row_no - 1 AS INT) AS sheet_row, col, kind
    FROM ded JOIN pls USING (doc_id) JOIN xlb ON ded.doc_id = xlb.doc_id * 100000 + section""",
)
def section_schedules(spark, sf_dir):
    return S.section_schedules(features(spark, sf_dir, "section_cells")).select(
        "doc_id", "section", "label", "entry_id", "title", "weekday", "start_min", "end_min", "location", "sheet_row", "col", "kind"
    )


SHAPES = """CASE WHEN min(row_no) FILTER (times >= 3) IS NOT NULL THEN 'Sections' WHEN count(*) FILTER (day_row) >= 3 THEN 'FlatList'
      WHEN max(row_no) > min(row_no) FILTER (days >= 2) THEN 'HeaderList' WHEN count(*) FILTER (date_row) >= 2 AND min(row_no) FILTER (date_row) > 0 THEN 'DatedList' ELSE 'Nothing' END"""


@query(
    "sheet_shapes",
    f"""WITH RECURSIVE {feats('sheet_cells')}, {ROWF}, sh AS (SELECT doc_id, sheet, {SHAPES} AS shape, count(*) FILTER (day_row) AS dr, count(*) FILTER (date_row) AS dt, min(row_no) FILTER (days >= 2) AS wr FROM rf GROUP BY ALL),
    {feats('dated_cells', 'q')}, {ROWF.replace('rf AS', 'qrf AS').replace('FROM f', 'FROM qf')}, qsh AS (SELECT doc_id, sheet, {SHAPES} AS shape, count(*) FILTER (day_row) AS dr, count(*) FILTER (date_row) AS dt, min(row_no) FILTER (days >= 2) AS wr FROM qrf GROUP BY ALL)
    SELECT doc_id, sheet, shape, CAST(CASE shape WHEN 'FlatList' THEN dr WHEN 'HeaderList' THEN (SELECT sum(filled) FROM rf WHERE rf.doc_id = sh.doc_id AND rf.row_no > wr) WHEN 'DatedList' THEN dt END AS BIGINT) AS estimated FROM sh
    UNION ALL SELECT doc_id, sheet, shape, CAST(CASE shape WHEN 'FlatList' THEN dr WHEN 'HeaderList' THEN (SELECT sum(filled) FROM qrf WHERE qrf.doc_id = qsh.doc_id AND qrf.row_no > wr) WHEN 'DatedList' THEN dt END AS BIGINT) FROM qsh""",
)
def sheet_shapes(spark, sf_dir):
    rows = S.row_features(features(spark, sf_dir)).unionByName(S.row_features(features(spark, sf_dir, "dated_cells")))
    rows = written(rows, "rows")
    return S.shape_sizes(rows, S.sheet_shapes(rows))


# ---- prose ----

AT = "doc_id, line_no"
IS_HEADER = f"len(list_filter(string_split_regex(lower(x), '[ \\t]'), lambda w: w <> '' AND regexp_replace(w, '^[{TITLE_TRIM}]+|[{TITLE_TRIM}]+$', '', 'g') NOT IN ({C.LIST(V.COLUMN_HEADER_WORDS)}))) = 0"
PLAIN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
HEADS = f"""src AS ({duck('labelled')}), {C.date_tokens('src', AT)},
    rd AS (SELECT DISTINCT {AT} FROM t_read WHERE n_readings > 0),
    hx AS (SELECT src.*, {PLAIN} AS x FROM src),
    hh AS (SELECT hx.*, CASE WHEN {NAMES} AND NOT ({IS_HEADER}) AND rd.doc_id IS NULL THEN x END AS heading FROM hx LEFT JOIN rd USING ({AT})),
    ab AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM hh)"""


@query("heading_asof", f"WITH RECURSIVE {HEADS} SELECT {AT}, heading, above FROM ab")
def heading_asof(spark, sf_dir):
    lines = rendered(spark, sf_dir, "labelled")
    return S.nearest_headings(lines, ["doc_id"]).select("doc_id", "line_no", "heading", "above")


def named(expr: str) -> str:
    return NAMES.replace("(x", f"({expr}").replace("(lower(split_part(x", f"(lower(split_part({expr}")


TITLES = f"""{HEADS},
    fst AS (SELECT {AT}, st, raw, n_readings, proven_order, day1, month1, day2, month2, year, {C.as_date('day1', 'month1', 'year')} AS d1, {C.as_date('day2', 'month2', 'year')} AS d2 FROM t_read WHERE n_readings > 0 QUALIFY row_number() OVER (PARTITION BY {AT} ORDER BY st) = 1),
    fld AS ({LABELLED}), sj AS (SELECT doc_id, min_by(value, line_no) AS subject FROM fld WHERE role = 'Subject' GROUP BY 1),
    sk AS (SELECT doc_id, x AS subject FROM (SELECT doc_id, subject AS x FROM sj) WHERE {NAMES}),
    {C.time_tokens('src', AT)},
    w0 AS (SELECT {AT}, text, above, trim(regexp_replace(regexp_replace(substr(text, 1, st), '^[{TITLE_TRIM}]+|[{TITLE_TRIM}]+$', '', 'g'), '\\s+', ' ', 'g')) AS p0, text AS r0, fld.label, sk.subject FROM fst JOIN ab USING ({AT}) LEFT JOIN (SELECT * FROM fld WHERE role = 'When') fld USING ({AT}) LEFT JOIN sk USING (doc_id)),
    toks AS (SELECT {AT}, raw, row_number() OVER (PARTITION BY {AT} ORDER BY k, st) AS i FROM (SELECT {AT}, raw, 0 AS k, st FROM t_read UNION ALL SELECT {AT}, trim(raw), 1, st FROM c_read)),
    cut AS (SELECT {AT}, r0, 0 AS i FROM w0 UNION ALL SELECT c.doc_id, c.line_no, replace(r0, raw, ' '), c.i + 1 FROM cut c JOIN toks t ON t.doc_id = c.doc_id AND t.line_no = c.line_no AND t.i = c.i + 1),
    rst AS (SELECT {AT}, trim(regexp_replace(regexp_replace(max_by(r0, i), '^[{TITLE_TRIM}]+|[{TITLE_TRIM}]+$', '', 'g'), '\\s+', ' ', 'g')) AS rest FROM cut GROUP BY ALL),
    w1 AS (SELECT w0.*, rest, trim(regexp_replace(regexp_replace(p0, '^[{TITLE_TRIM}]+|[{TITLE_TRIM}]+$', '', 'g'), '(?i)(?:[{TITLE_TRIM}]* [{TITLE_TRIM}]*(?:{'|'.join(V.DANGLING_WORDS)}))+$', '')) AS prefix, CASE WHEN label IS NULL THEN NULL WHEN subject IS NULL THEN label ELSE subject || ' — ' || label END AS fromlabel FROM w0 JOIN rst USING ({AT})),
    o1 AS (SELECT {AT}, {NAMES} AS ok FROM (SELECT {AT}, fromlabel AS x FROM w1)),
    o2 AS (SELECT {AT}, {NAMES} AND NOT ({IS_HEADER}) AND NOT (len(list_filter(string_split_regex(x, '[ ,]'), lambda w: w <> '')) > 0 AND len(list_filter(string_split_regex(x, '[ ,]'), lambda w: w <> '' AND NOT regexp_matches(w, '{V.WEEKDAY_NAME}'))) = 0) AS ok FROM (SELECT {AT}, prefix AS x FROM w1)),
    o3 AS (SELECT {AT}, {NAMES} AND NOT ({IS_HEADER}) AS ok FROM (SELECT {AT}, rest AS x FROM w1)),
    ttl AS (SELECT {AT}, CASE WHEN o1.ok THEN fromlabel WHEN o2.ok THEN prefix WHEN o3.ok THEN rest ELSE above END AS title, CASE WHEN o1.ok THEN 'label' WHEN o2.ok THEN 'before' WHEN o3.ok THEN 'rest' WHEN above IS NOT NULL THEN 'heading' END AS origin
      FROM w1 JOIN o1 USING ({AT}) JOIN o2 USING ({AT}) JOIN o3 USING ({AT}))"""


@query("prose_titles", f"WITH RECURSIVE {TITLES} SELECT {AT}, title, origin FROM ttl WHERE title IS NOT NULL")
def prose_titles(spark, sf_dir):
    lines = written(rendered(spark, sf_dir, "labelled"), "lines")
    return S.prose_titles(lines, written(S.prose_anchors(lines), "anchors"), written(S.prose_fields(lines), "fields"))


# Lines hold at most one time here, so a time stands as written or under its own proof.
PROSE = f"""{TITLES}, sib AS (SELECT doc_id, any_value(proven_order) AS o FROM fst WHERE proven_order IS NOT NULL GROUP BY 1 HAVING count(DISTINCT proven_order) = 1),
    rs AS (SELECT {AT}, CASE WHEN d2 IS NULL THEN d1 WHEN o = 'DayFirst' THEN d1 WHEN o = 'MonthFirst' THEN d2 END AS date FROM fst LEFT JOIN sib USING (doc_id)),
    lt AS (SELECT {AT}, {lone('start', 'end', W_START)} AS start_min, {lone('end', 'start', W_END)} AS end_min, {W_START} IS NULL AS inf FROM c_read QUALIFY row_number() OVER (PARTITION BY {AT} ORDER BY st) = 1),
    sg AS (SELECT doc_id FROM fst GROUP BY 1 HAVING count(*) = 1), tf AS (SELECT doc_id, min(line_no) AS line_no FROM fld WHERE role = 'Time' GROUP BY 1),
    bw AS (SELECT tf.doc_id, start_min AS borrowed FROM tf JOIN sg USING (doc_id) JOIN lt USING ({AT})),
    pe AS (SELECT rs.doc_id, rs.line_no, title, origin, date, CASE WHEN lt.doc_id IS NULL THEN borrowed ELSE start_min END AS start_min, end_min, lt.doc_id IS NULL OR inf AS start_inf FROM rs JOIN ttl USING ({AT}) LEFT JOIN lt USING ({AT}) LEFT JOIN bw USING (doc_id) WHERE date IS NOT NULL AND title IS NOT NULL),
    pk AS ({tokens.KINDS}),
    pd AS (SELECT pe.*, kind FROM pe JOIN pk USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, CASE WHEN origin = 'heading' THEN 'prose-' || line_no ELSE title END, date, start_min ORDER BY line_no) = 1)"""


PROSE_FIELDS = {"title": "title", "date": "date", "start": "start_min", "end": "end_min"}
PROSE_LEVELS = levels(PROSE_FIELDS, start=INFERRED, title="CASE WHEN origin IN ('label', 'heading') THEN 'Medium' ELSE 'High' END")


@query("prose_events", f"WITH RECURSIVE {PROSE} SELECT {AT}, kind, title, origin, CAST(date AS VARCHAR) AS date, start_min, end_min, {PROSE_LEVELS} FROM pd")
def prose_events(spark, sf_dir):
    lines = written(rendered(spark, sf_dir, "labelled"), "lines")
    return S.prose_events(lines).selectExpr(
        "doc_id", "line_no", "kind", "title", "origin", "CAST(date AS STRING) AS date", "start_min", "end_min", *[f"{f}_level" for f in PROSE_FIELDS]
    )


# ---- choosing ----


# One document may hold a weekly sheet, a dated table and lines of text; one in eleven is plain text.
PLAIN_TEXT = "doc_id % 11 = 0"
CHOSEN = f"""r AS (SELECT doc_id, 1 AS k, entry_id, kind, title, weekday, CAST(NULL AS DATE) AS date, start_min, end_min, location, title_level, weekday_level, 'Missing' AS date_level, start_level, end_level, location_level
        FROM (WITH RECURSIVE {ORDINARY} SELECT ded.* FROM ded JOIN pls USING (doc_id)) a WHERE NOT {PLAIN_TEXT}
      UNION ALL SELECT doc_id, 2, entry_id, 'Event', title, NULL, date, start_min, end_min, location, title_level, 'Missing', date_level, start_level, end_level, location_level
        FROM (WITH RECURSIVE {HEADER}, {dated_rows('NULL')} SELECT *, {DATED_LEVELS} FROM dt) b WHERE NOT {PLAIN_TEXT}
      UNION ALL SELECT doc_id, 2, entry_id, 'Event', title, NULL, CAST(date AS DATE), start_min, NULL, NULL, title_level, 'Missing', date_level, start_level, end_level, 'Missing'
        FROM (WITH RECURSIVE {HEADER}, {dated_rows('NULL')}, {field_rows('NULL')} {FIELD_OUT}) d WHERE NOT {PLAIN_TEXT}
      UNION ALL SELECT doc_id, 3, 'prose-' || line_no, kind, title, NULL, date, start_min, end_min, NULL, title_level, 'Missing', date_level, start_level, end_level, 'Missing'
        FROM (WITH RECURSIVE {PROSE} SELECT *, {PROSE_LEVELS} FROM pd) c),
    chosen AS (SELECT * EXCLUDE (k), split_part('weekly,dated,prose', ',', k) AS reading FROM r QUALIFY k = min(k) OVER (PARTITION BY doc_id))"""


def chosen(spark, sf_dir):
    weekly = written(S.weekly_schedules(features(spark, sf_dir)), "weekly")
    cells, layout, rows = dated(spark, sf_dir)
    fields = S.field_table(cells, layout, rows).withColumns({"location": F.lit(None).cast("string"), "location_level": F.lit("Missing")})
    found = written(rows.drop("row_no").unionByName(fields), "dated-and-fields")
    lines = written(rendered(spark, sf_dir, "labelled"), "lines")
    plain = lines.where(PLAIN_TEXT).select("doc_id").distinct()
    for rows in (weekly, found):
        plain = plain.unionByName(rows.where(PLAIN_TEXT).select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    return S.fallback(weekly, found, S.prose_events(lines), plain.distinct())


@query("schedule_fallback", f"WITH {CHOSEN} SELECT doc_id, reading, entry_id, kind, title, weekday, CAST(date AS VARCHAR) AS date, start_min, end_min, location FROM chosen")
def schedule_fallback(spark, sf_dir):
    return chosen(spark, sf_dir).selectExpr(
        "doc_id", "reading", "entry_id", "kind", "title", "weekday", "CAST(date AS STRING) AS date", "start_min", "end_min", "location"
    )


# ---- answers ----

YEARS = [2026, 2027]
# letters are documents of their own here, numbered apart from the tables
LETTERS = "SELECT doc_id + 1000000000 AS doc_id, line_no, text FROM ({0}) l"
ANSWERED = f"""{PROSE.replace(duck('labelled'), LETTERS.format(duck('labelled')))}, {HEADER}, {dated_rows('NULL')}, {field_rows('NULL')},
    td AS MATERIALIZED (SELECT doc_id, row_no, col, n_readings, day1, month1, day2, month2, year, {C.as_date('day1', 'month1', 'year')} AS d1, {C.as_date('day2', 'month2', 'year')} AS d2
      FROM z_read JOIN (SELECT doc_id, col FROM ro WHERE role = 'Date') USING (doc_id, col) WHERE n_readings > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, row_no, col ORDER BY st) = 1),
    aq AS MATERIALIZED (SELECT doc_id, bool_or(o) AS asks_order, bool_or(y) AS asks_year FROM (
        SELECT doc_id, n_readings = 2 AND (year IS NULL OR d1 IS NOT NULL AND d2 IS NOT NULL) AS o, year IS NULL AS y FROM td
        UNION ALL SELECT doc_id, d1 IS NOT NULL AND d2 IS NOT NULL AND o IS NULL, year IS NULL FROM fst LEFT JOIN sib USING (doc_id)) GROUP BY 1),
    an AS MATERIALIZED (SELECT doc_id, uo, ay, coalesce(uo, 'any') || '/' || coalesce(CAST(ay AS VARCHAR), 'any') AS answer
      FROM aq, (VALUES (NULL), ('DayFirst'), ('MonthFirst')) o(uo), (VALUES (NULL), {', '.join(f'({y})' for y in YEARS)}) y(ay) WHERE (uo IS NULL OR asks_order) AND (ay IS NULL OR asks_year)),
    ad AS MATERIALIZED (SELECT td.doc_id, row_no, col, answer, CASE WHEN n_readings = 1 OR uo = 'DayFirst' THEN {C.as_date('day1', 'month1', 'coalesce(year, ay)')}
        WHEN uo = 'MonthFirst' THEN {C.as_date('day2', 'month2', 'coalesce(year, ay)')} END AS date FROM td JOIN an USING (doc_id)),
    ar AS MATERIALIZED (SELECT dj.doc_id, ad.answer, 'dated-' || dj.row_no AS entry_id, 'Event' AS kind, title, ad.date, {lone('start', 'end', W_START)} AS start_min, {lone('end', 'start', W_END)} AS end_min, location, {W_START} IS NULL AS start_inf
      FROM dj JOIN ad USING (doc_id, row_no) JOIN dcol ON dcol.doc_id = dj.doc_id AND ad.col = date_col LEFT JOIN ct ON ct.doc_id = dj.doc_id AND ct.row_no = dj.row_no AND ct.col = tcol
      WHERE ad.date IS NOT NULL AND length(title) >= 3 AND {C.letters('title')} >= 3 AND {C.letters('title')} * 2 >= {C.solid('title')} AND {C.header_role('title')} = 'Subject'),
    af AS (SELECT doc_id, answer, min_by('field-' || row_no || '-' || col, row(row_no, col)) AS entry_id, title, date, start_min FROM (
        SELECT ad.doc_id, ad.answer, ad.row_no, ad.col, CASE WHEN subject IS NULL THEN '' ELSE subject || ' · ' END || upper(substr(field, 1, 1)) || substr(field, 2) AS title, date, {lone('start', 'end', W_START)} AS start_min
        FROM ad JOIN (SELECT doc_id, row_no FROM dc JOIN hd USING (doc_id) JOIN nw USING (doc_id) WHERE row_no > header GROUP BY doc_id, row_no, width HAVING count(*) * 2 >= width) USING (doc_id, row_no)
        JOIN fl USING (doc_id, col) LEFT JOIN sb USING (doc_id) LEFT JOIN ct USING (doc_id, row_no, col) WHERE date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ar WHERE ar.doc_id = ad.doc_id AND ar.answer = ad.answer)) GROUP BY doc_id, answer, title, date, start_min),
    ap AS (SELECT f.doc_id, f.line_no, answer, CASE WHEN e1 IS NULL OR e2 IS NULL THEN coalesce(e1, e2) WHEN coalesce(uo, o) = 'DayFirst' THEN e1 WHEN coalesce(uo, o) = 'MonthFirst' THEN e2 END AS date
      FROM (SELECT fst.*, uo, answer, {C.as_date('day1', 'month1', 'coalesce(year, ay)')} AS e1, {C.as_date('day2', 'month2', 'coalesce(year, ay)')} AS e2 FROM fst JOIN an USING (doc_id)) f LEFT JOIN sib USING (doc_id)),
    ax AS (SELECT ap.doc_id, answer, line_no, kind, title, origin, date, CASE WHEN lt.doc_id IS NULL THEN borrowed ELSE start_min END AS start_min, end_min, lt.doc_id IS NULL OR inf AS start_inf
      FROM ap JOIN ttl USING ({AT}) JOIN pk USING (doc_id) LEFT JOIN lt USING ({AT}) LEFT JOIN bw USING (doc_id) WHERE date IS NOT NULL AND title IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY doc_id, answer, CASE WHEN origin = 'heading' THEN 'prose-' || line_no ELSE title END, date, CASE WHEN lt.doc_id IS NULL THEN borrowed ELSE start_min END ORDER BY line_no) = 1),
    ae AS (SELECT * EXCLUDE (k) FROM (
        SELECT doc_id, answer, entry_id, kind, title, date, start_min, end_min, location, {DATED_LEVELS}, 1 AS k FROM ar
        UNION ALL SELECT doc_id, answer, entry_id, 'Event', title, date, start_min, NULL, NULL, 'High', 'High', CASE WHEN start_min IS NULL THEN 'Missing' ELSE 'High' END, 'Missing', 'Missing', 1 FROM af
        UNION ALL SELECT doc_id, answer, 'prose-' || line_no, kind, title, date, start_min, end_min, NULL, {PROSE_LEVELS}, 'Missing', 2 FROM ax) QUALIFY k = min(k) OVER (PARTITION BY doc_id, answer))"""


def answered(spark, sf_dir):
    """Entries of tables and lines under every answer, and what their documents ask."""
    cells = written(rendered(spark, sf_dir, "dated_cells"), "cells")
    lines = written(rendered(spark, sf_dir, "labelled").withColumn("doc_id", F.col("doc_id") + 1_000_000_000), "lines")
    return S.answered_readings(cells, written(S.dated_layout(cells), "layout"), lines, YEARS)


GROUPS = """SELECT o_custkey AS doc_id, 'g' || CAST(o_orderkey AS STRING) AS group_id, o_orderkey AS part, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 40 AS INT) END AS page,
    CASE WHEN o_custkey % 5 = 0 THEN 'Plan ' || CAST(o_orderkey AS STRING) ELSE 'Plan ' || o_orderpriority END AS label, CAST(o_orderkey % 4 AS INT) AS size FROM {orders}"""


@query(
    "distinguish_groups",
    f"""WITH g AS ({GROUPS.format(orders='orders')}), n AS (SELECT doc_id, count(*) AS n, count(DISTINCT label) AS d FROM g GROUP BY 1)
    SELECT doc_id, part, CASE WHEN n >= 2 AND d < n THEN label || ' · ' || CASE WHEN page IS NULL THEN 'part ' || (part + 1) ELSE 'page ' || (page + 1) END ELSE label END AS label FROM g JOIN n USING (doc_id)""",
)
def distinguish_groups(spark, sf_dir):
    groups = spark.sql(GROUPS.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    return S.distinguish(groups).select("doc_id", "part", "label")


@query(
    "which_schedule",
    f"""WITH g AS ({GROUPS.format(orders='orders')}), a AS (SELECT doc_id, 'g' || max(part) AS selected FROM g WHERE doc_id % 4 = 0 GROUP BY 1),
    c AS (SELECT doc_id, group_id AS selected FROM g JOIN a USING (doc_id) WHERE group_id = selected), o AS (SELECT doc_id, count(*) AS offers, min_by(group_id, part) AS sole FROM g WHERE size > 0 GROUP BY 1)
    SELECT doc_id, coalesce(offers, 0) AS offers, c.selected IS NULL AND coalesce(offers, 0) > 1 AS asks, coalesce(c.selected, CASE WHEN offers = 1 THEN sole END) AS builds FROM o FULL JOIN c USING (doc_id)""",
)
def which_schedule(spark, sf_dir):
    groups = spark.sql(GROUPS.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    answers = groups.where("doc_id % 4 = 0").groupBy("doc_id").agg(F.expr("concat('g', max(part))").alias("selected"))
    return S.which_schedule(groups, answers)


