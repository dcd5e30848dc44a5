"""Token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.functions import dates as D
from schedlake.functions import vocabulary as V
from schedlake.operators import tokens as K
from schedlake.plans import checking as C
from schedlake.plans.registry import query
from schedlake.sources.rendered import duck, rendered

KEYS = ["doc_id", "line_no"]
TOKEN_COLUMNS = [
    "family", "n_readings", "day1", "month1", "day2", "month2", "year", "weekday", "invalid_reason", "proven_order",
]


@query(
    "date_matches",
    f"""WITH RECURSIVE src AS ({duck('date_lines')}), {C.date_tokens('src', 'doc_id, line_no')}
    SELECT doc_id, line_no, st AS start, raw, {', '.join(TOKEN_COLUMNS)} FROM t_read""",
)
def date_matches(spark, sf_dir):
    out = K.date_tokens(rendered(spark, sf_dir, "date_lines"), KEYS)
    return out.select(*KEYS, "start", "raw", *TOKEN_COLUMNS)


@query(
    "date_overlaps",
    f"""WITH RECURSIVE src AS ({duck('date_lines')}), {C.date_tokens('src', 'doc_id, line_no')}
    SELECT doc_id, line_no, CAST(count(*) AS INT) AS found, CAST(count(*) FILTER (keep) AS INT) AS kept,
           string_agg(raw, '|' ORDER BY st) FILTER (keep) AS kept_raw FROM t_full GROUP BY doc_id, line_no""",
)
def date_overlaps(spark, sf_dir):
    return K.overlap_report(rendered(spark, sf_dir, "date_lines"), KEYS)


@query(
    "date_validity",
    f"""WITH RECURSIVE src AS ({duck('date_lines')}), {C.date_tokens('src', 'doc_id, line_no')}
    SELECT family, n_readings, coalesce(invalid_reason, '') AS reason, count(*) AS n FROM t_read WHERE family <> 4 GROUP BY ALL""",
)
def date_validity(spark, sf_dir):
    tokens = K.date_tokens(rendered(spark, sf_dir, "date_lines"), KEYS).where(F.col("family") != D.WEEKDAY)
    return tokens.groupBy("family", "n_readings", F.coalesce("invalid_reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("n")
    )


@query(
    "year_window",
    """SELECT o_orderkey AS order_key, two AS written,
         CAST(CASE WHEN length(two) = 4 THEN CAST(two AS INT) WHEN CAST(two AS INT) > 76 THEN 1900 + CAST(two AS INT) ELSE 2000 + CAST(two AS INT) END AS INT) AS year
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN CAST(year(o_orderdate) AS VARCHAR)
                    ELSE lpad(CAST((year(o_orderdate) + o_orderkey) % 100 AS VARCHAR), 2, '0') END AS two FROM orders)""",
)
def year_window(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    year = F.year("o_orderdate")
    written = F.when(F.col("o_orderkey") % 9 == 0, year.cast("string")).otherwise(
        F.lpad(((year + F.col("o_orderkey")) % 100).cast("string"), 2, "0")
    )
    return orders.select(F.col("o_orderkey").alias("order_key"), written.alias("written")).withColumn(
        "year", F.expr(D.full_year("written"))
    )


TIME_COLUMNS = [
    "start_hour", "start_minute", "start_mer", "start_padded", "end_hour", "end_minute", "end_mer", "end_padded",
]


@query(
    "time_matches",
    f"""WITH src AS ({duck('labelled')} UNION ALL SELECT doc_id, col * 100 + row_no, text FROM ({duck('time_cols')}) t),
    {C.time_tokens('src', 'doc_id, line_no')}
    SELECT doc_id, line_no, st AS start, trim(raw) AS raw, is_range, {', '.join(TIME_COLUMNS)} FROM c_read""",
)
def time_matches(spark, sf_dir):
    columns = rendered(spark, sf_dir, "time_cols").select(
        "doc_id", (F.col("col") * 100 + F.col("row_no")).alias("line_no"), "text"
    )
    lines = rendered(spark, sf_dir, "labelled").unionByName(columns)
    return K.time_tokens(lines, KEYS).select(*KEYS, "start", "raw", "is_range", *TIME_COLUMNS)


@query(
    "column_roles",
    f"""WITH RECURSIVE src AS (SELECT doc_id, sheet, row_no, col, trim(text) AS text FROM (
          SELECT * FROM ({duck('sheet_cells')}) a UNION ALL SELECT * FROM ({duck('dated_cells')}) b) u WHERE trim(text) <> ''),
    {C.date_tokens('src', 'doc_id, sheet, row_no, col')}, {C.time_tokens('src', 'doc_id, sheet, row_no, col')},
    dated AS (SELECT DISTINCT doc_id, sheet, row_no, col FROM t_read WHERE n_readings > 0),
    timed AS (SELECT DISTINCT doc_id, sheet, row_no, col FROM c_read),
    n AS (SELECT doc_id, sheet, col, count(*) AS n, count(*) FILTER (regexp_matches(text, '{V.WEEKDAY_NAME}')) AS weekdays,
        count(*) FILTER ((doc_id, sheet, row_no, col) IN (SELECT (doc_id, sheet, row_no, col) FROM timed)) AS times,
        count(*) FILTER ((doc_id, sheet, row_no, col) IN (SELECT (doc_id, sheet, row_no, col) FROM dated)) AS dates,
        count(*) FILTER ({C.room_score('text')} > 0) AS rooms,
        count(*) FILTER (regexp_matches(text, '{V.INSTRUCTOR_PREFIX}')) AS people FROM src GROUP BY doc_id, sheet, col),
    nn AS (SELECT doc_id, sheet, col, coalesce(n, 0) AS n, coalesce(weekdays, 0) AS weekdays, coalesce(times, 0) AS times, coalesce(dates, 0) AS dates, coalesce(rooms, 0) AS rooms, coalesce(people, 0) AS people
      FROM (SELECT doc_id, sheet, CAST(unnest(range(0, max(col) + 1)) AS INT) AS col FROM src GROUP BY doc_id, sheet) LEFT JOIN n USING (doc_id, sheet, col))
    SELECT *, CASE WHEN n = 0 THEN 'Unknown' WHEN weekdays / n >= 0.6 THEN 'Weekday' WHEN times / n >= 0.6 THEN 'Time' WHEN dates / n >= 0.6 THEN 'Date'
        WHEN rooms / n >= 0.6 THEN 'Location' WHEN people / n >= 0.6 THEN 'Instructor' ELSE 'Subject' END AS role FROM nn""",
)
def column_roles(spark, sf_dir):
    cells = rendered(spark, sf_dir, "sheet_cells").unionByName(rendered(spark, sf_dir, "dated_cells"))
    return K.column_roles(cells, ["doc_id", "sheet", "col"])


ROOM_TEXT = """SELECT p_partkey AS part_key, CASE CAST(p_partkey % 9 AS INT)
    WHEN 0 THEN 'K' || CAST(p_size AS STRING) WHEN 1 THEN 'Room ' || CAST(p_size AS STRING) WHEN 2 THEN p_name
    WHEN 3 THEN 'AB' || CAST(p_size AS STRING) || '-C' || CAST(p_size AS STRING) WHEN 4 THEN CAST(p_size AS STRING) || '-B'
    WHEN 5 THEN 'Hall' || p_brand WHEN 6 THEN ' lt. ' || CAST(p_size AS STRING) WHEN 7 THEN CAST(p_partkey AS STRING)
    ELSE 'a very long text with Room ' || CAST(p_size AS STRING) END AS text FROM {part}"""


@query(
    "room_score",
    f"SELECT part_key, text, CAST({C.room_score('trim(text)')} AS INT) AS score FROM ({ROOM_TEXT.format(part='part')})",
)
def room_score(spark, sf_dir):
    texts = spark.sql(ROOM_TEXT.format(part=f"parquet.`{sf_dir}/part.parquet`"))
    return texts.withColumn("score", K.room_score(F.col("text")))


@query(
    "subject_split",
    f"""WITH src AS (SELECT doc_id, row_no, col, text FROM ({duck('sheet_cells')}) a WHERE col > 0 AND row_no > 0),
    parts AS (SELECT doc_id, row_no, col, i, regexp_replace(trim(p[i]), '^[()\\[\\]\\-,]+|[()\\[\\]\\-,]+$', '', 'g') AS part FROM (
      SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, string_split_regex(text, '{V.SUBJECT_SPLITTERS}') AS p FROM src))),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, row_no, col ORDER BY i) AS pos FROM parts WHERE part <> ''),
    loc AS (SELECT doc_id, row_no, col, max_by(part, {C.room_score('part')} * 10 + pos) AS location FROM kept WHERE {C.room_score('part')} > 0 GROUP BY ALL),
    per AS (SELECT k.*, l.location FROM kept k LEFT JOIN loc l USING (doc_id, row_no, col)),
    ins AS (SELECT doc_id, row_no, col, min_by(part, pos) AS instructor FROM per
            WHERE part IS DISTINCT FROM location AND regexp_matches(part, '{V.INSTRUCTOR_PREFIX}') GROUP BY ALL)
    SELECT doc_id, row_no, col, min_by(part, pos) FILTER (part IS DISTINCT FROM location AND part IS DISTINCT FROM instructor) AS subject,
       CASE WHEN count(*) FILTER (part IS DISTINCT FROM location AND part IS DISTINCT FROM instructor) > 0 THEN any_value(location) END AS location,
       CASE WHEN count(*) FILTER (part IS DISTINCT FROM location AND part IS DISTINCT FROM instructor) > 0 THEN any_value(instructor) END AS instructor
    FROM per LEFT JOIN ins USING (doc_id, row_no, col) GROUP BY ALL""",
)
def subject_split(spark, sf_dir):
    cells = rendered(spark, sf_dir, "sheet_cells").where("col > 0 AND row_no > 0")
    return K.subject_parts(cells).select("doc_id", "row_no", "col", "subject", "location", "instructor")


LABEL_ROLE = f"""CASE WHEN {C.any_of('name', V.TIME_LABELS, "({t} = '{w}' OR {t} LIKE '% {w}')")} THEN 'Time'
    WHEN {C.any_of('name', V.DATE_LABELS)} THEN 'When' WHEN name IN ({C.LIST(V.SUBJECT_LABELS)}) THEN 'Subject'
    WHEN name IN ({C.LIST(V.WHERE_LABELS)}) THEN 'Where' END"""
LABELLED = f"""SELECT doc_id, line_no, label, value, role FROM (SELECT *, {LABEL_ROLE} AS role FROM (
      SELECT *, regexp_replace(lower(label), '^[ \\t*().,\\-#]+|[ \\t*().,\\-#]+$', '', 'g') AS name FROM (
        SELECT doc_id, line_no, text, trim(substr(text, 1, pos - 1)) AS label, trim(regexp_replace(substr(text, pos), '^(\\s*[:：]\\s*|\\s+[–—]\\s+)', '')) AS value FROM (
          SELECT *, instr(text, regexp_extract(text, '{V.FIELD_SEPARATOR}')) AS pos FROM ({duck('labelled')}) l
          WHERE regexp_matches(text, '{V.FIELD_SEPARATOR}')))) x) y
    WHERE role IS NOT NULL AND label <> '' AND length(label) <= 34 AND value <> ''"""


@query("labelled_fields", LABELLED)
def labelled_fields(spark, sf_dir):
    return K.labelled_fields(rendered(spark, sf_dir, "labelled")).select(*KEYS, "label", "value", "role")


KINDS = f"""SELECT doc_id, CASE min(CASE WHEN {C.any_of('lower(text)', V.TRAVEL_CUES)} THEN 1 WHEN {C.any_of('lower(text)', V.APPOINTMENT_CUES)} THEN 2
        WHEN {C.any_of('lower(text)', V.DEADLINE_CUES)} THEN 3 WHEN {C.any_of('lower(text)', V.EVENT_CUES)} THEN 4 ELSE 5 END)
        WHEN 1 THEN 'Travel' WHEN 2 THEN 'Appointment' WHEN 3 THEN 'Deadline' WHEN 4 THEN 'Event' ELSE 'Unknown' END AS kind
    FROM (SELECT doc_id, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) || ' ', '') || text AS text FROM ({duck('labelled')}) l) l GROUP BY doc_id"""


@query("document_kind", KINDS)
def document_kind(spark, sf_dir):
    return K.document_kind(rendered(spark, sf_dir, "labelled"), ["doc_id"])


TITLE_TEXT = """SELECT o_orderkey AS order_key, CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN 'Last date for payment is on the'
    WHEN 1 THEN 'The order ' || o_orderpriority WHEN 2 THEN '28,000 payable' WHEN 3 THEN '(Viva voce) at' WHEN 4 THEN ': Mid-term review — from '
    WHEN 5 THEN 'AB' WHEN 6 THEN 'Order ' || CAST(o_totalprice AS STRING) WHEN 7 THEN 'Note: ' || o_orderpriority
    WHEN 8 THEN 'A' WHEN 9 THEN 'Order ' || o_orderpriority || ' for the customer who asked for it before'
    ELSE 'Order ' || CAST(o_orderkey AS STRING) || ' will be' END AS text FROM {orders}"""
TITLE_TRIM = " :\\-–—,.()|\\t"
TRIMMED = f"trim(regexp_replace(text, '^[{TITLE_TRIM}]+|[{TITLE_TRIM}]+$', '', 'g'))"
DANGLING = f"regexp_replace({TRIMMED}, '(?i)(?:[{TITLE_TRIM}]* [{TITLE_TRIM}]*(?:{'|'.join(V.DANGLING_WORDS)}))+$', '')"
NAMES = f"""(length(x) BETWEEN 3 AND 46 AND {C.letters('x')} >= 3 AND {C.letters('x')} * 2 >= {C.solid('x')}
    AND regexp_replace(lower(split_part(x, ' ', 1)), '^[{TITLE_TRIM}]+|[{TITLE_TRIM}]+$', '', 'g') NOT IN ({C.LIST(V.NARRATION_OPENERS)})
    AND regexp_matches(x, '^\\p{{L}}'))"""


@query(
    "title_filter",
    f"SELECT order_key, x AS text, {NAMES} AS names FROM (SELECT order_key, text AS x FROM ({TITLE_TEXT.format(orders='orders')}))",
)
def title_filter(spark, sf_dir):
    texts = spark.sql(TITLE_TEXT.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    return texts.withColumn("names", K.names_something(F.col("text")))


@query(
    "title_trim",
    f"""WITH RECURSIVE w AS (SELECT order_key, text, {TRIMMED} AS title, 0 AS n FROM ({TITLE_TEXT.format(orders='orders')})
      UNION ALL SELECT order_key, text, trim(regexp_replace(regexp_extract(title, '^(.*) [^ ]*$', 1), '^[{TITLE_TRIM}]+|[{TITLE_TRIM}]+$', '', 'g')), n + 1 FROM w
      WHERE regexp_replace(lower(regexp_extract(title, ' ([^ ]*)$', 1)), '^[{TITLE_TRIM}]+|[{TITLE_TRIM}]+$', '', 'g') IN ({C.LIST(V.DANGLING_WORDS)}))
    SELECT order_key, any_value(text) AS text, max_by(title, n) AS title FROM w GROUP BY order_key""",
)
def title_trim(spark, sf_dir):
    texts = spark.sql(TITLE_TEXT.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    return texts.withColumn("title", K.trim_title(F.col("text")))


@query(
    "header_roles",
    f"""SELECT doc_id, col, text, {C.header_role('text')} AS role FROM ({duck('dated_cells')}) c WHERE row_no = 2""",
)
def header_roles(spark, sf_dir):
    header = rendered(spark, sf_dir, "dated_cells").where("row_no = 2")
    return header.select("doc_id", "col", "text", K.header_role(F.col("text")).alias("role"))


UNGLUED = "text"
for _w in V.GLUED_WORDS:
    UNGLUED = f"regexp_replace({UNGLUED}, '(?i)([a-z])({_w})\\b', '\\1 \\2', 'g')"


@query(
    "unglue",
    f"""SELECT doc_id, row_no, col, regexp_replace(text, '(\\d{{4}})(\\d{{1,2}}:\\d{{2}})', '\\1 \\2', 'g') AS plain,
         trim(regexp_replace({UNGLUED}, '\\s+', ' ', 'g')) AS heading FROM ({duck('dated_cells')}) c""",
)
def unglue(spark, sf_dir):
    cells = rendered(spark, sf_dir, "dated_cells")
    text = F.col("text")
    return cells.select(
        "doc_id", "row_no", "col", K.unglue(text).alias("plain"), K.split_heading(text).alias("heading")
    )


KEY_SQL = "trim(regexp_replace(lower(trim(regexp_replace({t}, '\\s+', ' ', 'g'))), '[^\\p{{L}}\\p{{Nd}} ]', '', 'g'))"


@query(
    "title_similarity",
    f"""SELECT p_partkey AS part_key, a AS left_key, b AS right_key, round(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0
          ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END, 4) AS similarity FROM (
        SELECT p_partkey, {KEY_SQL.format(t='p_name')} AS a, {KEY_SQL.format(t="CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN upper(p_name) WHEN 1 THEN '--' WHEN 2 THEN replace(p_name, 'e', 'a') || '!' ELSE p_name || '  x' END")} AS b
        FROM part)""",
)
def title_similarity(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    other = (
        F.when(kind == 0, F.upper(name))
        .when(kind == 1, "--")
        .when(kind == 2, F.concat(F.replace(name, F.lit("e"), F.lit("a")), F.lit("!")))
        .otherwise(F.concat(name, F.lit("  x")))
    )
    keys = part.select(
        F.col("p_partkey").alias("part_key"),
        K.comparison_key(name).alias("left_key"),
        K.comparison_key(other).alias("right_key"),
    )
    return keys.withColumn("similarity", F.round(K.similarity(F.col("left_key"), F.col("right_key")), 4))


@query(
    "cell_refs",
    """WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INT) AS idx FROM lineitem),
    b AS (SELECT *, CASE WHEN idx < 26 THEN chr(65 + idx) WHEN idx < 702 THEN chr(65 + (idx - 26) // 26) || chr(65 + (idx - 26) % 26)
        ELSE chr(65 + (idx - 702) // 676) || chr(65 + (idx - 702) // 26 % 26) || chr(65 + (idx - 702) % 26) END AS letters FROM a)
    SELECT l_orderkey AS order_key, l_linenumber AS line, letters || CAST(l_linenumber AS VARCHAR) AS ref, CAST(l_linenumber - 1 AS INT) AS row_no, idx AS col FROM b""",
)
def cell_refs(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    refs = items.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.concat(K.column_letters(F.col("l_partkey")), F.col("l_linenumber").cast("string")).alias("ref"),
    )
    return refs.withColumns(K.cell_reference(F.col("ref")))
