"""Schedule-shaped inputs rendered from the test tables.

The test tables hold keys and dates but no schedules, so text, cells and boxes
are rendered from them inside each query.  One SQL text serves both engines:
``rendered(spark, sf_dir, name)`` gives the DataFrame and ``duck(name)`` the
same text for the checking side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from schedlake.session import written

MONTHS = "January,February,March,April,May,June,July,August,September,October,November,December"
DAYS = "Monday,Tuesday,Wednesday,Thursday,Friday,Saturday,Sunday"


_SPLITS: dict[str, int] = {}
_ROWS: dict[str, int] = {}
ROWS_A_TASK = 100_000  # of tables whose rows become texts to search: a file of a hundred megabytes holds millions


class SparkText:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> str:
        """The table; one that arrives in fewer splits than there are cores is spread first."""
        path = f"{self.sf_dir}/{name}.parquet"
        cores = self.spark.sparkContext.defaultParallelism
        if path not in _SPLITS:
            _SPLITS[path] = self.spark.read.parquet(path).rdd.getNumPartitions()
        if _SPLITS[path] >= cores:
            return f"parquet.`{path}`"
        return f"(SELECT /*+ REPARTITION({cores}) */ * FROM parquet.`{path}`)"

    def spread(self, name: str) -> str:
        """The table in so many tasks that each has a bounded number of rows, however small the file is."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _ROWS:
            _ROWS[path] = self.spark.read.parquet(path).count()
        tasks = _ROWS[path] // ROWS_A_TASK
        if tasks <= self.spark.sparkContext.defaultParallelism:
            return self.table(name)
        return f"(SELECT /*+ REPARTITION({tasks}) */ * FROM parquet.`{path}`)"

    def plain(self, name: str) -> str:
        """The table as it lies: what is grouped at once need not be spread first."""
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def lessons(self) -> str:
        """The lessons as a written table: sheets are rendered from them many times over."""
        name = f"lessons_{uuid.uuid4().hex}"
        written(self.spark.sql(lessons(self)), "lessons").createOrReplaceTempView(name)
        return name

    def isodow(self, x: str) -> str:
        return f"(weekday({x}) + 1)"

    def each(self, lo: str, hi: str) -> str:
        return f"explode(sequence({lo}, {hi}))"

    def utf8(self, x: str) -> str:
        return f"encode({x}, 'UTF-8')"

    def words(self, source: str, keys: str, text: str, sep: str, out: str, pos: str) -> str:
        return f"SELECT {keys}, posexplode(split({text}, '{sep}')) AS ({pos}, {out}) FROM {source}"


class DuckText:
    def table(self, name: str) -> str:
        return name

    def spread(self, name: str) -> str:
        return name

    def plain(self, name: str) -> str:
        return name

    def lessons(self) -> str:
        return f"({lessons(self)})"

    def isodow(self, x: str) -> str:
        return f"isodow({x})"

    def each(self, lo: str, hi: str) -> str:
        return f"unnest(generate_series({lo}, {hi}))"

    def utf8(self, x: str) -> str:
        return f"encode({x})"

    def words(self, source: str, keys: str, text: str, sep: str, out: str, pos: str) -> str:
        sep = "chr(10)" if sep == "\n" else f"'{sep}'"
        return (
            f"SELECT {keys}, unnest(range(0, len(string_split({text}, {sep})))) AS {pos}, "
            f"unnest(string_split({text}, {sep})) AS {out} FROM {source}"
        )


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def pad(x: str, n: int = 2) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


def idiv(x: str, n: int | str) -> str:
    return f"CAST(floor({x} / {n}) AS BIGINT)"


def order_dates(q, grouped: bool = False) -> str:
    orders = q.plain("orders") if grouped else q.spread("orders")
    return (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, "
        "CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS yy, month(o_orderdate) AS mm, "
        f"day(o_orderdate) AS dd, {q.isodow('o_orderdate')} AS wd FROM {orders}"
    )


def notices(q) -> str:
    """One dated line per order; the style of a document decides how dates are written.

    Two styles never prove their order: their days above 12 are written year first.
    """
    dmy = f"{pad('dd')} || '/' || {pad('mm')} || '/' || {s('yy')}"
    mdy = f"{pad('mm')} || '/' || {pad('dd')} || '/' || {s('yy')}"
    serial = "((CAST(yy AS BIGINT) * 12 + mm) * 31 + dd) * 1000000000 + o_orderkey"
    return f"""
      SELECT o_custkey AS doc_id,
             CASE WHEN o_custkey % 5 = 3 THEN {serial} ELSE o_orderkey END AS line_no,
             'Order ' || {s('o_orderkey')} || ' payment due '
               || CASE WHEN o_custkey % 5 = 4 AND o_custkey % 2 = 0
                       THEN split_part('{DAYS}', ',', CAST(wd AS INT)) || ' ' ELSE '' END
               || CASE WHEN o_custkey % 5 >= 3 AND dd > 12 THEN {s('yy')} || '-' || {pad('mm')} || '-' || {pad('dd')}
                       WHEN o_custkey % 5 = 1 OR (o_custkey % 5 = 2 AND o_orderkey % 2 = 1)
                       THEN {mdy} ELSE {dmy} END AS text,
             d AS true_date, CAST(o_custkey % 5 AS INT) AS style
      FROM ({order_dates(q)}) o"""


def date_lines(q) -> str:
    """Every written form of a date, impossible ones included."""
    month = f"split_part('{MONTHS}', ',', CAST(mm AS INT))"
    day = f"split_part('{DAYS}', ',', CAST(wd AS INT))"
    two = pad("yy % 100")
    return f"""
      SELECT o_custkey AS doc_id, o_orderkey AS line_no, CASE CAST(o_orderkey % 12 AS INT)
        WHEN 0 THEN 'Delivered ' || {s('yy')} || '-' || {pad('mm')} || '-' || {pad('dd')}
        WHEN 1 THEN 'Due ' || {s('dd')} || '/' || {s('mm')} || '/' || {s('yy')} || ' at noon'
        WHEN 2 THEN {pad('mm')} || '-' || {pad('dd')} || '-' || {two} || ' shipped'
        WHEN 3 THEN 'Call on ' || {s('dd')} || CASE WHEN o_orderkey % 24 = 3 THEN chr(10) ELSE ' ' END || {month} || ' ' || {s('yy')}
        WHEN 4 THEN substr({month}, 1, 3) || '. ' || {s('dd')} || 'th, ' || {s('yy')} || ' visit'
        WHEN 5 THEN {s('dd')} || 'th ' || upper(substr({month}, 1, 3))
        WHEN 6 THEN {day} || ' ' || {pad('dd')} || '.' || {pad('mm')} || '.' || {s('yy')}
        WHEN 7 THEN 'Period 31/' || {pad('mm')} || '/' || {s('yy')} || ' closed'
        WHEN 8 THEN 'Lesson ' || {pad('dd')} || '.' || {pad('mm')} || ' every ' || lower(substr({day}, 1, 3))
        WHEN 9 THEN {s('yy')} || '-' || {s('mm + 12')} || '-' || {pad('dd')} || ' or 0/' || {s('mm')} || '/' || {two}
        WHEN 10 THEN 'From ' || {s('dd')} || ' ' || {month} || ' to 29 Feb ' || {s('yy')} || ' / 29/02'
        ELSE {s('dd')} || ' ' || {month} || ' ' || {two} || ' ' || {day} END AS text
      FROM ({order_dates(q)}) o"""


def labelled(q) -> str:
    """Label-value letters: five lines per order, kinds of document by customer."""
    return f"""
      SELECT o_orderkey AS doc_id, CAST(part AS INT) AS line_no, CASE part
        WHEN 0 THEN CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'Subject: Review of order ' || o_orderpriority
                    WHEN 1 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'Date - Time' ELSE 'Flight: SL ' || {s('o_orderkey % 900 + 100')} END
                    WHEN 2 THEN 'Project demo meeting with the team' ELSE 'Annual General Meeting' END
        WHEN 1 THEN CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'Due date: ' WHEN 1 THEN 'Last date for payment : '
                    ELSE 'Viva on ' END || {s('dd')} || ' ' || split_part('{MONTHS}', ',', CAST(mm AS INT)) || ' ' || {s('yy')}
                    || CASE WHEN o_orderkey % 7 = 0 THEN ' at 9:30' ELSE '' END
        WHEN 2 THEN CASE CAST(o_custkey % 2 AS INT) WHEN 0 THEN 'Reporting time: ' ELSE 'Slot: ' END
                    || {s('dd % 12 + 1')} || ':' || {pad('mm * 4')} || CASE WHEN dd > 15 THEN ' PM' ELSE ' am' END
        WHEN 3 THEN 'Venue: Hall ' || {s('o_custkey % 40')} || CASE WHEN o_orderkey % 20 = 3 THEN ' and visit' ELSE '' END
        ELSE CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Please bring this letter with you'
                  WHEN 1 THEN {pad('dd')} || '/' || {pad('mm')} || '/' || {s('yy')} || ' 14:35 closing session'
                  WHEN 2 THEN 'The appointment desk opens on ' || {pad('dd')} || '.' || {pad('mm')} || '.' || {s('yy')}
                  ELSE CASE WHEN o_orderkey % 20 = 3 THEN 'us at the desk' ELSE 'Boarding starts early' END END
        END AS text
      FROM (SELECT o.*, {q.each('0', '4')} AS part FROM ({order_dates(q)}) o) p"""


def time_cols(q) -> str:
    """Columns of clock times: distinct hours per user and day, written four ways."""
    twelve = "((hr + 11) % 12 + 1)"
    return f"""
      SELECT doc_id, col, row_no, CASE CAST(doc_id % 4 AS INT)
          WHEN 0 THEN {s('hr')} || ':' || mi WHEN 1 THEN {pad('hr')} || ':' || mi
          WHEN 2 THEN {s(twelve)} || '.' || mi || CASE WHEN hr < 12 THEN ' a.m.' ELSE ' PM' END
          ELSE {s(twelve)} || ':' || mi || CASE WHEN col % 3 = 0 THEN ' - ' || {s('(hr % 12) + 1')} || ':' || mi ELSE '' END
        END AS text
      FROM (SELECT user_id AS doc_id, CAST(day(ts) AS INT) AS col, CAST(hour(ts) AS INT) AS row_no,
                   hour(ts) AS hr, {pad('min(minute(ts))')} AS mi
            FROM {q.table('events')} GROUP BY user_id, day(ts), hour(ts)) h"""


def lessons(q) -> str:
    """Weekday, hour and subject per user: the most frequent event type of each slot.

    All events count; their hours and days are folded into a school week of five days from eight to six.
    """
    return f"""
      SELECT doc_id, wd, hr, substr(min({pad('1000000 - n', 8)} || event_type), 9) AS subject, min(k) AS k
      FROM (SELECT doc_id, wd, hr, event_type, count(*) AS n, min(k) AS k
            FROM (SELECT user_id AS doc_id, CAST(({q.isodow('ts')} - 1) % 5 + 1 AS INT) AS wd, CAST(hour(ts) % 10 + 8 AS INT) AS hr, event_type,
                         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {q.table('events')}) v
            GROUP BY doc_id, wd, hr, event_type) e
      GROUP BY doc_id, wd, hr"""


def sheet_cells(q) -> str:
    """Weekly sheets in four layouts by doc_id % 4: grid, periods, list, roster."""
    day = f"split_part('{DAYS}', ',', wd)"
    twelve = "((hr + 11) % 12 + 1)"
    slot = (
        f"CASE WHEN doc_id % 8 < 4 THEN {pad('hr')} || ':00-' || {pad('hr + 1')} || ':00' "
        f"ELSE {s(twelve)} || ':00-' || {s('(hr % 12) + 1')} || ':00' END"
    )
    body = f"subject || ' / K' || {s('k')}"
    table = q.lessons()
    return f"""
      SELECT doc_id, 'Week' AS sheet, CAST(row_no AS INT) AS row_no, CAST(col AS INT) AS col, text FROM (
        SELECT doc_id, 0 AS row_no, 0 AS col, CASE WHEN doc_id % 4 = 3 THEN 'Staff' ELSE 'Timetable' END AS text
          FROM {table} a GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, wd, {day} FROM {table} a WHERE doc_id % 4 IN (0, 3) GROUP BY doc_id, wd
        UNION ALL SELECT doc_id, hr - 7, 0, {slot} FROM {table} a WHERE doc_id % 4 = 0 GROUP BY doc_id, hr
        UNION ALL SELECT doc_id, hr - 7, wd, {body} FROM {table} a WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 0, hr - 7, 'P' || {s('hr - 7')} || ' (' || {slot} || ')' || CASE WHEN doc_id % 8 = 5 AND hr % 5 = 2 THEN ' and (' || {slot} || ')' ELSE '' END
          FROM {table} a WHERE doc_id % 4 = 1 GROUP BY doc_id, hr
        UNION ALL SELECT doc_id, wd, 0, {day} FROM {table} a WHERE doc_id % 4 = 1 GROUP BY doc_id, wd
        UNION ALL SELECT doc_id, wd, hr - 7, {body} FROM {table} a WHERE doc_id % 4 = 1
        UNION ALL SELECT doc_id, wd * 20 + hr, part, CASE part WHEN 0 THEN {day} WHEN 1 THEN {slot}
            WHEN 2 THEN subject || CASE WHEN k % 3 = 0 THEN ' (Dr. ' || upper(substr(subject, 1, 1)) || ' Rao)' ELSE '' END ELSE 'Room ' || {s('k')} END
          FROM (SELECT a.*, {q.each('0', '3')} AS part FROM {table} a WHERE doc_id % 4 = 2) l
        UNION ALL SELECT doc_id, hr - 7, 0, 'Worker ' || substr('ABCDEFGHIJ', hr - 7, 1) || 'n'
          FROM {table} a WHERE doc_id % 4 = 3 GROUP BY doc_id, hr
        UNION ALL SELECT doc_id, hr - 7, wd, CASE WHEN k % 5 = 0 THEN 'Off' ELSE
            {pad('k % 9 + 5')} || ':30 - ' || {pad('k % 9 + 10')} || ':00' END
          FROM {table} a WHERE doc_id % 4 = 3
      ) c"""


def section_cells(q) -> str:
    """Several sections per sheet: a period header, then label rows and day rows."""
    table = q.lessons()
    return f"""
      SELECT doc_id, 'Sections' AS sheet, CAST(row_no AS INT) AS row_no, CAST(col AS INT) AS col, text FROM (
        SELECT doc_id % 40 AS doc_id, 1 AS row_no, hr - 7 AS col, {pad('hr')} || ':00-' || {pad('hr + 1')} || ':00' AS text
          FROM {table} a GROUP BY doc_id % 40, hr
        UNION ALL SELECT doc_id, 2 + sec * 7, part, CASE part WHEN 0 THEN 'Section ' || {s('sec')} ELSE 'Hall ' || {s('sec % 9')} END
          FROM (SELECT user_id % 40 AS doc_id, {idiv('user_id', 40)} AS sec, {q.each('0', '1')} AS part
                FROM {q.table('events')} GROUP BY user_id) l
        UNION ALL SELECT doc_id, 2 + sec * 7 + wd, 0, split_part('{DAYS}', ',', wd) FROM
          (SELECT doc_id % 40 AS doc_id, {idiv('doc_id', 40)} AS sec, wd FROM {table} a GROUP BY doc_id, wd) b
        UNION ALL SELECT doc_id % 40, 2 + {idiv('doc_id', 40)} * 7 + wd, hr - 7, subject || ' / K' || {s('k')} FROM {table} a
      ) c"""


def dated_cells(q) -> str:
    """Dated sheets by o_custkey % 4: ISO, month names, numeric, and bills with a record for each order."""
    month = f"split_part('{MONTHS}', ',', CAST(mm AS INT))"
    dmy = f"{pad('CASE WHEN o_custkey % 8 = 6 THEN dd % 12 + 1 ELSE dd END')} || '/' || {pad('mm')} || '/' || {s('yy')}"
    clock = f"{pad('dd % 9 + 8')} || ':' || {pad('mm * 4')}"
    return f"""
      SELECT doc_id, 'Dates' AS sheet, CAST(row_no AS BIGINT) AS row_no, CAST(col AS INT) AS col, text FROM (
        SELECT o_custkey AS doc_id, 0 AS row_no, 0 AS col,
               CASE WHEN o_custkey % 4 = 3 THEN 'Power supply bill - north office' ELSE 'Orders of one customer' END AS text
          FROM ({order_dates(q, grouped=True)}) o GROUP BY o_custkey
        UNION ALL SELECT o_custkey, 2, part, CASE WHEN o_custkey % 4 = 3
              THEN split_part('Ref,Billdate,Due date,Amount', ',', part + 1) ELSE split_part('Order,Date,Reporting time,Venue', ',', part + 1) END
          FROM (SELECT o_custkey, {q.each('0', '3')} AS part FROM ({order_dates(q, grouped=True)}) o GROUP BY o_custkey) h
        UNION ALL SELECT o_custkey, o_orderkey + 3, part, CASE part
              WHEN 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 'INR ' || {s('o_orderkey')} || '9' ELSE 'Order ' || o_orderpriority END
              WHEN 1 THEN CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN {s('d')} WHEN 1 THEN {s('dd')} || ' ' || {month} || CASE WHEN o_custkey % 16 = 9 THEN '' ELSE ' ' || {s('yy')} END ELSE {dmy} END
              WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN {clock} || '-' || {pad('dd % 9 + 10')} || ':00' ELSE {clock} END
              ELSE 'Hall ' || {s('o_custkey % 30')} END
          FROM (SELECT o.*, {q.each('0', '3')} AS part FROM ({order_dates(q)}) o WHERE o_custkey % 4 < 3) b
        UNION ALL SELECT o_custkey, rk + 3, part, CASE part WHEN 0 THEN 'R-' || {s('rk')}
              WHEN 1 THEN {s('yy')} || '-' || {pad('mm')} || '-' || {pad('dd')}
              WHEN 2 THEN {s('dd + CASE WHEN o_custkey % 8 = 7 THEN 0 ELSE 12 END')} || '/' || {pad('mm')} || '/' || {s('yy')} || {clock} ELSE 'INR ' || {s('rk')} END
          FROM (SELECT b.*, {q.each('0', '3')} AS part FROM (
                 SELECT o_custkey, o_orderkey AS rk, yy, mm, dd % 12 + 1 AS dd FROM ({order_dates(q)}) o WHERE o_custkey % 4 = 3) b) c
      ) u"""


def runs(q) -> str:
    """Sheets placed on a page: 20 sheets of one folder share a document."""
    return f"""
      SELECT {idiv('doc_id', 20)} AS doc_id, CAST(doc_id % 20 AS INT) AS page, row_no * 16 + col AS run_id, text,
             CAST(100 * col + row_no % 3 AS DOUBLE) AS l, CAST(20 * row_no AS DOUBLE) AS t,
             CAST(100 * col + row_no % 3 + 6 * length(text) AS DOUBLE) AS r, CAST(20 * row_no + 10 AS DOUBLE) AS b,
             CASE WHEN doc_id % 8 = 4 THEN CAST(50 + (row_no * 7 + col * 11) % 50 AS DOUBLE) / 100 END AS conf,
             CASE WHEN doc_id % 8 = 4 THEN 'Ocr' ELSE 'PdfTextLayer' END AS origin
      FROM ({sheet_cells(q)}) s"""


def doc_lines(q) -> str:
    return q.words(q.table("documents"), "doc_id", "text", "\n", "text", "line_no")


def word_boxes(q) -> str:
    words = q.words(f"({doc_lines(q)}) x", "doc_id, line_no", "text", " ", "text", "pos")
    return f"""
      SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(pos AS INT) AS pos, text,
             CAST(50 * pos + 40 * floor(pos / 5) AS DOUBLE) AS l, CAST(20 * line_no AS DOUBLE) AS t,
             CAST(50 * pos + 40 * floor(pos / 5) + 46 AS DOUBLE) AS r,
             CAST(20 * line_no + CASE WHEN pos % 17 = 16 THEN 100 ELSE 10 END AS DOUBLE) AS b,
             CAST((doc_id * 31 + pos) % 100 AS DOUBLE) / 100 AS conf
      FROM ({words}) w WHERE length(trim(text)) > 0"""


def delim_lines(q) -> str:
    """Text lines of delimited files: the delimiter by file, some quoted fields."""
    def row(sep: str) -> str:
        name = f"CASE WHEN p_partkey % 7 = 0 THEN '\"' || p_name || '{sep} \"\"new\"\"\"' ELSE p_name END"
        return f"{s('p_partkey')} || '{sep}' || {name} || '{sep} ' || p_brand || ' {sep}' || {s('p_size')}"
    return f"""
      SELECT p_partkey % 50 AS file_id, p_partkey AS line_no, CASE CAST(p_partkey % 50 % 4 AS INT)
        WHEN 0 THEN {row(',')} WHEN 1 THEN {row(';')} WHEN 2 THEN replace({row('^')}, '^', chr(9)) ELSE {row('|')} END AS text
      FROM {q.table('part')}"""


def entries(q) -> str:
    """Schedule entries with a level per field; which fields are weak or missing follows the key."""
    return f"""
      SELECT 'e' || {s('o_orderkey')} AS entry_id, o_custkey AS doc_id, 'g' || {s('o_custkey')} AS group_id,
        CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'Review ' || o_orderpriority || ' ' || o_orderstatus END AS title,
        CASE WHEN o_orderkey % 41 = 0 THEN 'Missing' WHEN o_orderkey % 19 = 0 THEN 'Low' WHEN o_orderkey % 4 = 1 THEN 'Medium' ELSE 'High' END AS title_level,
        CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 23 = 0 THEN NULL ELSE d END AS date,
        CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 23 = 0 THEN 'Missing' WHEN o_orderkey % 29 = 0 THEN 'Low' ELSE 'High' END AS date_level,
        CASE WHEN o_custkey % 3 = 0 THEN CAST(wd AS INT) END AS weekday,
        CASE WHEN o_custkey % 3 = 0 THEN 'Medium' ELSE 'Missing' END AS weekday_level,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(dd % 14 * 60 + 480 AS INT) END AS start_min,
        CASE WHEN o_orderkey % 7 = 0 THEN 'Missing' WHEN o_orderkey % 31 = 0 THEN 'Low' ELSE 'High' END AS start_level,
        CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN NULL ELSE CAST((dd % 14 * 60 + 480 + mm * 30 - 30) % 1440 AS INT) END AS end_min,
        CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN 'Missing' WHEN o_orderkey % 37 = 0 THEN 'Low' ELSE 'High' END AS end_level,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Hall ' || {s('o_custkey % 30')} END AS location,
        CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 17 = 0 THEN 'Low' ELSE 'High' END ELSE 'Missing' END AS location_level,
        CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Deadline' ELSE 'Event' END AS kind
      FROM ({order_dates(q)}) o"""


def terms(q) -> str:
    """Term bounds a user gave; one document in five has none."""
    return f"""
      SELECT c_custkey AS doc_id, CAST('2026-08-17' AS DATE) AS term_start,
             CASE WHEN c_custkey % 25 = 3 THEN CAST('2026-08-18' AS DATE) ELSE CAST('2026-12-05' AS DATE) END AS term_end
      FROM {q.table('customer')} WHERE c_custkey % 5 < 4"""


def recurrences(q) -> str:
    """Weekly rules of one or two days with an end date, some with exceptions, in two zones."""
    return f"""
      SELECT 'r' || {s('p_partkey')} AS entry_id, 'i' || {s('p_partkey % 50')} AS import_id, p_name AS title,
        {s('p_partkey % 7 + 1')} || CASE WHEN p_partkey % 3 = 0 THEN ',' || {s('(p_partkey + 2) % 7 + 1')} ELSE '' END AS days,
        CAST(p_size * 25 % 1440 AS INT) AS start_min, CAST(p_size * 37 AS INT) AS seconds,
        CAST('2026-08-20' AS DATE) + CAST(p_size AS INT) AS until,
        CASE WHEN p_partkey % 4 = 0 THEN '2026-08-' || {s('20 + p_partkey % 9')} || ',2026-09-0' || {s('1 + p_partkey % 7')} ELSE '' END AS exceptions,
        CASE WHEN p_partkey % 2 = 0 THEN 'Asia/Kolkata' ELSE 'Europe/London' END AS zone
      FROM {q.table('part')}"""


def planned(q) -> str:
    """One-off events with a start instant: what gets written to a calendar."""
    return f"""
      SELECT 'e' || {s('o_orderkey')} AS entry_id, 'i' || {s('o_custkey % 100')} AS import_id, CAST(o_custkey % 10 AS INT) AS calendar_id,
        'Order ' || o_orderpriority || ' ' || o_orderstatus AS title, o_orderkey AS pos,
        ((CAST(yy AS BIGINT) * 12 + mm) * 31 + dd) * 86400000 + CAST(dd % 14 * 60 + 480 AS BIGINT) * 60000 AS start_ms,
        CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'Class' WHEN 1 THEN 'Deadline' ELSE 'Appointment' END AS kind
      FROM ({order_dates(q)}) o"""


def calendar(q) -> str:
    """An existing calendar: one order in three, the title untouched, shouted, or misspelt."""
    return f"""
      SELECT pos AS event_id, calendar_id, CASE CAST(pos % 4 AS INT) WHEN 0 THEN title WHEN 1 THEN upper(title) || '!'
          WHEN 2 THEN replace(title, 'r', 'x') ELSE 'Quarterly planning' END AS title,
        start_ms, pos % 15 = 0 AS deleted,
        CASE WHEN pos % 2 = 0 THEN 'schedlake://import/' || import_id || '/' || entry_id END AS app_uri
      FROM ({planned(q)}) p WHERE pos % 3 = 0"""


def edits(q) -> str:
    """Changes a user typed over some entries: new titles, times, or both; some refused."""
    return f"""
      SELECT 'e' || {s('o_orderkey')} AS entry_id,
        CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '  Moved review ' WHEN 1 THEN '   ' END AS new_title,
        CASE WHEN o_orderkey % 3 = 0 THEN d + 1 END AS new_date,
        CASE WHEN o_orderkey % 2 = 0 THEN CAST(dd * 30 AS INT) END AS new_start, CASE WHEN o_orderkey % 2 = 0 THEN CAST(dd * 25 + 60 AS INT) END AS new_end,
        CASE CAST(o_orderkey % 7 AS INT) WHEN 1 THEN ' Hall ' || {s('o_custkey % 30')} WHEN 2 THEN '  ' WHEN 3 THEN 'Hall ' || {s('o_custkey % 30')} END AS new_location,
        o_orderkey % 10 = 1 AND o_orderkey % 4 = 1 AS to_all_day
      FROM ({order_dates(q)}) o WHERE o_orderkey % 5 < 2"""


def slots(q) -> str:
    """Stored timetable slots: one timetable per user, from the lessons."""
    table = q.lessons()
    return f"""
      SELECT 't' || {s('doc_id')} AS timetable_id, 'w' || {s('wd')} || 'h' || {s('hr')} AS entry_id, wd AS weekday,
        hr * 60 AS start_minute, hr * 60 + 50 AS end_minute, subject AS title, 'K' || {s('k')} AS location,
        CASE WHEN k % 2 = 0 THEN 'schedlake://import/i' || {s('doc_id')} || '/w' || {s('wd')} || 'h' || {s('hr')} END AS app_uri,
        k % 5 = 0 AS end_assumed
      FROM {table} a"""


def timetables(q) -> str:
    return f"""
      SELECT 't' || {s('user_id')} AS timetable_id, 'Timetable ' || {s('user_id % 120')} AS label,
        CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'h' || {s('user_id')} || '/g' END AS source_identity,
        CAST(1000000 + user_id * 7919 % 100003 AS BIGINT) AS updated_at, CAST(user_id AS BIGINT) AS created_at
      FROM {q.table('events')} GROUP BY user_id"""


def incoming(q) -> str:
    """Timetables being saved again: same document, same label, or new."""
    return f"""
      SELECT 'n' || {s('user_id')} AS import_id, CASE WHEN user_id % 4 = 2 THEN 'Fresh ' || {s('user_id')} ELSE 'Timetable ' || {s('user_id % 120')} END AS label,
        CASE WHEN user_id % 5 = 0 THEN 'h' || {s('user_id')} || '/g' ELSE 'h' || {s('user_id')} || '/other' END AS source_identity,
        CASE CAST(user_id % 7 AS INT) WHEN 0 THEN 'Merge' WHEN 1 THEN 'Replace' WHEN 2 THEN 'CreateNew' WHEN 3 THEN 'Skip' END AS resolution,
        't' || {s('user_id')} AS like_id
      FROM {q.table('events')} WHERE user_id % 2 = 0 GROUP BY user_id"""


def incoming_slots(q) -> str:
    return f"""
      SELECT 'n' || substr(timetable_id, 2) AS import_id, CASE WHEN start_minute % 120 = 0 THEN entry_id ELSE entry_id || 'x' END AS entry_id,
        weekday, start_minute, end_minute, 'New ' || title AS title, location
      FROM ({slots(q)}) s WHERE weekday < 4"""


def imports(q) -> str:
    return f"""
      SELECT 'i' || {s('o_orderkey')} AS import_id, CAST(o_orderkey * 7919 % 1000003 AS BIGINT) * 1000000 + o_orderkey AS started_at,
        CASE o_orderstatus WHEN 'O' THEN 'Committed' WHEN 'F' THEN 'Reverted' ELSE 'Reviewed' END AS state,
        CAST(o_orderkey % 40 AS INT) AS committed_count, 'i' || {s('o_custkey')} AS batch
      FROM {q.table('orders')}"""


def sources(q) -> str:
    """Provenance rows of candidates: read, derived (with the pages it came from), assumed, typed in."""
    return f"""
      SELECT 'e' || {s('l_orderkey')} AS entry_id, CAST(l_partkey AS BIGINT) * 100000 + l_suppkey * 8 + l_linenumber AS pos,
        split_part('PdfSpan,SheetCell,ImageRegion,Derived,UserProvided,Assumed', ',', CAST((l_partkey + l_linenumber) % 6 + 1 AS INT)) AS kind,
        CAST(l_partkey % 3 AS INT) AS page, CAST(l_partkey % 200 AS DOUBLE) / 8 AS l, CAST(l_suppkey % 50 AS DOUBLE) / 4 AS t,
        CAST(l_partkey % 200 AS DOUBLE) / 8 + CAST(l_quantity AS INT) % 3 AS r, CAST(l_suppkey % 50 AS DOUBLE) / 4 + CAST(l_quantity AS INT) % 3 AS b,
        CASE WHEN l_linenumber % 2 = 0 THEN 'title' ELSE 'startTime' END AS field, l_partkey * 1000 + l_linenumber AS at_ms,
        {s('l_partkey % 3')} || ',' || {s('l_suppkey % 3')} AS from_pages
      FROM {q.table('lineitem')} i"""


def file_bytes(q) -> str:
    """Files of every kind: the document text behind a signature, a BOM, odd bytes, or as delimited lines."""
    flat = "replace(substr(text, 1, 60), chr(10), ' ')"
    lines = " || chr(10) || ".join([flat] * 4)
    plain = q.utf8("text")
    ascii_only = q.utf8("regexp_replace(text, '[^ -~]', '')") if isinstance(q, SparkText) else q.utf8(
        "regexp_replace(text, '[^ -~]', '', 'g')"
    )
    marks = ("255044462D", "504B0304", "89504E47", "FFD8FF", "474946383961", "524946460000000057454250", "0000001866747970")
    arms = " ".join(f"WHEN {i} THEN unhex('{m}') || {plain}" for i, m in enumerate(marks))
    return f"""
      SELECT doc_id, 'lake/' || {s('doc_id')} AS path, CASE WHEN doc_id % 50 = 49 THEN unhex('') ELSE CASE CAST(doc_id % 12 AS INT) {arms}
        WHEN 7 THEN unhex('EFBBBF') || {plain} WHEN 8 THEN {q.utf8(lines)} WHEN 9 THEN unhex('0001') || {plain}
        WHEN 10 THEN unhex('E92080') || {ascii_only} ELSE {plain} END END AS content
      FROM {q.table('documents')}"""


def delim_notes(q) -> str:
    """Delimited lines where some records carry a quoted note over two lines."""
    sep = "CASE CAST(file_id % 4 AS INT) WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END"
    base = delim_lines(q)
    return f"""
      SELECT file_id, line_no * 2 AS line_no, CASE WHEN line_no % 21 = 0 THEN text || {sep} || '"see, the; note | of' ELSE text END AS text FROM ({base}) a
      UNION ALL SELECT file_id, line_no * 2 + 1, 'next line"' FROM ({base}) b WHERE line_no % 21 = 0
      UNION ALL SELECT file_id, line_no * 2 + 1, '' FROM ({base}) b WHERE line_no % 21 = 5"""


INPUTS = {
    f.__name__: f
    for f in (
        notices, date_lines, labelled, time_cols, lessons, sheet_cells, section_cells, dated_cells,
        runs, doc_lines, word_boxes, delim_lines, entries, terms, recurrences, planned, calendar, edits,
        slots, timetables, incoming, incoming_slots, imports, sources, file_bytes, delim_notes,
    )
}


def rendered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(INPUTS[name](SparkText(spark, sf_dir)))


def duck(name: str) -> str:
    return INPUTS[name](DuckText())
