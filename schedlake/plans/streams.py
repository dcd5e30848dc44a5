"""Streaming queries: tables replayed from files in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import store
from schedlake.plans import calendars
from schedlake.plans.registry import query
from schedlake.session import shared_folder, written
from schedlake.sources.ledger import write_results
from schedlake.sources.rendered import duck, rendered
from schedlake.streaming import jobs as J


def replay(df, spark, name: str, batches: int = 4):
    """The rows as a file stream: the files of each ``step`` written after those of the one before.

    What the rows are made from is read once, in as many tasks as it has splits; only the rows themselves go into four files a step.
    """
    path, rows = shared_folder(spark, name), written(df, f"{name}-rows")
    for step in range(batches):
        rows.where(f"pmod(step, {batches}) = {step}").drop("step").coalesce(4).write.mode("append").parquet(f"{path}/{step}")
    return spark.readStream.schema(df.drop("step").schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/*")


SEEN = "epoch_us(ts) // 1000"


@query(
    "stream_reminders",
    f"""WITH e AS (SELECT event_id AS id, {SEEN} AS seen, {SEEN} + event_id % 5000 * 60000 + 1 AS due FROM events) SELECT id, due AS due_ms FROM e WHERE due <= (SELECT max(seen) FROM e)""",
)
def stream_reminders(spark, sf_dir):
    seen = "unix_date(CAST(ts AS DATE)) * 86400000L + CAST(hour(ts) * 3600000L + minute(ts) * 60000L + CAST(extract(SECOND FROM ts) * 1000 AS BIGINT) AS BIGINT)"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS id", f"{seen} AS seen_ms", "day(ts) AS d"
    ).selectExpr("id", "seen_ms + id % 5000 * 60000L + 1 AS due_ms", "seen_ms", "CAST(floor((d - 1) / 8) AS INT) AS step")
    folder = shared_folder(spark, "reminders")
    J.fire_reminders(replay(events, spark, "reminder-stream"), folder)()
    return spark.read.schema("id BIGINT, due_ms BIGINT").parquet(f"{folder}/out/batch=*")


@query(
    "stream_replan",
    f"WITH {calendars.plan_sql(calendars.NOW + 2 * calendars.DAY)} SELECT id, due_ms FROM plan",
)
def stream_replan(spark, sf_dir):
    changes = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(
        f"{calendars.NOW}L + CAST(n_nationkey % 3 AS BIGINT) * {calendars.DAY}L AS now_ms", "CAST(n_nationkey % 3 AS INT) AS step"
    )
    folder = shared_folder(spark, "replan")
    J.replan(replay(changes, spark, "clock-stream", 3), lambda now: calendars.plan(spark, sf_dir, now), folder)()
    return J.current_plan(spark, folder)


@query("stream_dedupe", f"SELECT DISTINCT sha256(content)[1:16] AS hash FROM ({duck('file_bytes')}) f")
def stream_dedupe(spark, sf_dir):
    files = rendered(spark, sf_dir, "file_bytes").selectExpr(
        "substring(sha2(content, 256), 1, 16) AS hash", "CAST(doc_id % 4 AS INT) AS step"
    )
    again = files.selectExpr("hash", "3 AS step")  # everything comes once more
    folder = shared_folder(spark, "imports")
    J.first_imports(replay(files.unionByName(again), spark, "document-stream"), folder)()
    return spark.read.schema("hash STRING").parquet(f"{folder}/out/batch=*/range=*")


IMPORT_ROW = "import_id STRING, started_at BIGINT, state STRING, committed_count INT, seq INT"
# one import in three changes its state; the change may arrive before the import does
LIVE_IMPORTS = f"""live AS (SELECT import_id, started_at, CASE WHEN committed_count % 3 = 0 THEN 'Reverted' ELSE state END AS state, CASE WHEN committed_count % 3 = 0 THEN 0 ELSE committed_count END AS committed_count FROM ({duck('imports')}) i)"""


def live_imports(spark, sf_dir):
    rows = rendered(spark, sf_dir, "imports")
    first = rows.selectExpr("import_id", "started_at", "state", "committed_count", "1 AS seq", "CAST(started_at % 4 AS INT) AS step")
    later = rows.where("committed_count % 3 = 0").selectExpr(
        "import_id", "started_at", "'Reverted' AS state", "0 AS committed_count", "2 AS seq", "CAST(started_at div 4 % 4 AS INT) AS step"
    )
    folder = shared_folder(spark, "history")
    J.keep_newest(replay(first.unionByName(later), spark, "import-stream"), IMPORT_ROW, ["import_id"], "seq", folder)()
    return J.live(spark, IMPORT_ROW, ["import_id"], folder)


@query("stream_history", f"WITH {LIVE_IMPORTS} SELECT state, count(*) AS imports, max(started_at) AS newest FROM live GROUP BY state")
def stream_history(spark, sf_dir):
    return live_imports(spark, sf_dir).groupBy("state").agg(F.count("*").alias("imports"), F.max("started_at").alias("newest"))


@query("stream_newest", f"WITH {LIVE_IMPORTS} SELECT * FROM live ORDER BY started_at DESC LIMIT 50")
def stream_newest(spark, sf_dir):
    """The newest imports as the live table has them."""
    return live_imports(spark, sf_dir).drop("seq").orderBy(F.desc("started_at")).limit(50)


SLOT_ROW = "timetable_id STRING, entry_id STRING, weekday INT, start_minute INT, title STRING, seq INT"


@query(
    "stream_week",
    f"""WITH l AS (SELECT timetable_id, entry_id, CASE WHEN start_minute % 180 = 0 THEN weekday % 5 + 1 ELSE weekday END AS weekday, start_minute, title FROM ({duck('slots')}) s)
    SELECT timetable_id, entry_id, weekday, title, row_number() OVER (PARTITION BY timetable_id ORDER BY weekday, start_minute, entry_id) AS position FROM l""",
)
def stream_week(spark, sf_dir):
    """Slots of every week in order, as they stand after moves that arrived as a stream."""
    rows = rendered(spark, sf_dir, "slots").selectExpr("timetable_id", "entry_id", "CAST(weekday AS INT) AS weekday", "CAST(start_minute AS INT) AS start_minute", "title")
    first = rows.selectExpr("*", "1 AS seq", "CAST(weekday % 3 AS INT) AS step")
    moved = rows.where("start_minute % 180 = 0").withColumns({"weekday": F.expr("weekday % 5 + 1"), "seq": F.lit(2), "step": F.expr("CAST(start_minute div 180 % 4 AS INT)")})
    folder = shared_folder(spark, "week")
    keys = ["timetable_id", "entry_id"]
    J.keep_newest(replay(first.unionByName(moved), spark, "slot-stream"), SLOT_ROW, keys, "seq", folder)()
    return store.week_view(J.live(spark, SLOT_ROW, keys, folder)).select("timetable_id", "entry_id", "weekday", "title", "position")


# ---- sinks ----


def _twice(first, second, spark, name: str, keys: list[str]):
    """Two versions of a result table, the first run again after the second: what a reader sees."""
    path = shared_folder(spark, name)
    write_results(first, path, keys, "first", 1)
    write_results(second, path, keys, "second", 2)
    return write_results(first, path, keys, "first", 1)


@query("sink_imports", f"WITH {LIVE_IMPORTS} SELECT * FROM live")
def sink_imports(spark, sf_dir):
    """Imports as stored: state changes replace their rows, and the first run may come again."""
    rows = rendered(spark, sf_dir, "imports").select("import_id", "started_at", "state", "committed_count")
    changed = rows.where("committed_count % 3 = 0").withColumns({"state": F.lit("Reverted"), "committed_count": F.lit(0)})
    return _twice(rows, changed, spark, "sink-imports", ["import_id"])


@query(
    "sink_reminders",
    f"""WITH a AS (WITH {calendars.plan_sql(calendars.NOW)} SELECT id, due_ms FROM plan), b AS (WITH {calendars.plan_sql(calendars.NOW + calendars.DAY)} SELECT id, due_ms FROM plan)
    SELECT id, due_ms FROM a UNION SELECT id, due_ms FROM b""",
)
def sink_reminders(spark, sf_dir):
    """Two horizons of the reminder plan, upserted by id."""
    first, second = (calendars.plan(spark, sf_dir, now).select("id", "due_ms") for now in (calendars.NOW, calendars.NOW + calendars.DAY))
    return _twice(first, second, spark, "sink-reminders", ["id"])


@query("sink_events", f"SELECT entry_id, calendar_id, CASE WHEN pos % 5 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN pos % 5 = 0 THEN start_ms + 3600000 ELSE start_ms END AS start_ms FROM ({duck('planned')}) p")
def sink_events(spark, sf_dir):
    """Calendar events by entry; what an edit moved replaces what was written first."""
    rows = rendered(spark, sf_dir, "planned").select("entry_id", "calendar_id", "title", "start_ms", "pos")
    moved = rows.where("pos % 5 = 0").withColumns({"title": F.upper("title"), "start_ms": F.col("start_ms") + 3_600_000})
    return _twice(rows.drop("pos"), moved.drop("pos"), spark, "sink-events", ["entry_id"])


@query("sink_timetables", f"SELECT timetable_id, entry_id, weekday, start_minute, CASE WHEN weekday = 2 THEN 'Moved ' || title ELSE title END AS title FROM ({duck('slots')}) s")
def sink_timetables(spark, sf_dir):
    """Timetable slots by timetable and entry."""
    rows = rendered(spark, sf_dir, "slots").select("timetable_id", "entry_id", "weekday", "start_minute", "title")
    moved = rows.where("weekday = 2").withColumn("title", F.concat(F.lit("Moved "), "title"))
    return _twice(rows, moved, spark, "sink-timetables", ["timetable_id", "entry_id"])
