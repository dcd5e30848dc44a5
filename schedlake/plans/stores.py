"""Stored timetable and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import store as S
from schedlake.plans import calendars
from schedlake.plans.registry import query
from schedlake.sources.rendered import duck, rendered

DECIDE = f"""inc AS ({duck('incoming')}), tt AS ({duck('timetables')}),
    same AS (SELECT source_identity, min(timetable_id) AS same_id FROM tt WHERE source_identity IS NOT NULL GROUP BY 1),
    lab AS (SELECT label, min(timetable_id) AS label_id FROM tt GROUP BY 1),
    dec AS (SELECT *, CASE WHEN mode = 'Create' THEN 'new-' || import_id WHEN mode IN ('Merge', 'Replace') THEN coalesce(same_id, label_id) END AS timetable_id FROM (
      SELECT *, CASE WHEN same_id IS NOT NULL THEN 'Replace' WHEN label_id IS NULL THEN 'Create' WHEN resolution IS NULL THEN 'Ask'
        WHEN resolution = 'CreateNew' THEN 'Create' ELSE resolution END AS mode
      FROM inc LEFT JOIN same USING (source_identity) LEFT JOIN lab USING (label)))"""
SEQ = "CAST(substr(import_id, 2) AS BIGINT)"


def decisions(spark, sf_dir):
    return S.save_decisions(rendered(spark, sf_dir, "incoming"), rendered(spark, sf_dir, "timetables"))


@query("timetable_save", f"WITH {DECIDE} SELECT import_id, label, mode, timetable_id FROM dec")
def timetable_save(spark, sf_dir):
    return decisions(spark, sf_dir).select("import_id", "label", "mode", "timetable_id")


# Saves run one after the other in the checking SQL: each row is kept unless a later save removes it.
MERGED = f"""{DECIDE}, sv AS (SELECT *, {SEQ} AS seq FROM dec WHERE mode IN ('Create', 'Merge', 'Replace')),
    allrows AS (SELECT timetable_id, entry_id, weekday, start_minute, end_minute, title, location, app_uri, -1 AS seq FROM ({duck('slots')}) s
      UNION ALL SELECT sv.timetable_id, entry_id, weekday, start_minute, end_minute, title, location, 'schedlake://import/' || import_id || '/' || entry_id, seq
      FROM ({duck('incoming_slots')}) i JOIN sv USING (import_id)),
    after AS (SELECT * FROM allrows a WHERE NOT EXISTS (SELECT 1 FROM sv WHERE sv.timetable_id = a.timetable_id AND sv.mode = 'Replace' AND sv.seq > a.seq)
      AND NOT EXISTS (SELECT 1 FROM allrows b WHERE b.timetable_id = a.timetable_id AND b.entry_id = a.entry_id AND b.seq > a.seq))"""
COLS = "timetable_id, entry_id, weekday, start_minute, end_minute, title, location, app_uri"


def after_saves(spark, sf_dir):
    return S.apply_slots(
        rendered(spark, sf_dir, "slots"), rendered(spark, sf_dir, "incoming_slots"), decisions(spark, sf_dir), SEQ
    )


@query("slot_merge", f"WITH {MERGED} SELECT {COLS} FROM after")
def slot_merge(spark, sf_dir):
    return after_saves(spark, sf_dir).select(*COLS.split(", "))


@query(
    "snapshot_restore",
    f"""WITH {MERGED}, un AS (SELECT DISTINCT timetable_id FROM dec WHERE mode IN ('Merge', 'Replace') AND timetable_id LIKE '%0')
    SELECT {COLS} FROM after WHERE timetable_id NOT IN (SELECT timetable_id FROM un)
    UNION ALL SELECT {COLS} FROM ({duck('slots')}) s WHERE timetable_id IN (SELECT timetable_id FROM un)""",
)
def snapshot_restore(spark, sf_dir):
    slots = rendered(spark, sf_dir, "slots")
    snap = S.snapshot(slots, decisions(spark, sf_dir))
    chosen = rendered(spark, sf_dir, "timetables").where("timetable_id LIKE '%0'").select("timetable_id")
    return S.restore(after_saves(spark, sf_dir), snap, chosen).select(*COLS.split(", "))


@query(
    "week_view",
    f"SELECT timetable_id, row_number() OVER (PARTITION BY timetable_id ORDER BY weekday, start_minute, entry_id) AS position, weekday, start_minute, title FROM ({duck('slots')}) s",
)
def week_view(spark, sf_dir):
    return S.week_view(rendered(spark, sf_dir, "slots")).select("timetable_id", "position", "weekday", "start_minute", "title")


@query(
    "week_days",
    f"SELECT timetable_id, string_agg(DISTINCT CAST(weekday AS VARCHAR), ',' ORDER BY CAST(weekday AS VARCHAR)) AS days, count(*) AS slots FROM ({duck('slots')}) s GROUP BY 1",
)
def week_days(spark, sf_dir):
    return S.days_in_use(rendered(spark, sf_dir, "slots"))


@query(
    "slot_duplicate",
    f"""SELECT timetable_id, entry_id || '-w' || d AS entry_id, d AS weekday, start_minute, title, app_uri FROM (
      SELECT timetable_id, entry_id, start_minute, title, NULL::VARCHAR AS app_uri, weekday, unnest([1, 3, 5]) AS d FROM ({duck('slots')}) s) WHERE d <> weekday""",
)
def slot_duplicate(spark, sf_dir):
    copies = S.duplicate_slots(rendered(spark, sf_dir, "slots"), [1, 3, 5])
    return copies.select("timetable_id", "entry_id", "weekday", "start_minute", "title", "app_uri")


@query(
    "latest_timetable",
    f"""WITH tt AS ({duck('timetables')}), top AS (SELECT timetable_id FROM tt ORDER BY updated_at DESC, timetable_id LIMIT 1)
    SELECT label, max_by(timetable_id, row(updated_at, timetable_id)) AS timetable_id, max(updated_at) AS updated_at, count(*) AS versions,
      max_by(timetable_id, row(updated_at, timetable_id)) = (SELECT timetable_id FROM top) AS newest FROM tt GROUP BY label""",
)
def latest_timetable(spark, sf_dir):
    stored = rendered(spark, sf_dir, "timetables")
    top = S.most_recent(stored).select("timetable_id", F.lit(True).alias("hit"))
    return S.latest_by_label(stored).join(top, "timetable_id", "left").withColumn(
        "newest", F.coalesce("hit", F.lit(False))
    ).drop("hit")


STATE_LOG = "SELECT import_id, CASE WHEN started_at % 2 = 0 THEN 'Reverted' ELSE 'Committed' END AS new_state, started_at AS seq FROM {imports} WHERE committed_count % 3 = 0"


@query(
    "import_history",
    f"""WITH i AS ({duck('imports')}), c AS ({STATE_LOG.format(imports='i')})
    SELECT import_id, started_at, coalesce(new_state, state) AS state, CAST(CASE WHEN new_state IS NULL THEN committed_count ELSE 0 END AS INT) AS committed_count
    FROM i LEFT JOIN c USING (import_id) WHERE committed_count % 7 <> 1 ORDER BY started_at DESC LIMIT 50""",
)
def import_history(spark, sf_dir):
    rows = rendered(spark, sf_dir, "imports")
    log = rows.where("committed_count % 3 = 0").selectExpr(
        "import_id", "IF(started_at % 2 = 0, 'Reverted', 'Committed') AS new_state", "started_at AS seq"
    )
    return S.import_history(rows, log, rows.where("committed_count % 7 = 1").select("import_id"))


@query(
    "active_imports",
    f"SELECT DISTINCT batch AS import_id FROM ({duck('imports')}) i WHERE state <> 'Reverted'",
)
def active_imports(spark, sf_dir):
    created = rendered(spark, sf_dir, "imports").selectExpr(
        "batch AS import_id", "IF(state = 'Reverted', started_at, NULL) AS revoked_at"
    )
    return S.active_imports(created)


@query(
    "reminder_hygiene",
    f"WITH {calendars.PLAN} SELECT import_id, count(*) AS pending, min(due_ms) AS next_due FROM plan WHERE due_ms >= {calendars.NOW + calendars.DAY} AND import_id NOT LIKE '%3' GROUP BY import_id",
)
def reminder_hygiene(spark, sf_dir):
    plan = calendars.plan(spark, sf_dir)
    cancelled = rendered(spark, sf_dir, "planned").where("import_id LIKE '%3'").select("import_id").distinct()
    return S.reminder_hygiene(plan, calendars.NOW + calendars.DAY, cancelled)


@query(
    "schema_evolution",
    f"""WITH i AS ({duck('imports')}) SELECT import_id, state, CASE WHEN committed_count % 3 > 0 THEN started_at END AS started_at,
      CASE WHEN committed_count % 3 = 2 THEN batch END AS source_identity FROM i""",
)
def schema_evolution(spark, sf_dir):
    rows = rendered(spark, sf_dir, "imports")
    v1 = rows.where("committed_count % 3 = 0").select("import_id", "state")
    v2 = rows.where("committed_count % 3 = 1").select("import_id", "state", "started_at")
    v3 = rows.where("committed_count % 3 = 2").selectExpr("import_id", "state", "started_at", "batch AS source_identity")
    return S.evolve(v1, v2, v3)


LOG = """SELECT 't' || CAST(user_id AS STRING) AS timetable_id, 'w' || CAST(value_day AS STRING) || 'h' || CAST(hr AS STRING) AS entry_id, event_id AS seq,
    CASE WHEN event_type IN ('error') THEN 'delete' WHEN event_type = 'signup' THEN 'rename' ELSE 'put' END AS action,
    CASE WHEN event_id % 9 = 0 THEN ' ' ELSE ' New ' || event_type END AS title, value_day AS weekday, hr * 60 AS start_minute,
    CASE WHEN event_id % 8 = 0 THEN hr * 60 ELSE hr * 60 + 45 END AS end_minute
    FROM (SELECT user_id, event_id, event_type, CAST(day(ts) % 6 + 1 AS INT) AS value_day, CAST(hour(ts) AS INT) AS hr FROM {events}) e"""


def change_log(spark, sf_dir):
    return spark.sql(LOG.format(events=f"parquet.`{sf_dir}/events.parquet`"))


GOOD = "(action = 'delete' OR (action = 'put' AND trim(title) <> '' AND start_minute <> end_minute))"


@query(
    "slot_changes",
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY timetable_id, entry_id ORDER BY seq DESC) AS k FROM ({LOG.format(events='events')}) l WHERE {GOOD}),
    z AS (SELECT * FROM g WHERE k = 1)
    SELECT coalesce(s.timetable_id, z.timetable_id) AS timetable_id, coalesce(s.entry_id, z.entry_id) AS entry_id, coalesce(trim(z.title), s.title) AS title,
      coalesce(z.weekday, s.weekday) AS weekday, coalesce(z.start_minute, s.start_minute) AS start_minute, coalesce(z.end_minute, s.end_minute) AS end_minute, location
    FROM ({duck('slots')}) s FULL JOIN z ON s.timetable_id = z.timetable_id AND s.entry_id = z.entry_id WHERE action IS NULL OR action <> 'delete'""",
)
def slot_changes(spark, sf_dir):
    log = change_log(spark, sf_dir).where("action <> 'rename'")
    return S.slot_changes(rendered(spark, sf_dir, "slots"), log)


@query(
    "timetable_touch",
    f"""WITH l AS (SELECT * FROM ({LOG.format(events='events')}) l WHERE {GOOD} OR (action = 'rename' AND trim(title) <> '')),
    m AS (SELECT timetable_id, max(seq) AS ms, max_by(trim(title), seq) FILTER (action = 'rename') AS nl FROM l GROUP BY 1)
    SELECT timetable_id, coalesce(nl, label) AS label, greatest(updated_at, 1700000000 + ms) AS updated_at FROM ({duck('timetables')}) t LEFT JOIN m USING (timetable_id)""",
)
def timetable_touch(spark, sf_dir):
    return S.touched(rendered(spark, sf_dir, "timetables"), change_log(spark, sf_dir), "1700000000 + max_seq")
