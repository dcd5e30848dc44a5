"""Calendar, recurrence and reminder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import calendar as L
from schedlake.plans import review
from schedlake.plans.registry import query
from schedlake.plans.tokens import KEY_SQL
from schedlake.sources.rendered import duck, rendered

NOW = 1787011200000  # 2026-08-17 18:40 in Kolkata
DAY = 86400000
HORIZON = NOW + 7 * DAY


def rules(spark, sf_dir):
    return rendered(spark, sf_dir, "recurrences").withColumns(
        {
            "days": F.expr("transform(split(days, ','), d -> CAST(d AS INT))"),
            "exceptions": F.expr("transform(filter(split(exceptions, ','), d -> d <> ''), d -> CAST(d AS DATE))"),
        }
    )


@query(
    "rrule_text",
    f"""WITH d AS (SELECT entry_id, unnest(string_split(days, ',')) AS n FROM ({duck('recurrences')}) r),
    b AS (SELECT entry_id, string_agg(split_part('MO,TU,WE,TH,FR,SA,SU', ',', CAST(n AS INT)), ',' ORDER BY n) AS byday FROM d GROUP BY entry_id)
    SELECT entry_id, 'FREQ=WEEKLY;BYDAY=' || byday || ';UNTIL=' || strftime(until + 1, '%Y%m%d') || 'T000000Z' AS rrule,
      'P' || greatest(seconds, 60) || 'S' AS duration,
      CASE WHEN exceptions <> '' THEN 'TZID=' || zone || ':' || replace(replace(exceptions, '-', ''), ',', 'T000000,') || 'T000000' END AS exdate
    FROM ({duck('recurrences')}) r JOIN b USING (entry_id)""",
)
def rrule_text(spark, sf_dir):
    return L.rule_texts(rules(spark, sf_dir))


OFFSET = "CASE WHEN zone = 'Asia/Kolkata' THEN 330 ELSE 60 END"
WALK = f"""r AS (SELECT *, {OFFSET} AS off FROM ({duck('recurrences')}) r),
    w AS (SELECT *, DATE '2026-08-10' + CAST(i AS INT) AS day FROM (SELECT *, unnest(range(0, 60)) AS i FROM r)),
    o AS (SELECT *, epoch_ms(CAST(day AS TIMESTAMP)) + (start_min - off) * 60000 AS event_ms FROM w
      WHERE day <= until AND list_contains(string_split(days, ','), CAST(isodow(day) AS VARCHAR))
        AND NOT list_contains(string_split(exceptions, ','), strftime(day, '%Y-%m-%d')))"""


@query(
    "occurrences",
    f"WITH {WALK} SELECT entry_id, CAST(day AS VARCHAR) AS day, event_ms FROM o WHERE event_ms >= {NOW} AND event_ms < {NOW + 21 * DAY}",
)
def occurrences(spark, sf_dir):
    out = L.occurrences(rules(spark, sf_dir), f"{NOW}L", f"{NOW + 21 * DAY}L")
    return out.selectExpr("entry_id", "CAST(day AS STRING) AS day", "event_ms")


LADDER = """CASE kind WHEN 'Class' THEN [30, 10, 5] WHEN 'Deadline' THEN [10080, 1440, 180] ELSE [1440, 60, 15, 5] END"""


@query(
    "reminder_ladder",
    f"""WITH e AS (SELECT entry_id, start_ms AS event_ms, kind, CASE WHEN pos % 5 = 0 THEN [20, 90, 45] ELSE {LADDER} END AS offs,
        CASE WHEN pos % 3 = 0 THEN 7 END AS rep FROM ({duck('planned')}) p),
    a AS (SELECT entry_id, event_ms, event_ms - unnest(offs) * 60000 AS due_ms FROM e),
    b AS (SELECT entry_id, event_ms, event_ms - list_min(offs) * 60000 + unnest(generate_series(1, list_min(offs) // rep)) * rep * 60000 AS due_ms FROM e WHERE rep IS NOT NULL)
    SELECT entry_id, event_ms, due_ms FROM a UNION SELECT * FROM b WHERE due_ms < event_ms""",
)
def reminder_ladder(spark, sf_dir):
    typed = L.user_ladder("array(20, 90, -5, 45, 90)")
    events = rendered(spark, sf_dir, "planned").selectExpr(
        "entry_id", "start_ms AS event_ms", f"IF(pos % 5 = 0, {typed}, {L.ladder_for('kind')}) AS offsets",
        "IF(pos % 3 = 0, 7, NULL) AS repeat_min",
    )
    return L.ladder_rungs(events, ["entry_id"])


# One-off events are moved next to the planning moment: their own instants lie decades away.
NEAR = f"{NOW} + (start_ms // 60000 * 7919) % 20000 * 60000"


def plan(spark, sf_dir, now=NOW):
    weekly = rules(spark, sf_dir).selectExpr(
        "*", "'Class' AS kind", f"{L.ladder_for(repr('Class'))} AS offsets", "CAST(NULL AS INT) AS repeat_min"
    )
    single = rendered(spark, sf_dir, "planned").selectExpr(
        "import_id", "entry_id", "title", "kind", f"{L.ladder_for('kind')} AS offsets", "CAST(NULL AS INT) AS repeat_min",
        NEAR.replace("//", "div") + " AS event_ms",
    )
    return L.reminder_plan(weekly, single, now)


def plan_sql(now: int) -> str:
    until = now + 7 * DAY
    return f"""{WALK}, ev AS (SELECT import_id, entry_id, title, 'Class' AS kind, [30, 10, 5] AS offs, event_ms FROM o WHERE event_ms >= {now} AND event_ms < {until} + 30 * 60000
      UNION ALL SELECT import_id, entry_id, title, kind, {LADDER}, {NEAR} FROM ({duck('planned')}) p WHERE {NEAR} > {now}),
    due AS (SELECT import_id, entry_id, title, kind, event_ms, event_ms - unnest(offs) * 60000 AS due_ms FROM ev),
    plan AS (SELECT import_id || '/' || entry_id || '/' || event_ms || '/' || due_ms AS id, * FROM due WHERE due_ms >= {now} AND due_ms < {until})"""


PLAN = plan_sql(NOW)


@query("reminder_plan", f"WITH {PLAN} SELECT id, title, kind, event_ms, due_ms FROM plan")
def reminder_plan(spark, sf_dir):
    return plan(spark, sf_dir).select("id", "title", "kind", "event_ms", "due_ms")


@query(
    "due_window",
    f"WITH {PLAN} SELECT id, due_ms FROM plan WHERE due_ms >= {NOW + DAY} AND due_ms < {NOW + 3 * DAY} ORDER BY due_ms, id LIMIT 100",
)
def due_window(spark, sf_dir):
    return L.due_window(plan(spark, sf_dir), NOW + DAY).select("id", "due_ms")


@query(
    "lead_time_text",
    f"""WITH {PLAN}, l AS (SELECT *, event_ms - due_ms - 30000 AS lead, length(title) % 9 = 0 AS all_day FROM plan)
    SELECT id, CASE WHEN all_day THEN title WHEN lead < 60000 THEN 'Starting now' WHEN lead < 3600000 THEN 'In ' || lead // 60000 || ' minutes'
      WHEN lead < 86400000 THEN 'In ' || lead // 3600000 || ' hours' ELSE 'Tomorrow' END AS headline,
      CASE kind WHEN 'Class' THEN 'Classes' WHEN 'Appointment' THEN 'Appointments' ELSE 'Deadlines' END AS channel FROM l""",
)
def lead_time_text(spark, sf_dir):
    rows = plan(spark, sf_dir).withColumn("all_day", F.expr("length(title) % 9 = 0"))
    return rows.selectExpr("id", f"{L.headline('(event_ms - due_ms - 30000)')} AS headline", f"{L.channel('kind')} AS channel")


CALENDARS = """SELECT c_custkey AS calendar_id, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE c_name END AS display_name,
    'acct' || CAST(c_nationkey AS STRING) AS account_name, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'acct' || CAST(c_nationkey AS STRING) END AS owner,
    CAST(c_custkey % 8 * 100 AS INT) AS access_level, c_custkey % 5 > 0 AS visible, c_custkey % 7 = 0 AS deleted FROM {customer}"""


@query(
    "writable_calendars",
    f"""SELECT calendar_id, CASE WHEN trim(display_name) = '' THEN account_name ELSE display_name END AS label, owner <> '' AND owner = account_name AS is_primary
    FROM ({CALENDARS.format(customer='customer')}) c WHERE access_level >= 500 AND visible AND NOT deleted""",
)
def writable_calendars(spark, sf_dir):
    return L.writable_calendars(spark.sql(CALENDARS.format(customer=f"parquet.`{sf_dir}/customer.parquet`")))


DUPES = f"""p AS (SELECT *, {KEY_SQL.format(t='title')} AS k FROM ({duck('planned')}) p), c AS (SELECT *, {KEY_SQL.format(t='title')} AS k FROM ({duck('calendar')}) c WHERE NOT deleted),
    m AS (SELECT p.entry_id, c.event_id, c.title, c.app_uri IS NOT NULL AS ours FROM p JOIN c USING (calendar_id, start_ms)
      WHERE CASE WHEN p.k = c.k THEN 1.0 WHEN p.k = '' OR c.k = '' THEN 0 ELSE 1.0 - levenshtein(p.k, c.k) / greatest(length(p.k), length(c.k)) END >= 0.85),
    dup AS (SELECT entry_id, min_by(title, event_id) AS existing_title, min(event_id) AS event_id, min_by(ours, event_id) AS created_by_us FROM m GROUP BY entry_id)"""


def duplicates(spark, sf_dir):
    return L.find_duplicates(rendered(spark, sf_dir, "planned"), rendered(spark, sf_dir, "calendar"))


@query("calendar_duplicates", f"WITH {DUPES} SELECT * FROM dup")
def calendar_duplicates(spark, sf_dir):
    return duplicates(spark, sf_dir)


@query(
    "skip_duplicates",
    f"WITH {DUPES} SELECT entry_id, calendar_id, start_ms FROM p WHERE entry_id NOT IN (SELECT entry_id FROM dup WHERE event_id % 10 <> 0)",
)
def skip_duplicates(spark, sf_dir):
    dupes = duplicates(spark, sf_dir)
    anyway = dupes.where("event_id % 10 = 0").select("entry_id")
    return L.skip_duplicates(rendered(spark, sf_dir, "planned"), dupes, anyway).select("entry_id", "calendar_id", "start_ms")


@query(
    "event_rows",
    f"""WITH {review.GATE} SELECT entry_id, all_day, CASE WHEN all_day THEN 'UTC' ELSE 'Asia/Kolkata' END AS time_zone,
      epoch_ms(CAST(start_date AS TIMESTAMP)) + CASE WHEN all_day THEN 0 ELSE (start_min - 330) * 60000 END AS dtstart,
      CASE WHEN all_day THEN epoch_ms(CAST(start_date AS TIMESTAMP)) + 86400000 WHEN by_weekday IS NULL THEN epoch_ms(CAST(end_date AS TIMESTAMP)) + (end_min - 330) * 60000 END AS dtend,
      CASE WHEN NOT all_day AND by_weekday IS NOT NULL THEN 'FREQ=WEEKLY;BYDAY=' || split_part('MO,TU,WE,TH,FR,SA,SU', ',', by_weekday) || ';UNTIL=' || strftime(until + 1, '%Y%m%d') || 'T000000Z' END AS rrule,
      CASE WHEN NOT all_day AND by_weekday IS NOT NULL THEN 'P' || greatest((date_diff('day', start_date, end_date) * 1440 + end_min - start_min) * 60, 60) || 'S' END AS duration FROM cand""",
)
def event_rows(spark, sf_dir):
    return L.event_rows(review.candidates(spark, sf_dir), "Asia/Kolkata").drop("title")


@query(
    "write_report",
    f"""WITH p AS (SELECT import_id, 'schedlake://import/' || import_id || '/' || entry_id AS uri FROM ({duck('planned')}) p),
    c AS (SELECT DISTINCT app_uri AS uri FROM ({duck('calendar')}) c WHERE NOT deleted AND app_uri IS NOT NULL)
    SELECT import_id, count(*) AS planned, count(c.uri) AS written, count(*) - count(c.uri) AS failed FROM p LEFT JOIN c USING (uri) GROUP BY import_id""",
)
def write_report(spark, sf_dir):
    return L.write_report(rendered(spark, sf_dir, "planned"), rendered(spark, sf_dir, "calendar"))


def undone(spark, sf_dir):
    planned = rendered(spark, sf_dir, "planned")
    ids = planned.where(UNDONE).select("import_id").distinct()
    return L.undo_import(rendered(spark, sf_dir, "calendar"), planned, ids)


UNDONE = "import_id LIKE '%5' OR import_id IN ('i7', 'i8')"


@query(
    "undo_import",
    f"""WITH c AS (SELECT *, regexp_extract(app_uri, '^schedlake://import/([^/]+)/', 1) AS import_id FROM ({duck('calendar')}) c),
    ex AS (SELECT import_id, count(*) AS n FROM ({duck('planned')}) p WHERE {UNDONE} GROUP BY 1), re AS (SELECT import_id, count(*) AS n FROM c WHERE {UNDONE} GROUP BY 1)
    SELECT coalesce(ex.import_id, re.import_id) AS import_id, coalesce(re.n, 0) AS removed, greatest(coalesce(ex.n, 0) - coalesce(re.n, 0), 0) AS already_gone,
      FROM ex FULL JOIN re USING (import_id)""".replace("already_gone,", "already_gone"),
)
def undo_import(spark, sf_dir):
    return undone(spark, sf_dir)[1]


@query(
    "undo_remaining",
    f"""SELECT event_id, calendar_id, start_ms FROM (SELECT *, regexp_extract(app_uri, '^schedlake://import/([^/]+)/', 1) AS import_id FROM ({duck('calendar')}) c)
    WHERE NOT coalesce({UNDONE}, false)""",
)
def undo_remaining(spark, sf_dir):
    return undone(spark, sf_dir)[0].select("event_id", "calendar_id", "start_ms")


@query("undo_revoked", f"SELECT import_id, entry_id, {UNDONE} AS revoked FROM ({duck('planned')}) p")
def undo_revoked(spark, sf_dir):
    return undone(spark, sf_dir)[2].select("import_id", "entry_id", "revoked")


CHANGES = """SELECT 'schedlake://import/' || import_id || '/' || entry_id AS app_uri, CASE WHEN pos % 5 = 0 THEN 'delete' ELSE 'update' END AS action,
    CASE WHEN pos % 5 > 0 THEN 'Moved ' || title END AS new_title, CASE WHEN pos % 5 > 2 THEN start_ms + 3600000 END AS new_start_ms FROM ({planned}) p WHERE pos % 12 < 5"""


def changes(spark, sf_dir):
    rendered(spark, sf_dir, "planned").createOrReplaceTempView("planned_events")
    return spark.sql(CHANGES.format(planned="SELECT * FROM planned_events"))


@query(
    "write_through",
    f"""WITH ch AS ({CHANGES.format(planned=duck('planned'))}), c AS ({duck('calendar')})
    SELECT event_id, coalesce(new_title, title) AS title, coalesce(new_start_ms, start_ms) AS start_ms FROM c LEFT JOIN ch USING (app_uri) WHERE action IS DISTINCT FROM 'delete'""",
)
def write_through(spark, sf_dir):
    after, _ = L.write_through(rendered(spark, sf_dir, "calendar"), changes(spark, sf_dir))
    return after.select("event_id", "title", "start_ms")


@query(
    "write_through_report",
    f"""WITH ch AS ({CHANGES.format(planned=duck('planned'))}), c AS (SELECT app_uri, count(*) AS n FROM ({duck('calendar')}) c GROUP BY 1)
    SELECT app_uri, action, coalesce(n, 0) AS rows FROM ch LEFT JOIN c USING (app_uri)""",
)
def write_through_report(spark, sf_dir):
    _, report = L.write_through(rendered(spark, sf_dir, "calendar"), changes(spark, sf_dir))
    return report
