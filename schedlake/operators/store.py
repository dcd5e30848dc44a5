"""Stored timetables, their slots and history: keyed table upkeep without a table format.

Every change is a keyed aggregate or an anti join that yields the next version
of the table; latest wins by sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.functions.ordered import number_rows

SLOT = ["weekday", "start_minute", "end_minute", "title", "location", "app_uri", "end_assumed"]


def save_decisions(incoming: DataFrame, timetables: DataFrame) -> DataFrame:
    """What saving each timetable does: Create, Merge, Replace, Skip, or Ask when unanswered."""
    same = timetables.where("source_identity IS NOT NULL").groupBy("source_identity").agg(
        F.min("timetable_id").alias("same_id")
    )
    named = timetables.groupBy("label").agg(F.min("timetable_id").alias("label_id"))
    rows = incoming.join(same, "source_identity", "left").join(named, "label", "left")
    mode = """CASE WHEN same_id IS NOT NULL THEN 'Replace' WHEN label_id IS NULL THEN 'Create'
        WHEN resolution IS NULL THEN 'Ask' WHEN resolution = 'CreateNew' THEN 'Create' ELSE resolution END"""
    return rows.selectExpr("*", f"{mode} AS mode").selectExpr(
        "import_id", "label", "source_identity", "mode",
        "CASE WHEN mode = 'Create' THEN concat('new-', import_id) WHEN mode IN ('Merge', 'Replace') THEN coalesce(same_id, label_id) END AS timetable_id",
    )


def apply_slots(slots: DataFrame, incoming_slots: DataFrame, decisions: DataFrame, seq: str) -> DataFrame:
    """Slots after all saves: a replace drops what came before it, a merge overwrites by entry.

    ``seq`` orders saves to one timetable; the stored slots come before all of them.
    """
    saves = decisions.where("mode IN ('Create', 'Merge', 'Replace')").selectExpr(
        "import_id", "timetable_id", "mode", f"{seq} AS seq"
    )
    wiped = saves.where("mode = 'Replace'").groupBy("timetable_id").agg(F.max("seq").alias("wipe"))
    new = incoming_slots.join(saves, "import_id").selectExpr(
        "timetable_id", "entry_id", *[c for c in SLOT if c not in ("app_uri", "end_assumed")],
        "concat('schedlake://import/', import_id, '/', entry_id) AS app_uri", "false AS end_assumed", "seq",
    )
    stacked = slots.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    live = stacked.join(wiped, "timetable_id", "left").where("wipe IS NULL OR seq >= wipe")
    return live.groupBy("timetable_id", "entry_id").agg(F.max_by(F.struct(*SLOT), "seq").alias("s")).select(
        "timetable_id", "entry_id", "s.*"
    )


def snapshot(slots: DataFrame, decisions: DataFrame) -> DataFrame:
    """Slots as they were, of every timetable about to change."""
    touched = decisions.where("mode IN ('Merge', 'Replace')").select("timetable_id").distinct()
    return slots.join(touched, "timetable_id", "left_semi")


def restore(after: DataFrame, snap: DataFrame, timetables: DataFrame) -> DataFrame:
    """One-level undo: the snapshot back for the given timetables, everything else as it is."""
    undone = snap.select("timetable_id").distinct().join(timetables, "timetable_id", "left_semi")
    return after.join(undone, "timetable_id", "left_anti").unionByName(snap.join(undone, "timetable_id", "left_semi"))


def week_view(slots: DataFrame) -> DataFrame:
    """Slots of each timetable in weekday and start order, numbered."""
    return number_rows(
        slots, ["timetable_id"], ["weekday", "start_minute", "entry_id"], "position", F.expr("weekday * 1440 + start_minute")
    )


def days_in_use(slots: DataFrame) -> DataFrame:
    return slots.groupBy("timetable_id").agg(
        F.array_join(F.array_sort(F.collect_set("weekday")).cast("array<string>"), ",").alias("days"),
        F.count("*").alias("slots"),
    )


def duplicate_slots(slots: DataFrame, weekdays: list[int]) -> DataFrame:
    """Copies of slots on other weekdays; a copy has no provenance."""
    days = ", ".join(str(d) for d in weekdays)
    copies = slots.selectExpr("*", f"explode(filter(array({days}), d -> d <> weekday)) AS day")
    return copies.selectExpr(
        "timetable_id", "concat(entry_id, '-w', day) AS entry_id", "day AS weekday", "start_minute", "end_minute",
        "title", "location", "CAST(NULL AS STRING) AS app_uri", "end_assumed",
    )


def latest_by_label(timetables: DataFrame) -> DataFrame:
    return timetables.groupBy("label").agg(
        F.max_by("timetable_id", F.struct("updated_at", "timetable_id")).alias("timetable_id"),
        F.max("updated_at").alias("updated_at"),
        F.count("*").alias("versions"),
    )


def most_recent(timetables: DataFrame) -> DataFrame:
    return timetables.orderBy(F.desc("updated_at"), "timetable_id").limit(1)


def import_history(imports: DataFrame, changes: DataFrame, forgotten: DataFrame, limit: int = 50) -> DataFrame:
    """Newest imports after state changes (which zero the count) and forgetting."""
    latest = changes.groupBy("import_id").agg(F.max_by("new_state", "seq").alias("new_state"))
    out = imports.join(forgotten, "import_id", "left_anti").join(latest, "import_id", "left").selectExpr(
        "import_id", "started_at", "coalesce(new_state, state) AS state",
        "IF(new_state IS NULL, committed_count, 0) AS committed_count",
    )
    return out.orderBy(F.desc("started_at")).limit(limit)


def active_imports(created: DataFrame) -> DataFrame:
    return created.where("revoked_at IS NULL").select("import_id").distinct()


def reminder_hygiene(plan: DataFrame, now_ms: int, cancelled: DataFrame) -> DataFrame:
    """Reminders left per import after expired ones and cancelled imports are dropped."""
    kept = plan.where(f"due_ms >= {now_ms}L").join(cancelled, "import_id", "left_anti")
    return kept.groupBy("import_id").agg(F.count("*").alias("pending"), F.min("due_ms").alias("next_due"))


def evolve(*versions: DataFrame) -> DataFrame:
    """Rows of every schema version under the newest columns; what a version lacks is NULL."""
    out = versions[0]
    for newer in versions[1:]:
        out = out.unionByName(newer, allowMissingColumns=True)
    return out


def slot_changes(slots: DataFrame, log: DataFrame) -> DataFrame:
    """Base slots under a log of put and delete; bad puts are refused, latest wins.

    ``log``: timetable_id, entry_id, seq, action, title, weekday, start_minute, end_minute.
    """
    good = log.where("action = 'delete' OR (trim(title) <> '' AND start_minute <> end_minute)")
    last = good.groupBy("timetable_id", "entry_id").agg(
        F.max_by(F.struct("action", "title", "weekday", "start_minute", "end_minute"), "seq").alias("c")
    )
    merged = slots.join(last, ["timetable_id", "entry_id"], "full").where("c IS NULL OR c.action <> 'delete'")
    return merged.selectExpr(
        "timetable_id", "entry_id",
        *[f"coalesce({'trim(c.title)' if f == 'title' else 'c.' + f}, {f}) AS {f}" for f in ("title", "weekday", "start_minute", "end_minute")],
        "location",
    )


def touched(timetables: DataFrame, log: DataFrame, now: str = "max_seq") -> DataFrame:
    """Timetables with their update time moved by accepted changes, and renamed by the last rename."""
    good = log.where(
        "action IN ('delete') OR (action = 'put' AND trim(title) <> '' AND start_minute <> end_minute) OR (action = 'rename' AND trim(title) <> '')"
    )
    last = good.groupBy("timetable_id").agg(
        F.max("seq").alias("max_seq"),
        F.max_by(F.trim("title"), F.when(F.col("action") == "rename", F.col("seq"))).alias("new_label"),
    )
    return timetables.join(last, "timetable_id", "left").selectExpr(
        "timetable_id", "coalesce(new_label, label) AS label", f"greatest(updated_at, coalesce({now}, updated_at)) AS updated_at"
    )
