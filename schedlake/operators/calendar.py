"""Recurrence, reminders, and keeping a calendar in step with an import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schedlake.operators.candidates import epoch_ms
from schedlake.operators.tokens import comparison_key, similarity
from schedlake.session import written

# Minutes before the event.
LADDERS = {
    "Default": (1440, 60, 15, 5),
    "Class": (30, 10, 5),
    "Deadline": (10080, 1440, 180),
}
SIMILAR = 0.85
DAY_MS = 86_400_000
URI = "schedlake://import/"


def rrule(days: str, until: str) -> str:
    """RRULE text of an array of ISO weekdays; UNTIL is the midnight after the last day."""
    names = "array('MO', 'TU', 'WE', 'TH', 'FR', 'SA', 'SU')"
    by_day = f"array_join(transform(array_sort({days}), d -> element_at({names}, d)), ',')"
    return f"concat('FREQ=WEEKLY;BYDAY=', {by_day}, ';UNTIL=', date_format(date_add({until}, 1), 'yyyyMMdd'), 'T000000Z')"


def rule_texts(rules: DataFrame) -> DataFrame:
    """RRULE, duration and EXDATE of weekly rules (``days`` and ``exceptions`` are arrays)."""
    return rules.selectExpr(
        "entry_id",
        f"{rrule('days', 'until')} AS rrule",
        "concat('P', greatest(seconds, 60), 'S') AS duration",
        "IF(size(exceptions) = 0, NULL, concat('TZID=', zone, ':', "
        "array_join(transform(exceptions, d -> concat(date_format(d, 'yyyyMMdd'), 'T000000')), ','))) AS exdate",
    )


def occurrences(rules: DataFrame, from_ms: str, to_ms: str) -> DataFrame:
    """Instants of weekly rules in [from, to): one step per week and weekday, wall clock held in the zone."""
    def local_day(ms: str) -> str:
        return f"CAST(convert_timezone('UTC', zone, timestampadd(MILLISECOND, {ms}, TIMESTAMP_NTZ'1970-01-01 00:00:00')) AS DATE)"

    dated = rules.where(f"{from_ms} < {to_ms}").selectExpr(
        "*", f"{local_day(from_ms)} AS d0", f"least({local_day(to_ms)}, until) AS d1", "explode(days) AS __day"
    )
    first = "date_add(d0, pmod(__day - weekday(d0) - 1, 7))"
    stepped = dated.where(f"{first} <= d1").selectExpr("*", f"explode(sequence({first}, d1, INTERVAL 7 DAYS)) AS day")
    kept = stepped.where("NOT array_contains(exceptions, day)").selectExpr(
        "*", f"{epoch_ms('day', 'start_min', 'zone')} AS event_ms"
    )
    return kept.where(f"event_ms >= {from_ms} AND event_ms < {to_ms}").drop("d0", "d1", "__day")


def ladder_rungs(events: DataFrame, keys: list[str], from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Reminder instants of each event: start minus every offset, and repeats closing in.

    Needs ``event_ms``, ``offsets`` (minutes) and ``repeat_min`` (NULL for none).  Only instants in
    [``from_ms``, ``to_ms``) are made, where those are given.
    """
    inside = " AND ".join(
        x for x in (from_ms is not None and f"x >= {from_ms}L", to_ms is not None and f"x < {to_ms}L") if x
    )
    rungs = "transform(offsets, o -> event_ms - o * 60000L)"
    closest = "(event_ms - coalesce(array_min(offsets), 0) * 60000L)"
    step = "(repeat_min * 60000L)"
    end = "event_ms" if to_ms is None else f"least(event_ms, {to_ms}L)"
    last = f"CAST(floor(({end} - 1 - {closest}) / {step}) AS BIGINT)"
    first = "1L" if from_ms is None else f"greatest(1L, CAST(ceil(({from_ms}L - {closest}) / {step}) AS BIGINT))"
    repeats = f"IF(repeat_min IS NULL OR {last} < {first}, array(), transform(sequence({first}, greatest({last}, {first})), i -> {closest} + i * {step}))"
    made = f"array_distinct(concat({rungs}, {repeats}))"
    return events.selectExpr(*keys, "event_ms", f"explode({f'filter({made}, x -> {inside})' if inside else made}) AS due_ms")


def user_ladder(offsets: str) -> str:
    """Offsets a user typed: negatives dropped, distinct, largest first."""
    return f"sort_array(array_distinct(filter({offsets}, o -> o >= 0)), false)"


def ladder_for(kind: str) -> str:
    arms = " ".join(
        f"WHEN '{k}' THEN array({', '.join(str(o) for o in v)})" for k, v in LADDERS.items() if k != "Default"
    )
    return f"CASE {kind} {arms} ELSE array({', '.join(str(o) for o in LADDERS['Default'])}) END"


def reminder_plan(weekly: DataFrame, single: DataFrame, now_ms: int, horizon_days: int = 7) -> DataFrame:
    """Rows of the reminder table for one horizon; ids make planning twice harmless.

    ``weekly`` are recurrence rules, ``single`` one-off events; both carry
    ``offsets`` and ``repeat_min``.
    """
    until = now_ms + horizon_days * DAY_MS
    reach = f"({until}L + array_max(offsets) * 60000L)"
    shape = ["import_id", "entry_id", "title", "kind", "offsets", "repeat_min", "event_ms"]
    events = occurrences(weekly, f"{now_ms}L", reach).select(*shape).unionByName(
        single.where(f"event_ms > {now_ms}L AND event_ms < {reach}").select(*shape)
    )
    rungs = ladder_rungs(events, ["import_id", "entry_id", "title", "kind"], now_ms, until)
    return rungs.selectExpr(
        "concat_ws('/', import_id, entry_id, event_ms, due_ms) AS id",
        "*",
        f"concat('{URI}', import_id, '/', entry_id) AS app_uri",
        "CAST(NULL AS BIGINT) AS fired_at",
    )


def due_window(plan: DataFrame, now_ms: int, hours: int = 48, limit: int = 100) -> DataFrame:
    """The next unfired reminders to arm: a top-k report."""
    due = plan.where(f"fired_at IS NULL AND due_ms >= {now_ms}L AND due_ms < {now_ms + hours * 3_600_000}L")
    return due.orderBy("due_ms", "id").limit(limit)


def headline(lead_ms: str) -> str:
    return (
        f"CASE WHEN all_day THEN title WHEN {lead_ms} < 60000 THEN 'Starting now' "
        f"WHEN {lead_ms} < 3600000 THEN concat('In ', {lead_ms} div 60000, ' minutes') "
        f"WHEN {lead_ms} < 86400000 THEN concat('In ', {lead_ms} div 3600000, ' hours') ELSE 'Tomorrow' END"
    )


def channel(kind: str) -> str:
    return f"CASE {kind} WHEN 'Class' THEN 'Classes' WHEN 'Appointment' THEN 'Appointments' ELSE 'Deadlines' END"


def writable_calendars(calendars: DataFrame, contributor: int = 500) -> DataFrame:
    return calendars.where(f"access_level >= {contributor} AND visible AND NOT deleted").selectExpr(
        "calendar_id",
        "IF(trim(coalesce(display_name, '')) = '', account_name, display_name) AS label",
        "coalesce(owner <> '' AND owner = account_name, false) AS is_primary",
    )


PERCENT = round(SIMILAR * 100)
SPARE = (2, 6, 12)  # segments a key may have beyond those that must be looked up: the most frequent ones are left out


def _allowed(length: str) -> str:
    """Edits that a pair may have whose longer key has this length."""
    return f"({length} * {100 - PERCENT}) div 100"


def _segments(rows: DataFrame) -> DataFrame:
    """Segment ``i`` of ``n`` of a key of length ``lo``: where it starts, and how wide it is."""
    out = rows.selectExpr("*", "explode(sequence(0, CAST(n - 1 AS INT))) AS i")
    return out.selectExpr("*", "CAST(i * lo div n AS INT) AS start", "CAST((i + 1) * lo div n - i * lo div n AS INT) AS width")


def near_keys(new: DataFrame, old: DataFrame, at: list[str]) -> DataFrame:
    """(at, new_key, old_key): pairs of keys of one place that may be similar enough, found without comparing all of them.

    An old key is cut into more segments than its partners may have edits.  Of ``e`` + 1 + spare segments at least spare + 1 stay whole
    whatever the edits, shifted no further than the edits allow, so it is enough to look up the ``e`` + 1 rarest: what many
    keys share (a common beginning) is left out.  Keys choose the number of segments under which those are rarest.  A pair that may
    have fewer edits than the longest partner must share as many more of the segments looked up.
    Joins are shuffled whatever Spark estimates: the estimates leave out the rows that generators make.
    """
    spare = ", ".join(map(str, SPARE))
    cut = old.select(*at, "old_key", F.length("old_key").alias("lo")).where("lo > 0").selectExpr(
        "*", f"{_allowed(f'(lo * 100 div {PERCENT})')} AS edits"
    ).selectExpr("*", f"explode(array_distinct(transform(array({spare}), x -> least(edits + 1 + x, lo)))) AS n")
    cut = _segments(cut).withColumn("segment", F.expr("substring(old_key, start + 1, width)"))
    place = [*at, "lo", "n", "i", "segment"]
    counted = cut.hint("merge").join(cut.groupBy(*place).agg(F.count("*").alias("often")), place)
    rank = F.row_number().over(W.partitionBy(*at, "old_key", "n").orderBy("often", "i"))
    rarest = written(counted.withColumn("rank", rank).where("rank <= edits + 1").select(*place, "old_key", "often"), "rare-segments")
    costs = rarest.groupBy(*at, "old_key", "n").agg(F.sum("often").alias("cost"))
    chosen = costs.groupBy(*at, "old_key").agg(F.min_by("n", F.struct("cost", "n")).alias("n"))
    index = written(rarest.hint("merge").join(chosen, [*at, "old_key", "n"]).select(*place, "old_key"), "segment-index")
    lengths = index.select(*at, "lo", "n").distinct()
    probes = new.select(*at, "new_key", F.length("new_key").alias("ln")).where("ln > 0").hint("merge").join(lengths, at)
    probes = _segments(probes.where(f"least(lo, ln) * 100 >= greatest(lo, ln) * {PERCENT}").selectExpr("*", f"{_allowed('greatest(lo, ln)')} AS edits"))
    # edits left of the segment are at least its shift, edits right of it at least what the shift and the lengths differ by
    low, high = "CAST(greatest(0, start + ceil((ln - lo - edits) / 2)) AS INT)", "CAST(least(ln - width, start + floor((ln - lo + edits) / 2)) AS INT)"
    probes = probes.where(f"{low} <= {high}").selectExpr(*at, "new_key", "lo", "n", "i", "width", f"explode(sequence({low}, {high})) AS s")
    probes = probes.selectExpr(*at, "new_key", "lo", "n", "i", "substring(new_key, s + 1, width) AS segment").distinct()
    # a key has one segment for each i, and a probe asks for it once: rows of a pair are the segments it shares
    shared = probes.hint("merge").join(index, place).groupBy(*at, "lo", "new_key", "old_key").agg(F.count("*").alias("shared"))
    needed = f"{_allowed(f'(lo * 100 div {PERCENT})')} + 1 - {_allowed('greatest(lo, length(new_key))')}"
    return shared.where(f"shared >= {needed}").select(*at, "new_key", "old_key")


def find_duplicates(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Events already in the calendar at the same instant under a similar title.

    Both sides shrink to distinct comparison keys per instant first, so copies of one event cost one comparison; keys meet
    through segments they share, never all of an instant.  The first existing event is reported.
    """
    at = ["calendar_id", "start_ms"]
    old = existing.where("NOT deleted").select(
        *at, "event_id", "title", F.expr("app_uri IS NOT NULL AND startswith(app_uri, 'schedlake://')").alias("ours"),
        comparison_key(F.col("title")).alias("old_key"),
    )
    old = old.groupBy(*at, "old_key").agg(
        F.min(F.struct("event_id", "title", "ours")).alias("old")
    )
    new = planned.withColumn("new_key", comparison_key(F.col("title")))
    old, keys = written(old, "calendar-keys"), new.select(*at, "new_key").distinct()
    pairs = near_keys(keys, old, at).where(F.col("new_key") != F.col("old_key"))
    close = pairs.where(similarity(F.col("old_key"), F.col("new_key")) >= SIMILAR)
    close = close.unionByName(keys.withColumn("old_key", F.col("new_key")))
    first = close.hint("merge").join(old, [*at, "old_key"]).groupBy(*at, "new_key").agg(F.min("old").alias("old"))
    return new.hint("merge").join(first, [*at, "new_key"]).select(
        "entry_id", F.col("old.title").alias("existing_title"), F.col("old.event_id").alias("event_id"),
        F.col("old.ours").alias("created_by_us"),
    )


def skip_duplicates(planned: DataFrame, duplicates: DataFrame, add_anyway: DataFrame | None = None) -> DataFrame:
    """Planned events without those found, except the ones the user adds anyway."""
    skipped = duplicates.select("entry_id")
    if add_anyway is not None:
        skipped = skipped.hint("merge").join(add_anyway, "entry_id", "left_anti")
    return planned.hint("merge").join(skipped, "entry_id", "left_anti")


def event_rows(candidates: DataFrame, zone: str) -> DataFrame:
    """Calendar rows: all-day spans UTC midnights; recurring rows carry RRULE and DURATION, others DTEND."""
    z = f"'{zone}'"
    minutes = "(datediff(end_date, start_date) * 1440 + end_min - start_min)"
    return candidates.selectExpr(
        "entry_id", "title", "all_day",
        f"IF(all_day, 'UTC', {z}) AS time_zone",
        f"IF(all_day, unix_date(start_date) * {DAY_MS}L, {epoch_ms('start_date', 'coalesce(start_min, 0)', z)}) AS dtstart",
        f"CASE WHEN all_day THEN (unix_date(start_date) + 1) * {DAY_MS}L "
        f"WHEN by_weekday IS NULL THEN {epoch_ms('end_date', 'coalesce(end_min, 0)', z)} END AS dtend",
        f"IF(NOT all_day AND by_weekday IS NOT NULL, {rrule('array(by_weekday)', 'until')}, NULL) AS rrule",
        f"IF(NOT all_day AND by_weekday IS NOT NULL, concat('P', greatest({minutes} * 60, 60), 'S'), NULL) AS duration",
    )


def write_report(planned: DataFrame, present: DataFrame) -> DataFrame:
    """Per import: rows to write, rows found afterwards by provenance, and rows missing."""
    uri = F.concat(F.lit(URI), "import_id", F.lit("/"), "entry_id")
    found = present.where("NOT deleted").select(F.col("app_uri").alias("uri")).distinct().withColumn("hit", F.lit(1))
    return planned.withColumn("uri", uri).join(found, "uri", "left").groupBy("import_id").agg(
        F.count("*").alias("planned"),
        F.count("hit").alias("written"),
        (F.count("*") - F.count("hit")).alias("failed"),
    )


def undo_import(events: DataFrame, created: DataFrame, import_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The calendar without the rows of some imports, a report per import, and the created rows with ``revoked``.

    Rows are taken by provenance; what was created but is gone already is counted.
    """
    owner = F.regexp_extract("app_uri", f"^{URI}([^/]+)/", 1)
    tagged = events.withColumn("import_id", owner)
    remaining = tagged.join(import_ids, "import_id", "left_anti").drop("import_id")
    removed = tagged.join(import_ids, "import_id", "left_semi").groupBy("import_id").agg(F.count("*").alias("removed"))
    expected = created.join(import_ids, "import_id", "left_semi").groupBy("import_id").agg(F.count("*").alias("expected"))
    report = expected.join(removed, "import_id", "full").selectExpr(
        "import_id", "coalesce(removed, 0) AS removed",
        "greatest(coalesce(expected, 0) - coalesce(removed, 0), 0) AS already_gone",
    )
    undone = import_ids.select("import_id").distinct().withColumn("__undone", F.lit(True))
    marked = created.join(undone, "import_id", "left").withColumn("revoked", F.col("__undone").isNotNull()).drop("__undone")
    return remaining, report, marked


def write_through(events: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates and deletes by exact provenance; a change that met no row is reported.

    ``changes``: app_uri, action (update or delete), new_title, new_start_ms.
    """
    merged = events.join(changes, "app_uri", "left")
    after = merged.where("action IS NULL OR action <> 'delete'").selectExpr(
        "event_id", "calendar_id", "coalesce(new_title, title) AS title", "coalesce(new_start_ms, start_ms) AS start_ms",
        "deleted", "app_uri",
    )
    hits = events.groupBy("app_uri").agg(F.count("*").alias("rows"))
    report = changes.join(hits, "app_uri", "left").selectExpr("app_uri", "action", "coalesce(rows, 0) AS rows")
    return after, report


