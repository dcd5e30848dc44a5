"""Entries become calendar candidates or questions; assumptions are recorded and reviewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values, as is the wording of the questions below: results carry them.
ASSUMED_END, ASSUMED_DAY = "assumed-duration", "all-day-from-date-only"
DEFAULT_MINUTES = 60


def usable(field: str) -> str:
    return f"{field}_level IN ('High', 'Medium')"


def first_occurrence(weekday: str, on_or_after: str) -> str:
    """First date with that ISO weekday on or after a date."""
    return f"date_add({on_or_after}, pmod({weekday} - weekday({on_or_after}) - 1, 7))"


def epoch_ms(date: str, minutes: str, zone: str) -> str:
    """Instant of a wall-clock time in a zone, daylight saving included."""
    utc = f"convert_timezone({zone}, 'UTC', timestampadd(MINUTE, {minutes}, CAST({date} AS TIMESTAMP_NTZ)))"
    return (
        f"(unix_date(CAST({utc} AS DATE)) * 86400000L + hour({utc}) * 3600000L + minute({utc}) * 60000L)"
    )


def gate(
    entries: DataFrame,
    terms: DataFrame,
    assumed_minutes: int | None = DEFAULT_MINUTES,
    allow_all_day: bool = True,
) -> DataFrame:
    """Every entry with either ``field``/``question`` set (rejected) or the candidate columns filled."""
    duration = "CAST(NULL AS INT)" if assumed_minutes is None else str(assumed_minutes)
    assumed_end = f"end_level = 'Missing' AND {duration} IS NOT NULL"
    staged = entries.join(terms, "doc_id", "left").selectExpr(
        "*",
        f"{usable('weekday')} AS recurring",
        f"IF({usable('weekday')}, {first_occurrence('weekday', 'term_start')}, IF({usable('date')}, date, NULL)) AS first_date",
        f"IF({usable('start')}, start_min, NULL) AS s",
        f"CASE WHEN {usable('end')} THEN end_min WHEN {assumed_end} AND {usable('start')} THEN (start_min + {duration}) % 1440 END AS e",
        f"NOT {usable('end')} AND {assumed_end} AS end_filled",
    )
    rejection = f"""CASE
        WHEN NOT {usable('title')} THEN 'Title|What is this called?'
        WHEN recurring AND term_end IS NULL THEN 'Recurrence|When does this schedule end? Weekly classes need an end date.'
        WHEN recurring AND first_date > term_end THEN "Recurrence|This class doesn't occur before the term ends."
        WHEN NOT recurring AND first_date IS NULL THEN 'Date|What date is this on?'
        WHEN s IS NULL AND (recurring OR NOT {str(allow_all_day).lower()} OR start_level <> 'Missing') THEN 'StartTime|When does this start?'
        WHEN s IS NOT NULL AND e IS NULL THEN 'EndTime|When does this end?'
        WHEN s = e THEN 'EndTime|This starts and ends at the same time.' END"""
    staged = staged.withColumn("rejection", F.expr(rejection))
    weak = " OR ".join(f"{f}_level = 'Low'" for f in ("title", "start", "end", "location"))
    ok = "rejection IS NULL"
    return staged.selectExpr(
        "entry_id", "doc_id", "group_id", "kind", "title",
        "split(rejection, '[|]')[0] AS field", "split(rejection, '[|]')[1] AS question", "term_end IS NULL AS no_term",
        f"IF({ok}, s IS NULL, NULL) AS all_day",
        f"IF({ok}, first_date, NULL) AS start_date", f"IF({ok}, s, NULL) AS start_min",
        f"CASE WHEN NOT ({ok}) THEN NULL WHEN s IS NULL OR e < s THEN date_add(first_date, 1) ELSE first_date END AS end_date",
        f"IF({ok}, IF(s IS NULL, NULL, e), NULL) AS end_min",
        f"IF({ok} AND {usable('location')}, location, NULL) AS location",
        f"IF({ok} AND recurring, weekday, NULL) AS by_weekday", f"IF({ok} AND recurring, term_end, NULL) AS until",
        f"IF({ok}, array_compact(array(IF(s IS NULL, '{ASSUMED_DAY}', NULL), IF(s IS NOT NULL AND end_filled, '{ASSUMED_END}', NULL))), NULL) AS assumptions",
        f"IF({ok}, {weak}, NULL) AS read_weakly",
    )


def accepted(gated: DataFrame) -> DataFrame:
    """Candidates with their status: anything assumed or weakly read needs attention."""
    out = gated.where("field IS NULL").drop("field", "question", "no_term")
    return out.withColumn("status", status()).withColumn(
        "provided", F.array().cast("array<string>")
    )


def status() -> Column:
    flagged = F.col("read_weakly") | (F.size("assumptions") > 0)
    return F.when(flagged, "NeedsAttention").otherwise("Ready")


def rejected(gated: DataFrame) -> DataFrame:
    return gated.where("field IS NOT NULL").select("entry_id", "doc_id", "group_id", "field", "question", "no_term")


TERM_WEEKS = 15


def term_questions(gated: DataFrame, today: str) -> DataFrame:
    """Per group: open questions by entry and field, whether a term is all it lacks, and the term to offer then.

    The term begins ``today`` and is a starting point for an answer; it is never applied.
    """
    distinct = rejected(gated).dropDuplicates(["group_id", "entry_id", "field"])
    per = distinct.groupBy("group_id").agg(
        F.count("*").alias("unresolved"),
        F.bool_or((F.col("field") == "Recurrence") & F.col("no_term")).alias("needs_term"),
    )
    return per.selectExpr(
        "*", f"IF(needs_term, DATE '{today}', NULL) AS offered_start", f"IF(needs_term, date_add(DATE '{today}', {7 * TERM_WEEKS}), NULL) AS offered_end"
    )


def assumption_questions(candidates: DataFrame, position: str, examples: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Per rule (and import, where ``keys`` name it): how many rows it filled, and the first few distinct titles."""
    by = [*(keys or []), "rule"]
    titles = (
        candidates.select(*(keys or []), F.explode("assumptions").alias("rule"), "title", position)
        .groupBy(*by, "title")
        .agg(F.count("*").alias("n"), F.min(position).alias("first"))
    )
    totals = titles.groupBy(*by).agg(F.sum("n").alias("affected"))
    ranked = titles.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("first"))).where(
        F.col("r") <= examples
    )
    names = ranked.groupBy(*by).agg(F.expr("array_join(transform(array_sort(collect_list(struct(r, title))), x -> x.title), '|')").alias("examples"))
    return totals.join(names, by).selectExpr(
        *by, f"IF(rule = '{ASSUMED_DAY}', 'StartTime', 'EndTime') AS field", "affected", "examples"
    )


def answer_assumptions(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Bulk answers per document and rule: Accept, UseTime, or Individually (no change)."""
    rows = candidates.withColumn("rule", F.expr("try_element_at(assumptions, 1)"))
    rows = rows.join(answers, ["doc_id", "rule"], "left")
    rows = rows.selectExpr(
        "*",
        "coalesce(answer = 'Accept', false) AS takes",
        "coalesce(answer = 'UseTime' AND all_day AND use_minutes > 0, false) AS timed",
    )
    out = rows.withColumns(
        {
            "assumptions": F.expr("IF(takes OR timed, array_remove(assumptions, rule), assumptions)"),
            "provided": F.expr(
                "concat(provided, CASE WHEN takes THEN array(concat('assumption:', rule)) "
                "WHEN timed THEN array('startTime', 'endTime') ELSE array() END)"
            ),
            "end_date": F.expr("IF(timed, date_add(start_date, CAST((use_start + use_minutes) div 1440 AS INT)), end_date)"),
            "end_min": F.expr("IF(timed, CAST((use_start + use_minutes) % 1440 AS INT), end_min)"),
            "start_min": F.expr("IF(timed, use_start, start_min)"),
            "all_day": F.expr("all_day AND NOT timed"),
        }
    )
    return out.withColumn("status", status()).drop("rule", "answer", "use_start", "use_minutes", "takes", "timed")


def apply_edits(candidates: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits over candidates; a blank title or an end not after the start is refused.

    A timed edit settles assumptions about what it changed and makes the row ready; an edit that leaves the row all-day, or makes
    it so (``to_all_day``), keeps both.  ``new_location`` is where it takes place from now on, blank for nowhere.
    """
    rows = candidates.join(edits, "entry_id", "left")
    rows = rows.selectExpr(
        "*",
        "new_title IS NOT NULL OR new_date IS NOT NULL OR new_start IS NOT NULL OR new_location IS NOT NULL OR coalesce(to_all_day, false) AS asked",
        "trim(coalesce(new_title, title)) AS t2",
        "coalesce(new_date, start_date) AS d2",
        "coalesce(new_start, start_min) AS s2",
        "coalesce(new_end, end_min) AS e2",
        "datediff(end_date, start_date) AS span",
        "all_day AND new_start IS NULL OR coalesce(to_all_day, false) AS stays_day",
        "new_location IS NOT NULL AND NOT new_location <=> location AS moved",
    )
    rows = rows.selectExpr(
        "*",
        "IF(new_end IS NOT NULL OR stays_day, IF(stays_day, 1, 0), span) AS days2",
    ).selectExpr(
        "*",
        "asked AND (t2 = '' OR NOT (stays_day OR days2 * 1440 + e2 > s2)) AS refused",
    )
    rows = rows.selectExpr(
        "*",
        """array_compact(array(IF(t2 <> title, 'title', NULL), IF(stays_day AND (NOT all_day OR d2 <> start_date), 'date', NULL),
            IF(NOT stays_day AND (d2 <> start_date OR NOT s2 <=> start_min), 'start', NULL),
            IF(NOT stays_day AND (date_add(d2, days2) <> end_date OR NOT e2 <=> end_min), 'end', NULL), IF(moved, 'location', NULL))) AS changed""",
    ).selectExpr("*", "asked AND NOT refused AND size(changed) > 0 AS applied")
    settle = """filter(assumptions, a -> NOT (NOT stays_day AND ((a = 'assumed-duration' AND array_contains(changed, 'end'))
        OR (a = 'all-day-from-date-only' AND array_contains(changed, 'start')))))"""
    return rows.selectExpr(
        "entry_id", "doc_id", "IF(applied, t2, title) AS title",
        "IF(applied, d2, start_date) AS start_date", "IF(applied, IF(stays_day, NULL, s2), start_min) AS start_min",
        "IF(applied, date_add(d2, days2), end_date) AS end_date", "IF(applied, IF(stays_day, NULL, e2), end_min) AS end_min",
        "IF(applied, stays_day, all_day) AS all_day", "IF(applied AND moved, nullif(trim(new_location), ''), location) AS location",
        "IF(applied AND by_weekday IS NOT NULL AND NOT stays_day, weekday(d2) + 1, by_weekday) AS by_weekday",
        f"IF(applied, {settle}, assumptions) AS assumptions",
        "IF(applied AND NOT stays_day, 'Ready', status) AS status",
        "IF(applied, changed, array()) AS changed", "refused",
    )


def reminder_candidates(entries: DataFrame, anchor_min: int = 540) -> DataFrame:
    """One-off reminders: a title and a date are required; no time means all day, due at the anchor."""
    return entries.selectExpr(
        "entry_id", "doc_id",
        f"CASE WHEN NOT {usable('title')} THEN 'Title' WHEN NOT {usable('date')} THEN 'Date' END AS field",
        f"IF({usable('title')} AND {usable('date')}, title, NULL) AS title",
        f"IF({usable('title')} AND {usable('date')}, date, NULL) AS due_date",
        f"IF({usable('start')}, start_min, {anchor_min}) AS due_min",
        f"NOT {usable('start')} AS all_day",
        "IF(title_level = 'Low' OR date_level = 'Low' OR start_level = 'Low', 'NeedsAttention', 'Ready') AS status",
    )


def manual_entries(forms: DataFrame) -> DataFrame:
    """Typed-in events in the shape of entries; every field given is High."""
    given = "IF({0} IS NULL, 'Missing', 'High') AS {1}_level"
    return forms.selectExpr(
        "entry_id", "doc_id", "group_id", "kind",
        "nullif(trim(title), '') AS title", given.format("nullif(trim(title), '')", "title"),
        "date", given.format("date", "date"), "weekday", given.format("weekday", "weekday"),
        "start_min", given.format("start_min", "start"), "end_min", given.format("end_min", "end"),
        "nullif(trim(location), '') AS location", given.format("nullif(trim(location), '')", "location"),
    )


def review_summary(candidates: DataFrame) -> DataFrame:
    """Per document and weekday: ready and flagged rows, and how many start ticked."""
    ticked = "status = 'Ready' OR (NOT read_weakly AND forall(assumptions, a -> a = 'assumed-duration'))"
    return candidates.selectExpr(
        "doc_id", "coalesce(by_weekday, weekday(start_date) + 1) AS day", "status", f"{ticked} AS ticked"
    ).groupBy("doc_id", "day").agg(
        F.count_if(F.col("status") == "Ready").alias("ready"),
        F.count_if(F.col("status") == "NeedsAttention").alias("attention"),
        F.count_if("ticked").alias("ticked"),
    )
