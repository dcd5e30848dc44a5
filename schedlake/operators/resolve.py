"""Evidence inside a document, and what it says about each ambiguous value.

Evidence is a small aggregate per document (combined before the shuffle) that
joins back to the rows, so a document of any size is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions import dates as D
from schedlake.functions import times as T
from schedlake.functions.ordered import ordered_scan, previous_row
from schedlake.operators.tokens import date_tokens
from schedlake.session import written

# Results depend on them.
MIN_SEQUENCE = 4
MIN_COLUMN = 3


def locate_dates(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Date matches of each line with both dates and the weekday the line states."""
    tokens = date_tokens(
        lines.selectExpr(*keys, text, f"{D.first_weekday(text)} AS stated_weekday"), [*keys, "stated_weekday"], text
    )
    return tokens.where(f"family <> {D.WEEKDAY}").selectExpr(
        *keys, "start", "raw", "n_readings", "proven_order", "stated_weekday", "year",
        f"{D.real_date('day1', 'month1', 'year')} AS date1",
        f"{D.real_date('day2', 'month2', 'year')} AS date2",
        "day1", "month1", "day2", "month2",
    )


def sibling_order(dates: DataFrame, keys: list[str]) -> DataFrame:
    """The one order that unambiguous dates of a document prove; contradiction proves nothing."""
    proofs = dates.where("proven_order IS NOT NULL").groupBy(*keys)
    both = proofs.agg(F.min("proven_order").alias("a"), F.max("proven_order").alias("b"))
    return both.where("a = b").select(*keys, F.col("a").alias("sibling"))


def weekday_vote() -> Column:
    """Order under which an ambiguous date falls on the weekday stated beside it."""
    first = F.coalesce(F.expr("weekday(date1) + 1 = stated_weekday"), F.lit(False))
    second = F.coalesce(F.expr("weekday(date2) + 1 = stated_weekday"), F.lit(False))
    asked = (F.col("n_readings") == 2) & F.col("stated_weekday").isNotNull()
    return F.when(asked & first & ~second, D.DAY_FIRST).when(asked & second & ~first, D.MONTH_FIRST)


def weekday_order(dates: DataFrame, keys: list[str]) -> DataFrame:
    votes = dates.select(*keys, weekday_vote().alias("vote")).where("vote IS NOT NULL").groupBy(*keys)
    both = votes.agg(F.min("vote").alias("a"), F.max("vote").alias("b"))
    return both.where("a = b").select(*keys, F.col("a").alias("by_weekday"))


def sequence_order(
    dates: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None
) -> DataFrame:
    """The one reading under which at least four ambiguous dates strictly increase."""
    open_dates = dates.where("n_readings = 2").select(*keys, *order, "date1", "date2")
    stepped = previous_row(open_dates, keys, order, ["date1", "date2"], "prev", bucket)
    runs = stepped.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("date1").isNotNull() & F.col("date2").isNotNull()).alias("complete"),
        F.bool_and(F.coalesce(F.col("prev.date1") < F.col("date1"), F.col("prev").isNull())).alias("up1"),
        F.bool_and(F.coalesce(F.col("prev.date2") < F.col("date2"), F.col("prev").isNull())).alias("up2"),
    )
    return runs.where((F.col("n") >= MIN_SEQUENCE) & F.col("complete") & (F.col("up1") != F.col("up2"))).select(
        *keys, F.when(F.col("up1"), D.DAY_FIRST).otherwise(D.MONTH_FIRST).alias("by_sequence")
    )


def document_evidence(
    dates: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None, answers: DataFrame | None = None
) -> DataFrame:
    """One row for each document that proves something, with all it proves and what the user said.

    A written table: rows meet it in one join of two plain shuffles, in which AQE may split a hot document.
    """
    votes = dates.select(*keys, "proven_order", weekday_vote().alias("vote")).where("proven_order IS NOT NULL OR vote IS NOT NULL")
    both = votes.groupBy(*keys).agg(
        *[f(c).alias(f"{name}_{c}") for c in ("proven_order", "vote") for name, f in (("a", F.min), ("b", F.max))]
    )
    said = both.selectExpr(
        *keys, "IF(a_proven_order = b_proven_order, a_proven_order, NULL) AS sibling", "IF(a_vote = b_vote, a_vote, NULL) AS by_weekday"
    )
    said = said.join(sequence_order(dates, keys, order, bucket), keys, "full")
    if answers is None:
        said = said.withColumn("user_order", F.lit(None).cast("string"))
    else:
        said = said.join(answers.select(*keys, "user_order"), keys, "full")
    return written(said, "evidence")


def resolve_dates(
    dates: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column | None = None,
    answers: DataFrame | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Adds ``evidence`` and ``resolved``, NULL where two readings stay open, and ``asks``: Order, Year, or NULL.

    ``answers`` (keys, user_order, perhaps assumed_year) outranks what the document says about itself; a year counts for
    dates without one.  With ``by`` (columns of ``answers``) a document may have several answers: its dates are read and its
    evidence is gathered once, and every date comes out under each of them.
    """
    several = answers if by or answers is not None and "assumed_year" in answers.columns else None
    out = dates.join(document_evidence(dates, keys, order, bucket, None if several is not None else answers), keys, "left")
    if several is not None:
        said = several.select(*keys, *by, *[c for c in ("user_order", "assumed_year") if c in several.columns])
        out = out.drop("user_order").join(said, keys, "inner" if by else "left")
        for c in {"user_order": "string", "assumed_year": "int"}.items():
            if c[0] not in said.columns:
                out = out.withColumn(c[0], F.lit(None).cast(c[1]))
        year = "coalesce(year, assumed_year)"
        out = out.withColumns({"date1": F.expr(D.real_date("day1", "month1", year)), "date2": F.expr(D.real_date("day2", "month2", year))})
    decided = F.coalesce("user_order", "sibling", "by_weekday", "by_sequence")
    how = (
        F.when(F.col("user_order").isNotNull(), "UserChoice")
        .when(F.col("sibling").isNotNull(), "SiblingDate")
        .when(F.col("by_weekday").isNotNull(), "WeekdayAgreement")
        .when(F.col("by_sequence").isNotNull(), "SequenceCoherence")
    )
    n_dates = F.col("date1").isNotNull().cast("int") + F.col("date2").isNotNull().cast("int")
    vote = weekday_vote()
    evidence = F.when(n_dates == 1, "Unambiguous").when(n_dates == 2, F.when(vote.isNotNull(), "WeekdayAgreement").otherwise(how))
    side = F.coalesce(vote, decided)
    resolved = F.when(n_dates == 1, F.coalesce("date1", "date2")).when(
        n_dates == 2, F.when(side == D.DAY_FIRST, F.col("date1")).when(side == D.MONTH_FIRST, F.col("date2"))
    )
    no_year = F.col("year").isNull() if several is None else F.col("year").isNull() & F.col("assumed_year").isNull()
    asks = F.when((F.col("n_readings") > 0) & no_year, "Year").when((n_dates == 2) & side.isNull(), "Order")
    return out.withColumns({"evidence": evidence, "resolved": resolved, "asks": asks}).drop(
        "sibling", "by_weekday", "by_sequence", "user_order", "assumed_year"
    )


def date_questions(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """What a document has to ask about its dates, each question once: the order with both readings, or the year."""
    return resolved.where("asks IS NOT NULL").selectExpr(
        *keys, "asks", "raw", "IF(asks = 'Order', date1, NULL) AS day_first", "IF(asks = 'Order', date2, NULL) AS month_first"
    ).distinct()


# ---- morning or evening ----

WRITTEN, BY_24H, BY_ORDER, OPEN = "written", "24h", "order", "open"
REASONS = {  # fixed wording: results carry it
    BY_24H: "this column uses 24-hour times",
    BY_ORDER: "read from the order of times in this column",
    OPEN: "couldn't tell if this is morning or evening",
}


# With ``k`` unmarked times AM, every neighbouring pair of a strictly increasing
# column bounds ``k`` from below or above.
_LOW = """CASE WHEN prev IS NULL THEN 0
    WHEN prev.u_am IS NOT NULL AND u_am IS NOT NULL THEN IF(u_am <= prev.u_am, rank - 1, 0)
    WHEN prev.v IS NOT NULL AND u_am IS NOT NULL THEN IF(prev.v < u_am + 720, 0, rank)
    WHEN prev.u_am IS NOT NULL AND v IS NOT NULL THEN IF(prev.u_am + 720 < v, 0, rank)
    WHEN prev.v < v THEN 0 ELSE 9223372036854775807 END"""
_HIGH = """CASE WHEN prev IS NULL THEN NULL
    WHEN prev.u_am IS NOT NULL AND u_am IS NOT NULL THEN IF(u_am <= prev.u_am, rank - 1, NULL)
    WHEN prev.v IS NOT NULL AND u_am IS NOT NULL THEN IF(prev.v < u_am, NULL, rank - 1)
    WHEN prev.u_am IS NOT NULL AND v IS NOT NULL THEN IF(prev.u_am < v, NULL, rank - 1) END"""


def column_notation(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Whether every time of a column is settled as written, and whether one proves 24 hours."""
    return tokens.groupBy(*keys).agg(
        F.bool_and(F.col("written").isNotNull()).alias("all_written"), F.bool_or("proof").alias("proof")
    )


def side_tokens(ranges: DataFrame, keys: list[str], order: list[str], side: str, other: str) -> DataFrame:
    """Start or end times of parsed ranges as meridiem input; the other side is context."""
    h, m, mer, padded = (f"{side}_{x}" for x in ("hour", "minute", "mer", "padded"))
    proof_other = T.proves_24h(f"{other}_hour", f"{other}_mer", f"{other}_padded")
    return ranges.where(f"{h} IS NOT NULL").selectExpr(
        *keys, *order,
        f"{mer} AS mer",
        f"{T.as_written(h, m, mer)} AS written",
        f"{T.literal(h, m)} AS literal",
        f"{T.clock_valid(h, m)} AS valid",
        f"{T.morning(h, m)} AS am",
        f"{T.proves_24h(h, mer, padded)} OR coalesce({proof_other}, false) AS proof",
    )


def resolve_meridiem(
    tokens: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column | None = None,
    context: DataFrame | None = None,
) -> DataFrame:
    """Adds ``minutes``, ``inferred`` and ``reason`` to each time of a column.

    A column settled as written, or proved to use 24 hours, needs no more.  Else
    its unmarked times switch from AM to PM once, and exactly one number of AM
    times must make it strictly increase: that number follows from one max and
    one min over neighbouring pairs, so no split is tried and no length is too long.

    ``context`` (keys, context_proof) lets times outside the column prove 24-hour notation.
    """
    marked = tokens.selectExpr(
        "*", "IF(mer = 'Unstated', NULL, written) AS v", "IF(mer = 'Unstated', am, NULL) AS u_am",
        "int(mer = 'Unstated') AS u",
    )
    rows = ordered_scan(marked, keys, order, bucket, totals={"rank": F.col("u")}, previous={"prev": ["v", "u_am"]})
    facts = rows.groupBy(*keys).agg(
        F.bool_and(F.col("written").isNotNull()).alias("all_written"),
        F.bool_or("proof").alias("proven"),
        F.count("*").alias("n"),
        F.bool_and("valid").alias("all_valid"),
        F.sum("u").alias("unmarked"),
        F.max(F.expr(_LOW)).alias("low"),
        F.min(F.expr(_HIGH)).alias("high"),
    )
    if context is None:
        facts = facts.withColumn("context_proof", F.lit(False))
    else:
        facts = facts.join(context, keys, "left")
    facts = facts.selectExpr(
        *keys, "NOT all_written AND (proven OR coalesce(context_proof, false)) AS proven",
        f"IF(n >= {MIN_COLUMN} AND all_valid AND low = least(unmarked, coalesce(high, unmarked)), low, NULL) AS split",
    )
    return _settle(rows.join(facts, keys, "left"), keys, order)


def _settle(out: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rule = f"""CASE WHEN written IS NOT NULL THEN '{WRITTEN}' WHEN proven THEN '{BY_24H}'
        WHEN split IS NOT NULL THEN '{BY_ORDER}' ELSE '{OPEN}' END"""
    minutes = """coalesce(written, CASE WHEN proven THEN literal
        WHEN split IS NOT NULL THEN IF(rank <= split, am, am + 720) END)"""
    reasons = " ".join(f'WHEN \'{r}\' THEN "{t}"' for r, t in REASONS.items())
    return out.selectExpr(
        *keys, *order, f"{minutes} AS minutes", f"{rule} IN ('{BY_24H}', '{BY_ORDER}') AS inferred",
        f"CASE {rule} {reasons} END AS reason",
    )


def resolve_slots(ranges: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """Start and end minutes of each range of a column; both sides share one clock notation."""
    ranges = written(ranges, "ranges")
    proof = " OR ".join(
        f"coalesce({T.proves_24h(f'{x}_hour', f'{x}_mer', f'{x}_padded')}, false)" for x in ("start", "end")
    )
    context = ranges.groupBy(*keys).agg(F.bool_or(F.expr(proof)).alias("context_proof"))
    sides = []
    for side, other in (("start", "end"), ("end", "start")):
        tokens = side_tokens(ranges, keys, order, side, other)
        solved = resolve_meridiem(tokens, keys, order, bucket, context)
        sides.append(
            solved.withColumnsRenamed({"minutes": f"{side}_min", "inferred": f"{side}_inferred", "reason": f"{side}_reason"})
        )
    return sides[0].join(sides[1], [*keys, *order], "left")


def lone_time(side: str, other: str) -> str:
    """Minutes of a time that stands alone: as written, or literal once either side proves 24 hours."""
    proof = " OR ".join(
        f"coalesce({T.proves_24h(f'{x}_hour', f'{x}_mer', f'{x}_padded')}, false)" for x in (side, other)
    )
    own = T.as_written(f"{side}_hour", f"{side}_minute", f"{side}_mer")
    return f"coalesce({own}, IF({proof}, {T.literal(f'{side}_hour', f'{side}_minute')}, NULL))"


def apply_answers(tokens: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Reads date tokens again with what the user said: the order and a year for yearless dates."""
    out = tokens.join(answers, keys, "left").withColumn("year", F.coalesce("year", "assumed_year"))
    return out.selectExpr(
        "*",
        f"""CASE WHEN n_readings = 1 OR user_order = '{D.DAY_FIRST}' THEN {D.real_date('day1', 'month1', 'year')}
            WHEN user_order = '{D.MONTH_FIRST}' THEN {D.real_date('day2', 'month2', 'year')} END AS date""",
        "n_readings = 2 AND user_order IS NULL AS asks_order",
        "year IS NULL AS asks_year",
    )
