"""Token tables: dates, times, labels, rooms and titles found in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions import dates as D
from schedlake.functions import times as T
from schedlake.functions import vocabulary as V
from schedlake.functions.once import by_value, once
from schedlake.functions.ordered import previous_row


def read_token(df: DataFrame) -> DataFrame:
    """Adds the readings of a date token (columns ``raw``, ``family``)."""
    dated, numeric = f"family <> {D.WEEKDAY}", f"family = {D.NUMERIC}"
    parts = once(df, {"p": D.written_parts("raw", "family")})
    return (
        once(parts, {f"__{n}": e for n, e in D.part_numbers("p").items()})
        .selectExpr(
            "*",
            f"{dated} AND {D.calendar_valid('__first', '__second', '__year')} AS __df",
            f"{numeric} AND {D.calendar_valid('__second', '__first', '__year')} AS __mf",
        )
        .selectExpr(
            *df.columns,
            "__year AS year",
            "CASE WHEN __df AND __mf AND __first <> __second THEN 2 WHEN __df OR __mf THEN 1 ELSE 0 END AS n_readings",
            "CASE WHEN __df THEN __first WHEN __mf THEN __second END AS day1",
            "CASE WHEN __df THEN __second WHEN __mf THEN __first END AS month1",
            "CASE WHEN __df AND __mf AND __first <> __second THEN __second END AS day2",
            "CASE WHEN __df AND __mf AND __first <> __second THEN __first END AS month2",
            f"IF({dated}, NULL, {D.weekday_number('raw')}) AS weekday",
            f"IF({dated} AND NOT __df AND NOT __mf, {D.invalid_reason('__first', '__second', '__year')}, NULL) AS invalid_reason",
            f"CASE WHEN {numeric} AND __df AND NOT __mf THEN '{D.DAY_FIRST}' "
            f"WHEN {numeric} AND __mf AND NOT __df THEN '{D.MONTH_FIRST}' END AS proven_order",
        )
    )


def date_tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per surviving date match of a line, with offset and readings."""
    # explode_outer: a plain explode would also copy the expression into a filter.
    found = df.selectExpr(*keys, f"explode_outer({D.drop_overlaps(D.date_tokens(text))}) AS m")
    return read_token(found.where("m IS NOT NULL").select(*keys, "m.start", "m.raw", "m.family"))


def overlap_report(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Candidates and survivors of overlap elimination per line."""
    staged = once(df.select(*keys, text), {"__found": D.date_tokens(text)}).where("size(__found) > 0")
    staged = once(staged.selectExpr(*keys, "__found"), {"kept": D.drop_overlaps("__found")}).selectExpr(*keys, "size(__found) AS found", "kept")
    return staged.selectExpr(
        *keys, "found", "size(kept) AS kept", "array_join(transform(kept, t -> t.raw), '|') AS kept_raw"
    )


def time_tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per time or time range of a line."""
    found = df.selectExpr(*keys, f"explode_outer({T.time_spans(text)}) AS m").where("m IS NOT NULL")
    return once(found, {"p": T.clock_parts("m.raw", "m.is_range")}).selectExpr(
        *keys, "m.start", "trim(m.raw) AS raw", "m.is_range", "p"
    ).selectExpr(*keys, "start", "raw", "is_range", *[f"{e} AS {n}" for n, e in T.clock_fields("p").items()])


def room_score(text: Column) -> Column:
    value = F.trim(text)
    return (
        F.when((value == "") | (F.length(value) > 20), 0)
        .when(value.rlike(V.ROOM_COMPOUND) | value.rlike(V.ROOM_KEYWORD), 2)
        .when(value.rlike(V.ROOM_SIMPLE) | value.rlike(V.ROOM_NUMERIC), 1)
        .otherwise(0)
    )


def names_instructor(text: Column) -> Column:
    return F.trim(text).rlike(V.INSTRUCTOR_PREFIX)


def subject_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Splits a cell into subject, room and instructor.

    The most room-like part is the room (the later one on a tie), the first
    remaining part with a title prefix the instructor, the next the subject.
    """
    bare = F.transform(
        F.split(F.col(text), V.SUBJECT_SPLITTERS), lambda p: F.regexp_replace(F.trim(p), r"^[()\[\]\-,]+|[()\[\]\-,]+$", "")
    )
    df = df.withColumn("__parts", F.filter(bare, lambda p: p != ""))
    scored = F.transform(
        F.col("__parts"),
        lambda p: F.struct(
            (room_score(p) * 10 + F.array_position(F.col("__parts"), p).cast("int")).alias("s"), p.alias("p")
        ),
    )
    best = F.array_max(F.filter(scored, lambda x: x["s"] >= 10 + F.array_position(F.col("__parts"), x["p"]).cast("int")))
    df = df.withColumn("location", best["p"])
    others = F.filter("__parts", lambda p: F.col("location").isNull() | (p != F.col("location")))
    df = df.withColumn("__others", others)
    df = df.withColumn("instructor", F.try_element_at(F.filter("__others", names_instructor), F.lit(1)))
    subjects = F.filter("__others", lambda p: F.col("instructor").isNull() | (p != F.col("instructor")))
    df = df.withColumn("subject", F.try_element_at(subjects, F.lit(1)))
    whole = F.col("subject").isNotNull()
    return df.withColumns(
        {"location": F.when(whole, F.col("location")), "instructor": F.when(whole, F.col("instructor"))}
    ).drop("__parts", "__others")


def column_roles(cells: DataFrame, keys: list[str], threshold: float = 0.6) -> DataFrame:
    """What each column holds, by the share of its non-empty cells that look so; Unknown where all are empty.

    ``keys`` end with the column: the columns of a sheet run from 0 to its last one, also where no cell is given.
    """
    filled = once(cells.where("trim(text) <> ''"), {"__t": "trim(text)"}).selectExpr(*keys, "__t AS text")

    def read(texts: DataFrame) -> DataFrame:
        return texts.selectExpr(
            "text",
            f"{D.names_weekday('text')} AS weekday",
            f"{T.holds_time('text')} AS time",
            f"{D.holds_reading('text')} AS date",
            f"text RLIKE r'{V.INSTRUCTOR_PREFIX}' AS person",
        ).withColumn("room", room_score(F.col("text")) > 0)

    tests = by_value(filled, ["text"], read, "role-texts")
    shares = tests.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("weekday").alias("weekdays"),
        F.count_if("time").alias("times"),
        F.count_if("date").alias("dates"),
        F.count_if("room").alias("rooms"),
        F.count_if("person").alias("people"),
    )
    *sheet, column = keys
    wide = cells.groupBy(*sheet).agg(F.max(column).alias("__last"))
    columns = wide.selectExpr(*sheet, f"explode(sequence(0, CAST(__last AS INT))) AS {column}")
    shares = columns.join(shares, keys, "left").fillna(0, ["n", "weekdays", "times", "dates", "rooms", "people"])
    return shares.selectExpr(
        "*",
        f"""CASE WHEN n = 0 THEN 'Unknown' WHEN weekdays / n >= {threshold} THEN 'Weekday' WHEN times / n >= {threshold} THEN 'Time'
        WHEN dates / n >= {threshold} THEN 'Date' WHEN rooms / n >= {threshold} THEN 'Location'
        WHEN people / n >= {threshold} THEN 'Instructor' ELSE 'Subject' END AS role""",
    )


def _alternatives(words: tuple[str, ...]) -> str:
    return "|".join(words)


def labelled_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """``label: value`` lines with their role; lines that are none are dropped."""
    staged = once(df, {"__f": f"split({text}, r'{V.FIELD_SEPARATOR}', 2)"}).where("size(__f) = 2")
    squeeze = r"trim(regexp_replace(__f[{0}], r'\s+', ' '))"
    staged = once(staged, {"label": squeeze.format(0), "value": squeeze.format(1)}).where(
        "label <> '' AND length(label) <= 34 AND value <> ''"
    )
    staged = once(staged, {"__name": r"regexp_replace(lower(label), r'^[ \t*().,\-#]+|[ \t*().,\-#]+$', '')"}).drop("__f")
    name = F.col("__name")
    role = (
        F.when(name.rlike(f"(?:^| )(?:{_alternatives(V.TIME_LABELS)})$"), "Time")
        .when(name.rlike(_alternatives(V.DATE_LABELS)), "When")
        .when(name.isin(*V.SUBJECT_LABELS), "Subject")
        .when(name.isin(*V.WHERE_LABELS), "Where")
    )
    return staged.withColumn("role", role).where("role IS NOT NULL").drop("__name")


def document_kind(lines: DataFrame, keys: list[str], order: str = "line_no", text: str = "text") -> DataFrame:
    """Kind of a document by the cue words in it; travel before appointment, deadline, event.

    A text is searched once however many lines hold it.  A cue broken over two lines has a space where they meet, so only
    lines that begin with what follows a space in some cue are looked at together with the end of the line before,
    and a document never has to be one string.
    """
    lines = previous_row(lines.select(*keys, order, text), keys, [order], [text], "prev")
    lines = by_value(lines, [text], lambda texts: cue_texts(texts, text), "cue-texts", "left")
    ranks = line_rank(F.col(text), F.col("prev")[text], F.col("rank"), F.col("follows"))
    return lines.groupBy(*keys).agg(F.min(ranks).alias("rank")).select(*keys, kind_name(F.col("rank")).alias("kind"))


_RANKED = (V.TRAVEL_CUES, V.APPOINTMENT_CUES, V.DEADLINE_CUES, V.EVENT_CUES)
_CUES = [cue for group in _RANKED for cue in group]


def _cue_rank(lower: Column) -> Column:
    found = [F.when(lower.rlike(_alternatives(group)), i) for i, group in enumerate(_RANKED, 1)]
    return F.coalesce(*found, F.lit(len(_RANKED) + 1))


def cue_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """The ``rank`` of the cues in a text, and whether it ``follows``: begins with what comes after a space in some cue."""
    after = sorted({cue[i + 1:] for cue in _CUES for i, c in enumerate(cue) if c == " "})
    lower = F.lower(text)
    return texts.select(text, _cue_rank(lower).alias("rank"), lower.rlike(f"^(?:{_alternatives(after)})").alias("follows"))


def line_rank(text: Column, prev: Column, rank: Column, follows: Column) -> Column:
    """The rank of a line: that of its text, or of a cue broken over the end of the line before."""
    reach = max(map(len, _CUES)) - 1
    seam = F.lower(F.concat_ws(" ", F.right(prev, F.lit(reach)), F.left(text, F.lit(reach + 1))))
    return F.least(F.coalesce(rank, F.lit(len(_RANKED) + 1)), F.when(follows & prev.isNotNull(), _cue_rank(seam)))


def kind_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("Travel", "Appointment", "Deadline", "Event", "Unknown"))), rank)


TRIM = r" :\-–—,.()|\t"


def trim_title(text: Column) -> Column:
    """Outer punctuation off, then dangling last words off, repeatedly."""
    bare = F.trim(F.regexp_replace(text, f"^[{TRIM}]+|[{TRIM}]+$", ""))
    words = "|".join(V.DANGLING_WORDS)
    return F.regexp_replace(bare, rf"(?i)(?:[{TRIM}]* [{TRIM}]*(?:{words}))+$", "")


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def letter_share_ok(text: Column) -> Column:
    return letters(text) * 2 >= F.regexp_count(text, F.lit(r"\S"))


def names_something(text: Column) -> Column:
    """A name someone gave, not a figure, a sentence or narration."""
    first = F.regexp_replace(F.lower(F.substring_index(text, " ", 1)), f"^[{TRIM}]+|[{TRIM}]+$", "")
    return F.coalesce(
        F.length(text).between(3, 46)
        & (letters(text) >= 3)
        & letter_share_ok(text)
        & ~first.isin(*V.NARRATION_OPENERS)
        & text.rlike(r"^\p{L}"),
        F.lit(False),
    )


def is_column_header(text: Column) -> Column:
    """Header words only; a word of punctuation is none, so ``Date - Time`` is not a header."""
    words = F.filter(F.split(F.lower(text), r"[ \t]"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, f"^[{TRIM}]+|[{TRIM}]+$", ""))
    return (F.size(bare) > 0) & F.forall(bare, lambda w: w.isin(*V.COLUMN_HEADER_WORDS))


def header_role(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return (
        F.when(bare.rlike(_alternatives(V.HEADER_TIME_WORDS)), "Time")
        .when(bare.rlike(_alternatives(V.HEADER_DATE_WORDS)), "Date")
        .when(bare.rlike(_alternatives(V.HEADER_PLACE_WORDS)), "Place")
        .otherwise("Subject")
    )


def heads_dates(text: Column) -> Column:
    """Whether ``header_role`` is Date; of most cells one pattern tells that it is not."""
    bare = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return bare.rlike(_alternatives(V.HEADER_DATE_WORDS)) & ~bare.rlike(_alternatives(V.HEADER_TIME_WORDS))


def table_title_ok(text: Column) -> Column:
    """A table cell that can name an event: letters, and not itself a header word."""
    value = F.trim(text)
    return (
        (F.length(value) >= 3) & (letters(value) >= 3) & letter_share_ok(value) & (header_role(value) == "Subject")
    )


def unglue(text: Column) -> Column:
    """``18/09/202614:35`` → ``18/09/2026 14:35``."""
    return F.regexp_replace(text, r"(\d{4})(\d{1,2}:\d{2})", "$1 $2")


def split_heading(text: Column) -> Column:
    """Puts the space back before words a wrapped heading glued on."""
    for word in V.GLUED_WORDS:
        text = F.regexp_replace(text, rf"(?i)([a-z])({word})\b", "$1 $2")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def comparison_key(text: Column) -> Column:
    squeezed = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.trim(F.regexp_replace(squeezed, r"[^\p{L}\p{Nd} ]", ""))


def similarity(left: Column, right: Column) -> Column:
    """1 − edit distance over the longer key; equal keys 1, an empty one 0."""
    longer = F.greatest(F.length(left), F.length(right))
    return (
        F.when(left == right, 1.0)
        .when((left == "") | (right == ""), 0.0)
        .otherwise(1.0 - F.levenshtein(left, right) / longer)
    )


def column_letters(index: Column) -> Column:
    """0 → A, 25 → Z, 26 → AA: bijective base 26, up to three letters and beyond by sequence."""
    seed = F.struct(index.cast("long").alias("rest"), F.lit("").alias("name"))

    def step(acc: Column, _: Column) -> Column:
        more = acc["rest"] >= 0
        return F.struct(
            F.when(more, F.floor(acc["rest"] / 26) - 1).otherwise(acc["rest"]).alias("rest"),
            F.when(more, F.concat(F.char(acc["rest"] % 26 + 65), acc["name"])).otherwise(acc["name"]).alias("name"),
        )

    # A 64-bit index never needs more than fourteen letters.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), seed, step, lambda acc: acc["name"])


def cell_reference(ref: Column) -> dict[str, Column]:
    """``C25`` → row 24, column 2; NULL where the text is no reference."""
    parts = F.regexp_extract(ref, r"^([A-Za-z]+)(\d+)$", 1)
    number = F.regexp_extract(ref, r"^([A-Za-z]+)(\d+)$", 2)
    column = F.aggregate(
        F.split(F.upper(parts), ""),
        F.lit(0),
        lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 26 + F.ascii(ch) - 64),
    )
    ok = (parts != "") & (number != "")
    return {"row_no": F.when(ok, number).cast("int") - 1, "col": F.when(ok, column - 1)}
