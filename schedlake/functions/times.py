"""Clock times in text as SQL expressions."""

from __future__ import annotations

from schedlake.functions import vocabulary as V
from schedlake.functions.spans import raw, spans

TIMES = "array<struct<start:int,raw:string,is_range:boolean>>"
NO_TIMES = f"CAST(array() AS {TIMES})"
# A cheap test passed by every text that holds a time.
_GATE = r"\d[:.]\d\d|\d\s*[aApP]\.?[mM]|\d\s*(?:[-–—]|to)\s*\d"


def _glued_to_date(text: str) -> str:
    """A separator and a digit on either side make span ``s`` part of a numeric date."""
    after = f"substring({text}, s.start + length(s.raw) + 1, 2) RLIKE {raw(r'^[/.-][0-9]')}"
    before = f"s.start >= 2 AND substring({text}, s.start - 1, 2) RLIKE {raw(r'^[0-9][/.-]')}"
    return f"({after} OR ({before}))"


def time_spans(text: str) -> str:
    """Ranges, and singles no range covers, in text order: array<start, raw, is_range>."""
    loose = f"NOT {_glued_to_date(text)}"
    marked = f"s.raw RLIKE {raw(r'^[0-9]{1,2}[:.][0-9]{2}|[aApP][.]?[mM]')}"
    tag = "s -> named_struct('start', s.start, 'raw', s.raw, 'is_range', {})".format
    ranges = f"transform(filter({spans(text, V.TIME_RANGE)}, s -> {loose}), {tag('true')})"
    singles = f"transform(filter({spans(text, V.TIME_SINGLE)}, s -> {marked} AND {loose}), {tag('false')})"
    covered = (
        "exists(kept, r -> r.is_range AND r.start <= one.start "
        "AND one.start + length(one.raw) <= r.start + length(r.raw))"
    )
    merged = f"aggregate({singles}, {ranges}, (kept, one) -> IF({covered}, kept, concat(kept, array(one))))"
    return f"IF({text} RLIKE {raw(_GATE)}, array_sort({merged}), {NO_TIMES})"


def holds_time(text: str) -> str:
    return f"(size({time_spans(text)}) > 0)"


def clock_parts(token: str, is_range: str) -> str:
    """``[hour, minute, marker, hour, minute, marker]`` as written; one match per token."""
    return (
        f"split(IF({is_range}, regexp_replace({token}, {raw(V.TIME_RANGE)}, '$1|$2|$3|$4|$5|$6'), "
        f"regexp_replace({token}, {raw(V.TIME_SINGLE)}, '$1|$2|$3|||')), '[|]')"
    )


def _meridiem(marker: str) -> str:
    plain = f"lower(regexp_replace({marker}, '[. ]', ''))"
    return f"CASE {plain} WHEN 'am' THEN 'Am' WHEN 'pm' THEN 'Pm' ELSE 'Unstated' END"


def clock_fields(p: str) -> dict[str, str]:
    """Hour, minute, meridiem and padding of both ends; an end marker governs an unmarked start."""
    start, end = _meridiem(f"{p}[2]"), f"IF({p}[3] <> '', {_meridiem(p + '[5]')}, NULL)"
    return {
        "start_hour": f"try_cast({p}[0] AS INT)",
        "start_minute": f"coalesce(try_cast({p}[1] AS INT), 0)",
        "start_mer": f"IF({start} = 'Unstated' AND {p}[3] <> '', {end}, {start})",
        "start_padded": f"length({p}[0]) = 2 AND {p}[0] LIKE '0%'",
        "end_hour": f"try_cast({p}[3] AS INT)",
        "end_minute": f"IF({p}[3] <> '', coalesce(try_cast({p}[4] AS INT), 0), NULL)",
        "end_mer": end,
        "end_padded": f"length({p}[3]) = 2 AND {p}[3] LIKE '0%'",
    }


def clock_valid(hour: str, minute: str) -> str:
    return f"({hour} BETWEEN 0 AND 23 AND {minute} BETWEEN 0 AND 59)"


def as_written(hour: str, minute: str, mer: str) -> str:
    """Minutes of day when the text alone settles it, else NULL."""
    h = (
        f"CASE WHEN {mer} = 'Am' THEN {hour} - IF({hour} = 12, 12, 0) "
        f"WHEN {mer} = 'Pm' THEN {hour} + IF({hour} = 12, 0, 12) "
        f"WHEN {hour} = 0 OR {hour} > 12 THEN {hour} END"
    )
    return f"CASE WHEN {clock_valid(hour, minute)} AND {h} <= 23 THEN {h} * 60 + {minute} END"


def literal(hour: str, minute: str) -> str:
    return f"IF({clock_valid(hour, minute)}, {hour} * 60 + {minute}, NULL)"


def proves_24h(hour: str, mer: str, padded: str) -> str:
    return f"({mer} = 'Unstated' AND ({hour} BETWEEN 13 AND 23 OR ({padded} AND {hour} BETWEEN 0 AND 12)))"


def morning(hour: str, minute: str) -> str:
    """Minutes of day under AM; the PM reading is this plus twelve hours."""
    return f"({hour} % 12 * 60 + {minute})"


def hhmm(minutes: str) -> str:
    return f"concat(lpad(CAST({minutes} AS INT) div 60, 2, '0'), ':', lpad(CAST({minutes} AS INT) % 60, 2, '0'))"
