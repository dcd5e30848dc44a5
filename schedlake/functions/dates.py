"""Dates in text as SQL expressions: find, validate, keep both readings."""

from __future__ import annotations

from schedlake.functions import vocabulary as V
from schedlake.functions.spans import raw, spans

# Families in the order in which ties are settled.
ISO, DAY_MONTH, MONTH_DAY, NUMERIC, WEEKDAY = range(5)
PATTERNS = {
    ISO: V.ISO_DATE,
    DAY_MONTH: V.DAY_MONTH_DATE,
    MONTH_DAY: V.MONTH_DAY_DATE,
    NUMERIC: V.NUMERIC_DATE,
    WEEKDAY: V.WEEKDAY_NAME,
}
DAY_FIRST, MONTH_FIRST = "DayFirst", "MonthFirst"
TOKENS = "array<struct<start:int,neg_len:int,family:int,raw:string>>"
NO_TOKENS = f"CAST(array() AS {TOKENS})"
# Cheap tests that decide whether a family's full pattern is tried at all; none of them looks further than the next word.
_STEMS = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_GATES = {
    ISO: r"\d{4}-\d",
    DAY_MONTH: r"(?i)\d(?:st|nd|rd|th)?\s+" + _STEMS,
    MONTH_DAY: r"(?i)\b" + _STEMS + r"[a-z]*\.?\s+\d",
    NUMERIC: r"\d\s*[/.\-]\s*\d",
    WEEKDAY: r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun)",
}


def date_tokens(text: str) -> str:
    """All candidates of every family, ordered by start, longer first, family."""
    found = [
        f"IF({text} RLIKE {raw(_GATES[family])}, transform({spans(text, pattern)}, s -> named_struct("
        f"'start', s.start, 'neg_len', -length(s.raw), 'family', {family}, 'raw', s.raw)), {NO_TOKENS})"
        for family, pattern in PATTERNS.items()
    ]
    return f"array_sort(concat({', '.join(found)}))"


def drop_overlaps(tokens: str) -> str:
    """Greedy: a token survives when it starts after the last survivor ended."""
    last = "try_element_at(kept, -1)"
    return (
        f"aggregate({tokens}, {NO_TOKENS}, (kept, t) -> IF({last} IS NULL OR t.start >= {last}.start - {last}.neg_len, "
        "concat(kept, array(t)), kept))"
    )


def full_year(text: str) -> str:
    """Four digits as written; two digits within fifty years of the pivot."""
    century = V.PIVOT_YEAR // 100 * 100
    value = f"try_cast({text} AS INT)"
    return (
        f"CASE WHEN length({text}) = 4 THEN {value} "
        f"WHEN {century} + {value} - {V.PIVOT_YEAR} > 50 THEN {century - 100} + {value} ELSE {century} + {value} END"
    )


def _stem_number(name: str, names: tuple[str, ...]) -> str:
    stems = "".join(n[:3].lower() for n in names)
    return f"CAST((instr('{stems}', lower(substring({name}, 1, 3))) + 2) / 3 AS INT)"


def month_number(name: str) -> str:
    return _stem_number(name, V.MONTH_NAMES)


def weekday_number(name: str) -> str:
    return _stem_number(name, V.WEEKDAY_NAMES)


def longest_month(month: str) -> str:
    return (
        f"CASE WHEN {month} = 2 THEN 29 WHEN {month} IN (4, 6, 9, 11) THEN 30 "
        f"WHEN {month} BETWEEN 1 AND 12 THEN 31 ELSE 0 END"
    )


def calendar_valid(day: str, month: str, year: str) -> str:
    """Month and day exist; 29 February needs a leap year only when a year is given."""
    leap = f"(({year} % 4 = 0 AND {year} % 100 <> 0) OR {year} % 400 = 0)"
    return (
        f"coalesce({month} BETWEEN 1 AND 12 AND {day} >= 1 AND {day} <= {longest_month(month)} "
        f"AND (NOT ({month} = 2 AND {day} = 29) OR {year} IS NULL OR {leap}), false)"
    )


def invalid_reason(day: str, month: str, year: str) -> str:
    # The wording is fixed: results carry it.
    names = ", ".join(f"'{m}'" for m in V.MONTH_NAMES)
    name = f"try_element_at(array({names}), IF({month} BETWEEN 1 AND 12, {month}, NULL))"
    return (
        f"CASE WHEN NOT {month} BETWEEN 1 AND 12 THEN concat('there is no month ', {month}) "
        f"WHEN {day} < 1 THEN concat('there is no day ', {day}) "
        f"WHEN {day} > {longest_month(month)} THEN concat({name}, ' doesn\\'t have ', {day}, ' days') "
        f"ELSE concat({name}, ' ', {day}, ' isn\\'t a real date in ', {year}) END"
    )


# Fixed order of the groups of each pattern: first number, second, year.
_ORDER = {ISO: "$3|$2|$1", DAY_MONTH: "$1|$3|$4", MONTH_DAY: "$2|$1|$4", NUMERIC: "$1|$2|$3"}


def written_parts(token: str, family: str) -> str:
    """``[first, second, year]`` as written; one pattern match per token."""
    arms = " ".join(
        f"WHEN {fam} THEN regexp_replace({token}, {raw(PATTERNS[fam])}, '{order}')" for fam, order in _ORDER.items()
    )
    return f"split(CASE {family} {arms} END, '[|]')"


def part_numbers(parts: str) -> dict[str, str]:
    """First and second number and the year of a token as integers (NULL = absent)."""
    return {
        "first": f"try_cast({parts}[0] AS INT)",
        "second": f"coalesce(try_cast({parts}[1] AS INT), {month_number(parts + '[1]')})",
        "year": full_year(parts + "[2]"),
    }


def real_date(day: str, month: str, year: str) -> str:
    """A DATE, or NULL where the calendar has no such day or no year was written."""
    return f"try_to_date(concat_ws('-', lpad({year}, 4, '0'), lpad({month}, 2, '0'), lpad({day}, 2, '0')), 'yyyy-MM-dd')"


def readings(text: str) -> str:
    """array<struct<start, raw, first, second, year, family, day_ok, swap_ok>> of surviving dates."""
    dated = f"filter({drop_overlaps(date_tokens(text))}, t -> t.family <> {WEEKDAY})"
    parts = f"transform({dated}, t -> named_struct('p', {written_parts('t.raw', 't.family')}, 't', t))"
    fields = ", ".join(f"'{n}', {e}" for n, e in part_numbers("x.p").items())
    numbers = f"transform({parts}, x -> named_struct('start', x.t.start, 'raw', x.t.raw, 'family', x.t.family, {fields}))"
    return (
        f"transform({numbers}, v -> named_struct('start', v.start, 'raw', v.raw, 'family', v.family, "
        "'first', v.first, 'second', v.second, 'year', v.year, "
        f"'day_ok', {calendar_valid('v.first', 'v.second', 'v.year')}, "
        f"'swap_ok', v.family = {NUMERIC} AND {calendar_valid('v.second', 'v.first', 'v.year')}))"
    )


def holds_reading(text: str) -> str:
    """True when some surviving match can be read as a calendar day."""
    gate = f"{text} RLIKE {raw('|'.join(_GATES[f] for f in (NUMERIC, DAY_MONTH, MONTH_DAY)))}"
    return f"IF({gate}, exists({readings(text)}, r -> r.day_ok OR r.swap_ok), false)"


def names_weekday(text: str) -> str:
    return f"({text} RLIKE {raw(V.WEEKDAY_NAME)})"


def first_weekday(text: str) -> str:
    hit = f"regexp_extract({text}, {raw(V.WEEKDAY_NAME)}, 1)"
    return f"IF({hit} <> '', {weekday_number(hit)}, NULL)"
