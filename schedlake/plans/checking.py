"""SQL pieces for the checking side, where one text is needed by several queries."""

from __future__ import annotations

from schedlake.functions import vocabulary as V
from schedlake.functions.dates import PATTERNS
from schedlake.sources.rendered import DAYS, MONTHS

LIST = lambda words: ", ".join(f"'{w}'" for w in words)
STEMS = "'janfebmaraprmayjunjulaugsepoctnovdec'"
DAY_STEMS = "'montuewedthufrisatsun'"


def spans(src: str, keys: str, pattern: str, extra: str) -> str:
    return f"""
      SELECT {keys}, text, {extra}, p[i] AS raw, CAST(length(array_to_string(p[1:i-1], '')) AS INT) AS st FROM (
        SELECT {keys}, text, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (
          SELECT {keys}, text, string_split_regex(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]') AS p
          FROM {src} WHERE regexp_matches(text, '{pattern}')))"""


def date_tokens(src: str, keys: str, prefix: str = "t_") -> str:
    """CTEs ending in ``{prefix}read``: surviving date tokens with their readings."""
    on = " AND ".join(f"n.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    nkeys = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    union = " UNION ALL ".join(spans(src, keys, p, f"{fam} AS family") for fam, p in PATTERNS.items())

    def group(groups: dict[int, int]) -> str:
        arms = " ".join(f"WHEN {f} THEN regexp_extract(raw, '{PATTERNS[f]}', {g})" for f, g in groups.items())
        return f"CASE family {arms} END"

    def valid(d: str, m: str) -> str:
        top = f"CASE WHEN {m} = 2 THEN 29 WHEN {m} IN (4,6,9,11) THEN 30 ELSE 31 END"
        leap = "(y % 4 = 0 AND y % 100 <> 0 OR y % 400 = 0)"
        return f"coalesce({m} BETWEEN 1 AND 12 AND {d} >= 1 AND {d} <= {top} AND (NOT ({m} = 2 AND {d} = 29) OR y IS NULL OR {leap}), false)"

    name = f"split_part('{MONTHS}', ',', b)"
    top = "CASE WHEN b = 2 THEN 29 WHEN b IN (4,6,9,11) THEN 30 ELSE 31 END"
    p = prefix
    return f"""
    {p}all AS ({union}),
    {p}num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY st, length(raw) DESC, family) AS rn FROM {p}all),
    {p}walk AS (
      SELECT *, true AS keep, st + length(raw) AS reach FROM {p}num WHERE rn = 1
      UNION ALL
      SELECT n.*, n.st >= w.reach, CASE WHEN n.st >= w.reach THEN n.st + length(n.raw) ELSE w.reach END
      FROM {p}walk w JOIN {p}num n ON {on} AND n.rn = w.rn + 1),
    {p}parts AS (
      SELECT {keys}, text, family, raw, st, keep, TRY_CAST({group({0: 3, 1: 1, 2: 2, 3: 1})} AS INT) AS a,
        CASE WHEN family IN (0, 3) THEN TRY_CAST({group({0: 2, 3: 2})} AS INT)
             WHEN family IN (1, 2) THEN CAST((instr({STEMS}, lower(substr({group({1: 3, 2: 1})}, 1, 3))) + 2) / 3 AS INT) END AS b,
        {group({0: 1, 1: 4, 2: 4, 3: 3})} AS ytext FROM {p}walk),
    {p}years AS (
      SELECT *, CASE WHEN ytext = '' OR ytext IS NULL THEN NULL WHEN length(ytext) = 4 THEN CAST(ytext AS INT)
                     WHEN CAST(ytext AS INT) > 76 THEN 1900 + CAST(ytext AS INT) ELSE 2000 + CAST(ytext AS INT) END AS y FROM {p}parts),
    {p}valid AS (SELECT *, family <> 4 AND {valid('a', 'b')} AS df, family = 3 AND {valid('b', 'a')} AS mf FROM {p}years),
    {p}full AS (
      SELECT {keys}, text, family, raw, st, keep, y AS year,
        CASE WHEN df AND mf AND a <> b THEN 2 WHEN df OR mf THEN 1 ELSE 0 END AS n_readings,
        CASE WHEN df THEN a WHEN mf THEN b END AS day1, CASE WHEN df THEN b WHEN mf THEN a END AS month1,
        CASE WHEN df AND mf AND a <> b THEN b END AS day2, CASE WHEN df AND mf AND a <> b THEN a END AS month2,
        CASE WHEN family = 4 THEN CAST((instr({DAY_STEMS}, lower(substr(raw, 1, 3))) + 2) / 3 AS INT) END AS weekday,
        CASE WHEN family = 4 OR df OR mf THEN NULL WHEN b NOT BETWEEN 1 AND 12 THEN 'there is no month ' || b
             WHEN a < 1 THEN 'there is no day ' || a WHEN a > {top} THEN {name} || ' doesn''t have ' || a || ' days'
             ELSE {name} || ' ' || a || ' isn''t a real date in ' || y END AS invalid_reason,
        CASE WHEN family = 3 AND df AND NOT mf THEN 'DayFirst' WHEN family = 3 AND mf AND NOT df THEN 'MonthFirst' END AS proven_order
      FROM {p}valid),
    {p}read AS (SELECT * FROM {p}full WHERE keep)"""


def as_date(d: str, m: str, y: str) -> str:
    return f"TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"


def clock_parts(raw: str) -> str:
    """Start and end clock columns of a raw time match (``is_range`` in scope)."""
    def g(pattern: str, n: int) -> str:
        return f"regexp_extract({raw}, '{pattern}', {n})"

    def mer(x: str) -> str:
        plain = f"lower(regexp_replace({x}, '[.\\s]', '', 'g'))"
        return f"CASE WHEN {plain} = 'am' THEN 'Am' WHEN {plain} = 'pm' THEN 'Pm' ELSE 'Unstated' END"

    R, S = V.TIME_RANGE, V.TIME_SINGLE
    h = f"CASE WHEN is_range THEN {g(R, 1)} ELSE {g(S, 1)} END"
    m = f"CASE WHEN is_range THEN {g(R, 2)} ELSE {g(S, 2)} END"
    own = f"CASE WHEN is_range THEN {mer(g(R, 3))} ELSE {mer(g(S, 3))} END"
    return f"""
      CAST({h} AS INT) AS start_hour, coalesce(TRY_CAST({m} AS INT), 0) AS start_minute,
      CASE WHEN is_range AND {own} = 'Unstated' THEN {mer(g(R, 6))} ELSE {own} END AS start_mer,
      length({h}) = 2 AND ({h}) LIKE '0%' AS start_padded,
      CASE WHEN is_range THEN CAST({g(R, 4)} AS INT) END AS end_hour,
      CASE WHEN is_range THEN coalesce(TRY_CAST({g(R, 5)} AS INT), 0) END AS end_minute,
      CASE WHEN is_range THEN {mer(g(R, 6))} END AS end_mer,
      is_range AND length({g(R, 4)}) = 2 AND {g(R, 4)} LIKE '0%' AS end_padded"""


def time_tokens(src: str, keys: str, prefix: str = "c_") -> str:
    """CTEs ending in ``{prefix}read``: times and ranges per line."""
    on = " AND ".join(f"r.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    p = prefix
    glued = (
        "(regexp_matches(substr(text, st + length(raw) + 1, 2), '^[/.\\-]\\d') "
        "OR (st >= 2 AND regexp_matches(substr(text, st - 1, 2), '^\\d[/.\\-]')))"
    )
    return f"""
    {p}r AS (SELECT * FROM ({spans(src, keys, V.TIME_RANGE, 'true AS is_range')}) WHERE NOT {glued}),
    {p}s AS (SELECT * FROM ({spans(src, keys, V.TIME_SINGLE, 'false AS is_range')}) x WHERE NOT {glued}
        AND (regexp_extract(raw, '{V.TIME_SINGLE}', 2) <> '' OR regexp_extract(raw, '{V.TIME_SINGLE}', 3) <> '')
        AND NOT EXISTS (SELECT 1 FROM {p}r r WHERE {on} AND r.st <= x.st AND x.st + length(x.raw) <= r.st + length(r.raw))),
    {p}read AS (SELECT {keys}, text, st, raw, is_range, {clock_parts('raw')} FROM (SELECT * FROM {p}r UNION ALL SELECT * FROM {p}s))"""


def written(h: str, m: str, mer: str) -> str:
    return (
        f"CASE WHEN NOT ({h} BETWEEN 0 AND 23 AND {m} BETWEEN 0 AND 59) THEN NULL "
        f"WHEN {mer} = 'Am' THEN CASE WHEN {h} = 12 THEN 0 ELSE {h} END * 60 + {m} "
        f"WHEN {mer} = 'Pm' AND {h} <= 12 THEN CASE WHEN {h} = 12 THEN 12 ELSE {h} + 12 END * 60 + {m} "
        f"WHEN {mer} = 'Unstated' AND ({h} = 0 OR {h} > 12) THEN {h} * 60 + {m} END"
    )


def any_of(text: str, words, how: str = "contains({t}, '{w}')") -> str:
    return "(" + " OR ".join(how.format(t=text, w=w) for w in words) + ")"


def header_role(text: str) -> str:
    bare = f"regexp_replace(lower({text}), '[^a-z]', '', 'g')"
    return (
        f"CASE WHEN {any_of(bare, V.HEADER_TIME_WORDS)} THEN 'Time' WHEN {any_of(bare, V.HEADER_DATE_WORDS)} THEN 'Date' "
        f"WHEN {any_of(bare, V.HEADER_PLACE_WORDS)} THEN 'Place' ELSE 'Subject' END"
    )


def room_score(v: str) -> str:
    return (
        f"CASE WHEN {v} = '' OR length({v}) > 20 THEN 0 WHEN regexp_matches({v}, '{V.ROOM_COMPOUND}') OR regexp_matches({v}, '{V.ROOM_KEYWORD}') THEN 2 "
        f"WHEN regexp_matches({v}, '{V.ROOM_SIMPLE}') OR regexp_matches({v}, '{V.ROOM_NUMERIC}') THEN 1 ELSE 0 END"
    )


def letters(t: str) -> str:
    return f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"


def solid(t: str) -> str:
    return f"length(regexp_replace({t}, '\\s', '', 'g'))"


DAY_LIST = DAYS
