"""Every match of a pattern in a text column, with its offset.

``regexp_extract_all`` returns no offsets, so matches are bracketed by two
control characters, the text is split on them and a running length gives the
start of each odd piece.  Builders here and in the sibling modules return
Spark SQL expression text, which parses in one call however long it is.
"""

from __future__ import annotations

OPEN, CLOSE = "\x01", "\x02"
SPANS = "array<struct<start:int,raw:string>>"


def raw(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return f"r'{pattern}'"


def spans(text: str, pattern: str) -> str:
    pieces = f"split(regexp_replace(translate({text}, '{OPEN}{CLOSE}', '  '), {raw(pattern)}, '{OPEN}$0{CLOSE}'), '[{OPEN}{CLOSE}]')"
    return (
        f"aggregate({pieces}, named_struct('at', 0, 'hit', false, 'found', CAST(array() AS {SPANS})), "
        "(acc, p) -> named_struct('at', acc.at + length(p), 'hit', NOT acc.hit, 'found', "
        "IF(acc.hit, concat(acc.found, array(named_struct('start', acc.at, 'raw', p))), acc.found)), "
        "acc -> acc.found)"
    )
