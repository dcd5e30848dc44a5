"""Named queries and, next to each, the SQL another engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    """A DuckDB connection that sees the test tables; only tests and the check tool need it."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 4)
    return v if isinstance(v, (int, str, bool)) else str(v)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, name: str, sf_dir: str):
    """Columns and rows of a query, and of its check."""
    df = QUERIES[name](spark, sf_dir)
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(CHECKS[name])
    return got, _sorted([d[0] for d in cursor.description], cursor.fetchall())
