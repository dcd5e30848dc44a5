"""Ordered computations inside a key that may hold a large share of all rows.

A plain window over ``key`` puts every row of one document into one task.  The
functions here cut each key into position ranges: the window runs inside a
range, one summary row per range carries what crosses its border, and the
summaries join back.  Results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = "__range"
WIDTH = 4096


def _cut(df: DataFrame, order: list[str], bucket: Column | None) -> DataFrame:
    """``bucket`` must not decrease along ``order``; by default 4,096 positions share one."""
    if bucket is None:
        bucket = F.floor(F.col(order[0]) / F.lit(float(WIDTH)))
    return df.withColumn(RANGE, bucket.cast("long"))


def in_one_range(df: DataFrame, position: str) -> bool:
    """Whether all positions lie in one range: a plain window by key then gathers no more than a range."""
    at = F.floor(F.col(position) / F.lit(float(WIDTH)))
    ends = df.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count_if(at.isNull()).alias("nowhere")).first()
    return ends.low == ends.high and not ends.nowhere


def _windows(keys: list[str], order: list[str], upto: int):
    inside = W.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
    across = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    return inside, across


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column | None = None,
    totals: dict[str, Column] | None = None,
    previous: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Inclusive running sums and structs of the preceding row along ``order``, in one pass."""
    totals, previous = totals or {}, previous or {}
    rows = _cut(df, order, bucket)
    for out, value in totals.items():
        rows = rows.withColumn(f"__v_{out}", value.cast("long"))
    inside, across = _windows(keys, order, 0)
    sums = [F.sum(f"__v_{o}").alias(f"__s_{o}") for o in totals]
    lasts = [F.max_by(F.struct(*cols), F.struct(*order)).alias(f"__l_{o}") for o, cols in previous.items()]
    before = (
        rows.groupBy(*keys, RANGE)
        .agg(*sums, *lasts)
        .select(
            *keys, RANGE,
            *[F.coalesce(F.sum(f"__s_{o}").over(across), F.lit(0)).alias(f"__b_{o}") for o in totals],
            *[F.last(f"__l_{o}").over(across).alias(f"__p_{o}") for o in previous],
        )
    )
    step = W.partitionBy(*keys, RANGE).orderBy(*order)
    local = {f"__i_{o}": F.sum(f"__v_{o}").over(inside) for o in totals}
    local |= {f"__q_{o}": F.lag(F.struct(*cols)).over(step) for o, cols in previous.items()}
    return rows.withColumns(local).join(before, [*keys, RANGE], "left").select(
        *df.columns,
        *[(F.col(f"__i_{o}") + F.col(f"__b_{o}")).alias(o) for o in totals],
        *[F.coalesce(f"__q_{o}", f"__p_{o}").alias(o) for o in previous],
    )


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket: Column | None = None
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` (unique within the key)."""
    return ordered_scan(df, keys, order, bucket, totals={out: value})


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column | None = None
) -> DataFrame:
    """1-based row number along ``order``."""
    return running_total(df, keys, order, F.lit(1), out, bucket)


def last_before(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket: Column | None = None
) -> DataFrame:
    """Last non-null ``value`` on an earlier position: a backward as-of lookup."""
    rows = _cut(df, order, bucket).withColumn("__v", value)
    inside, across = _windows(keys, order, -1)
    at = F.when(F.col("__v").isNotNull(), F.struct(*order))
    edge = (
        rows.groupBy(*keys, RANGE)
        .agg(F.max_by("__v", at).alias("__e"))
        .select(*keys, RANGE, F.last("__e", ignorenulls=True).over(across).alias("__before"))
    )
    return (
        rows.withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
        .join(edge, [*keys, RANGE], "left")
        .withColumn(out, F.coalesce("__in", "__before"))
        .drop("__v", "__in", "__before", RANGE)
    )


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, bucket: Column | None = None
) -> DataFrame:
    """The preceding row's columns as a struct, NULL on the first row."""
    return ordered_scan(df, keys, order, bucket, previous={out: columns})
