"""Columns that are computed once, whatever later filters ask about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from schedlake.session import written


def once(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns behind a one-row generator.

    A filter on a plain derived column is pushed through the projection by
    copying the expression into the filter, again for every mention.  For long
    pattern expressions that multiplies the work; a generator stops the copy.
    """
    fields = ", ".join(f"'{name}', {expr}" for name, expr in columns.items())
    return df.selectExpr("*", f"inline_outer(array(named_struct({fields})))")


def by_value(
    df: DataFrame, columns: list[str], read: Callable[[DataFrame], DataFrame], name: str, how: str = "inner"
) -> DataFrame:
    """Adds what ``read`` makes of ``columns`` alone, read once for each different value and joined back.

    ``read`` gets the distinct values and returns rows that carry them.  Lines repeat (forms, headings, places), and patterns cost
    far more than a shuffle; the values are dealt out evenly, however few bytes they are.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(*columns).distinct().repartition(tasks)
    return df.join(written(read(values), name), columns, how)
