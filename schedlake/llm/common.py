"""What several operators share: table access, ASCII lower case, Arrow batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def sent_whole(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table that a join may send to every task: it is counted first, and larger ones are shuffled like any other."""
    return F.broadcast(rows) if rows.count() <= most else rows


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed (``lower`` would fold other scripts too)."""
    return F.translate(text, UPPER, UPPER.lower())


def give_back() -> None:
    """Returns what a task has freed to the system: Python workers live on, beside the memory of the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_text(
    rows: DataFrame, id_col: str, text_col: str, fields: str, work: Callable[[], Callable[[str], tuple]]
) -> DataFrame:
    """One output row per input row: the id and the fields that a function of the text returns.

    ``work`` runs once a task and returns that function, so tables it keeps live as long as the task.
    ``rows`` may hold other columns of any name; only the two named ones are read.  Null texts are empty.
    """
    kind = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {fields}"
    source = rows.select(F.col(id_col).alias(id_col), whole(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = work()
        part = found = None
        for batch in batches:
            size = 1024  # bounds what a task holds of its results
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                found = [one(t) for t in part.column(1).to_pylist()]
                if found:
                    yield arrow([part.column(0), *map(list, zip(*found, strict=True))], types)
                found = None
            batch = part = None
        one = None
        give_back()

    types = arrow_types(rows.sparkSession, schema)
    return source.mapInArrow(run, schema)


def arrow_types(spark: SparkSession, schema: str) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]


def arrow(columns: list, types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in types])
