"""Exact dedup by progressive refinement: length, then a hash of the prefix, then the hash of the whole text.

Each step keeps the rows whose key at least two rows share.  The first two steps move three numbers a
row; texts are hashed whole only for rows that survive both.  What a step found is a written table, so
that a join with a hot key has two plain shuffles and can be split while it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import ascii_lower, sent_whole, table, whole
from schedlake.session import written


def _shared(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys of at least two rows."""
    return written(rows.groupBy(*keys).count().filter("count > 1").select(*keys), name)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """Members of groups of at least two rows with equal texts (A-Z lower-cased, null as empty).

    Columns: the id, ``text_sha256``, ``keep_id`` (largest id of the group), ``group_size`` (its rows), ``rows``
    (those with this very id).
    A repeated row counts in its group and comes out once.  Rows without an id count as copies and come
    out once with a null id; a group in which none has an id has a null ``keep_id``.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("__id"), whole(text_col).alias("__text"))
    seen = written(
        rows.select(
            "__id",
            F.octet_length("__text").alias("__length"),
            F.xxhash64(ascii_lower(F.substring("__text", 1, prefix))).alias("__prefix"),
        ),
        "dedup-lengths",
    )
    by_length = seen.join(_shared(seen, ["__length"], "dedup-shared-lengths"), "__length", "left_semi")
    keys = ["__length", "__prefix"]
    alive = by_length.join(_shared(by_length, keys, "dedup-shared-prefixes"), keys, "left_semi")
    alive = written(alive.select(F.col("__id").alias("__alive")).distinct(), "dedup-alive")
    full = (
        rows.join(alive, F.col("__id").eqNullSafe(F.col("__alive")), "left_semi")
        .select("__id", F.sha2(ascii_lower(F.col("__text")), 256).alias("text_sha256"))
        .groupBy("__id", "text_sha256")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    full = written(full, "dedup-full")
    groups = written(
        full.groupBy("text_sha256")
        .agg(F.max("__id").alias("keep_id"), F.sum("__n").alias("group_size"))
        .filter("group_size > 1"),
        "dedup-groups",
    )
    return full.join(groups, "text_sha256").select(
        F.col("__id").alias(id_col), "text_sha256", "keep_id", "group_size", F.col("__n").alias("rows")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, whole: one per text, that with the largest id.

    Of rows that repeat the kept id and its text, the one smallest in all columns stays.
    """
    groups = exact_groups(docs, id_col, text_col).select(
        F.col(id_col).alias("__id"), F.col("text_sha256").alias("__hash"), F.col("keep_id").alias("__keep"), F.col("rows").alias("__rows")
    )
    stays = F.col("__keep").eqNullSafe(F.col("__id"))
    marked = docs.withColumn("__sha", F.sha2(ascii_lower(whole(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__hash"))
    gone = written(groups.filter(~stays | (F.col("__rows") > 1)).select("__id", "__hash"), "dedup-gone")
    again = written(groups.filter(stays & (F.col("__rows") > 1)).select("__id", "__hash"), "dedup-again")
    single = marked.join(sent_whole(gone), same, "left_anti").select(*docs.columns)
    repeated = marked.join(again, same, "left_semi").groupBy(id_col, "__sha")
    one = repeated.agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return single.unionByName(one)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = exact_groups(docs).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "keep_id", "group_size")
    every = docs.select("doc_id", F.sha2(ascii_lower(whole("text")), 256).alias("text_sha256")).distinct()
    found = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_sha256") == F.col("__sha"))
    return every.join(groups, found, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        "text_sha256",
    )
