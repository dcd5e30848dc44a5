"""Connected components by alternating large-star and small-star steps.

Every step replaces the neighbours of a node by its smallest one, so the links turn into stars around
the smallest node of each component.  Minima are combined before the shuffle; what a step found is
written to the shared folder, which cuts the lineage and lets joins on hot nodes be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.session import written


def _star(links: DataFrame, name: str) -> DataFrame:
    """Joins the smallest neighbour ``m`` of each ``u`` to the links (u, v), v being any neighbour."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
    return links.join(least, "u")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; the root is the smallest node of its component.

    Links from a node to itself count; null ends don't.  The number of rounds grows with the logarithm
    of the longest path.
    """
    rows = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()
    )
    rows = written(rows.distinct(), "links")
    loops = rows.where("u = v").select(F.col("u").alias("node"))
    rows, before = rows.where("u > v"), None
    while True:
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "large-star")
        small = _star(large, "small").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")
        )
        rows = written(small.select("x.u", "x.v").where("u > v").distinct(), "small-star")
        now = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
    ends = stars.select(F.explode(F.array("node", "root")).alias("node")).unionByName(loops).distinct()
    return ends.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
