"""How far a value can be trusted: the weakest recognised piece decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.85, 0.60  # fixed values, as are the reasons below


def level(runs: str, ocr_runs: str, weakest: str) -> str:
    return (
        f"CASE WHEN {runs} = 0 THEN 'Missing' WHEN {ocr_runs} = 0 THEN 'High' WHEN {weakest} IS NULL THEN 'Medium' "
        f"WHEN {weakest} >= {HIGH} THEN 'High' WHEN {weakest} >= {MEDIUM} THEN 'Medium' ELSE 'Low' END"
    )


def cap_at_medium(level_column: str) -> str:
    """Derived and inferred values never claim more than Medium."""
    return f"IF({level_column} = 'High', 'Medium', {level_column})"


def score(runs: DataFrame, keys: list[str], values: DataFrame | None = None) -> DataFrame:
    """Level and reason of the value each group of runs spells; of ``values`` (keys) without any run, Missing."""
    per = runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("origin") == "Ocr").alias("ocr_runs"),
        F.min(F.when(F.col("origin") == "Ocr", F.col("conf"))).alias("weakest"),
    )
    if values is not None:
        per = values.select(*keys).join(per, keys, "left").fillna(0, ["runs", "ocr_runs"])
    return per.selectExpr("*", f"{level('runs', 'ocr_runs', 'weakest')} AS level").selectExpr(
        "*", "CASE level WHEN 'Medium' THEN 'read from an image' WHEN 'Low' THEN 'this was hard to read' WHEN 'Missing' THEN 'nothing was read here' END AS reason",
        f"{cap_at_medium('level')} AS derived_level",
    )


def profile(entries: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Counts per field and state: High and Medium are ready, Low needs a check, Missing is missing."""
    pairs = ", ".join(f"'{f}', {f}_level" for f in fields)
    long = entries.selectExpr(*keys, f"stack({len(fields)}, {pairs}) AS (field, level)")
    state = "CASE level WHEN 'Low' THEN 'Check' WHEN 'Missing' THEN 'Missing' ELSE 'Ready' END AS state"
    return long.selectExpr(*keys, "field", state).groupBy(*keys, "field", "state").agg(F.count("*").alias("n"))
