"""Tables rebuilt from the coordinates of text runs.

All positions are doubles.  A page is cut wherever its size could grow without
bound: lines fold inside vertical bands, column borders are swept in ranges of
buckets, and the column spans of a page travel as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schedlake.functions.ordered import WIDTH, ordered_scan, previous_row, running_total
from schedlake.session import written

PAGE = ["doc_id", "page"]
# Fixed values, in units of the median run height or as shares: results depend on them.
TOLERANCE, GUTTER, QUIET, CROSSING, CROSSING_FLOOR, SPANNING = 0.6, 0.4, 0.15, 0.25, 4, 1.2
MIN_SEPARATION, SPREAD = 0.15, 3.0
STRETCH = 512  # pieces of a cell that are gathered at once


def page_units(runs: DataFrame) -> DataFrame:
    """Median run height of each page: the scale of everything else."""
    return runs.where("b > t AND trim(text) <> ''").groupBy(*PAGE).agg(F.median(F.expr("b - t")).alias("unit"))


def _line_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by band, centres ascending; marks those that begin a line.  Nothing is kept but the current line's sum."""
    where, total, runs = None, 0.0, 0
    for batch in batches:
        starts = []
        keys = zip(*(batch[k].to_pylist() for k in (*PAGE, "band")), strict=True)
        for key, c, n, unit in zip(keys, *(batch[k].to_pylist() for k in ("c", "n", "unit")), strict=True):
            begins = key != where or abs(c - total / runs) > unit * TOLERANCE
            where, total, runs = key, c * n if begins else total + c * n, n if begins else runs + n
            starts.append(begins)
        yield pa.RecordBatch.from_arrays([batch[k] for k in (*PAGE, "c")] + [pa.array(starts, pa.bool_())], names=[*PAGE, "c", "starts"])


def cluster_lines(runs: DataFrame, units: DataFrame) -> DataFrame:
    """Adds ``line``: a run joins the current line while its centre stays near the line's running mean.

    Centres further apart than the tolerance always part, so a page falls into bands first.  The rest is sequential by
    nature (a line's mean decides where the next one begins): bands are dealt out, and the distinct centres of each, with
    their numbers of runs, stream past a running sum.
    """
    usable = runs.where("trim(text) <> ''").withColumn("c", F.expr("(t + b) / 2"))
    centres = usable.groupBy(*PAGE, "c").agg(F.count("*").alias("n"))
    stepped = previous_row(centres, PAGE, ["c"], ["c"], "prev", F.floor(F.col("c") / 16384)).join(units, PAGE)
    apart = F.coalesce(F.col("c") - F.col("prev.c") > F.col("unit") * TOLERANCE, F.lit(True))
    banded = running_total(
        stepped.withColumn("apart", apart), PAGE, ["c"], F.col("apart").cast("int"), "band", F.floor(F.col("c") / 16384)
    ).select(*PAGE, "band", "c", "n", "unit")
    kinds = dict(banded.dtypes)
    dealt = banded.repartition(*PAGE, "band").sortWithinPartitions(*PAGE, "band", "c")
    marked = written(dealt.mapInArrow(_line_starts, f"doc_id {kinds['doc_id']}, page {kinds['page']}, c double, starts boolean"), "centres")
    lines = running_total(marked, PAGE, ["c"], F.col("starts").cast("int"), "line", F.floor(F.col("c") / 16384))
    return usable.join(lines.selectExpr(*PAGE, "c", "line - 1 AS line"), [*PAGE, "c"]).drop("c")


def line_boxes(lined: DataFrame) -> DataFrame:
    return lined.groupBy(*PAGE, "line").agg(
        F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.count("*").alias("runs")
    )


def line_gaps(boxes: DataFrame) -> DataFrame:
    """Vertical gap of each line to the one above, NULL on the first."""
    stepped = previous_row(boxes, PAGE, ["line"], ["b"], "prev")
    # greatest() skips NULLs, so the first line is kept apart explicitly.
    gap = F.when(F.col("prev").isNotNull(), F.greatest(F.col("t") - F.col("prev.b"), F.lit(0.0)))
    return stepped.withColumn("gap", gap).drop("prev")


def row_thresholds(gaps: DataFrame, units: DataFrame) -> DataFrame:
    """The gap above which a new row starts, where line gaps fall into two clear sizes.

    Equal gaps never split, so distinct gap sizes are enough.
    """
    sizes = gaps.where("gap IS NOT NULL").groupBy(*PAGE, "gap").agg(F.count("*").alias("n"))
    spread = sizes.groupBy(*PAGE).agg(F.sum("n").alias("total"), F.min("gap").alias("least"))
    stepped = previous_row(sizes, PAGE, ["gap"], ["gap"], "prev", F.floor(F.col("gap") / 16384)).where("prev IS NOT NULL")
    splits = stepped.join(spread, PAGE).join(units, PAGE).where("total >= 3").selectExpr(
        *PAGE, "gap - prev.gap AS jump", "prev.gap AS low", "(gap + prev.gap) / 2 AS middle",
        f"greatest(unit * {MIN_SEPARATION}, (prev.gap - least) * {SPREAD}) AS needed",
    )
    return splits.where("jump >= needed").groupBy(*PAGE).agg(
        F.max_by("middle", F.struct("jump", -F.col("low"))).alias("threshold")
    )


def group_rows(gaps: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``row_no`` to each line: a new row after a wide gap, or every line without a threshold."""
    breaks = gaps.join(thresholds, PAGE, "left").withColumn(
        "__new", F.expr("CASE WHEN gap IS NULL THEN 0 WHEN threshold IS NULL OR gap > threshold THEN 1 ELSE 0 END")
    )
    return running_total(breaks, PAGE, ["line"], F.col("__new"), "row_no").drop("__new", "threshold")


def _pages(lined: DataFrame, units: DataFrame) -> DataFrame:
    """Extent, bucket size, upper median run width and line count of each page."""
    per = lined.groupBy(*PAGE).agg(
        F.min("l").alias("x0"), F.max("r").alias("x1"),
        (-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l - r)")).alias("width"),
        (F.max("line") + 1).alias("lines"),
    )
    return per.join(units, PAGE).selectExpr(
        *PAGE, "x0", "x1", "width", "lines", "unit", "greatest(unit * 0.25, 0.5) AS bucket"
    ).selectExpr("*", "CAST(floor((x1 - x0) / bucket) AS BIGINT) + 1 AS buckets").where("x1 > x0")


def column_spans(lined: DataFrame, units: DataFrame) -> DataFrame:
    """Columns of each page: stretches of buckets that ordinary text keeps busy.

    Each line contributes its covered intervals once per class of run, as +1/−1
    at their borders; the borders of a page are swept in ranges of buckets.
    """
    pages = _pages(lined, units)
    at = "CAST(greatest(least(floor(({0} - x0) / bucket), buckets - 1), 0) AS BIGINT)"
    spans = lined.join(pages, PAGE).selectExpr(
        *PAGE, "line", f"r - l > width * {SPANNING} AS wide", f"{at.format('l')} AS lo", f"{at.format('r')} + 1 AS hi", "buckets"
    )
    strip = W.partitionBy(*PAGE, "line", "wide").orderBy("lo", "hi")
    reach = F.max("hi").over(strip.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("__new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int")).withColumn(
        "__isle", F.sum("__new").over(strip.rowsBetween(W.unboundedPreceding, 0))
    )
    merged = islands.groupBy(*PAGE, "line", "wide", "__isle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("buckets").alias("buckets"))
    # The ends of the page come with the first stretch of a line, not by a union: Spark 4.1 groups a union of two inputs dealt by page
    # without a shuffle, and on many pages borders were grouped apart and came twice.
    ends = "named_struct('at', 0L, 'd', 0, 'wide', wide), named_struct('at', buckets, 'd', 0, 'wide', wide)"
    both = "named_struct('at', lo, 'd', 1, 'wide', wide), named_struct('at', hi, 'd', -1, 'wide', wide)"
    borders = merged.selectExpr(*PAGE, f"inline(IF(__isle = 1, array({both}, {ends}), array({both})))")
    borders = borders.groupBy(*PAGE, "at").agg(
        F.sum(F.expr("IF(wide, 0, d)")).alias("d_cell"), F.sum(F.expr("IF(wide, d, 0)")).alias("d_wide")
    )
    # swept backwards, the border before a row is the one behind it
    swept = ordered_scan(borders, PAGE, ["at"], totals={"cell": F.col("d_cell"), "wide": F.col("d_wide")})
    ahead = previous_row(swept.withColumn("back", -F.col("at")), PAGE, ["back"], ["at"], "next", F.floor(F.col("back") / WIDTH))
    segments = written(
        ahead.where("next IS NOT NULL").select(*PAGE, "at", F.col("next.at").alias("until"), "cell", "wide"), "segments"
    )
    busiest = segments.groupBy(*PAGE).agg(F.max("cell").alias("busiest"))
    gutter = (
        f"(cell <= busiest * {QUIET} AND wide <= greatest(CAST(floor(lines * {CROSSING}) AS INT), {CROSSING_FLOOR}))"
    )
    busy = segments.join(busiest, PAGE).join(pages, PAGE).where(f"NOT {gutter}")
    narrow = f"greatest(CAST(floor(unit * {GUTTER} / bucket) AS INT), 1)"
    stepped = previous_row(busy, PAGE, ["at"], ["until"], "prev")
    apart = F.coalesce(F.expr(f"at - prev.until >= {narrow}"), F.lit(True))
    columns = running_total(stepped, PAGE, ["at"], apart.cast("int"), "nth").withColumn("col", F.col("nth") - 1)
    return columns.groupBy(*PAGE, "col").agg(
        F.min("at").alias("lo"), F.max("until").alias("hi"), *[F.first(c).alias(c) for c in ("x0", "x1", "bucket", "buckets", "unit")]
    ).selectExpr(
        *PAGE, "CAST(col AS INT) AS col", "x0 + lo * bucket AS left_x",
        f"IF(buckets - hi < {narrow}, x1, x0 + hi * bucket) AS right_x",
    )


def assign_columns(lined: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``col`` and ``spanning``: the span holding a run's centre, else the nearest by centre."""
    arrays = spans.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("col", "left_x", "right_x"))).alias("cols"))
    x = "(l + r) / 2"
    holding = f"try_element_at(filter(cols, c -> {x} BETWEEN c.left_x AND c.right_x), 1)"
    nearest = f"array_min(transform(cols, c -> struct(abs((c.left_x + c.right_x) / 2 - {x}) AS d, c.col AS col))).col"
    placed = lined.join(arrays, PAGE).withColumn("col", F.expr(f"coalesce({holding}.col, {nearest})"))
    return placed.withColumn(
        "spanning", F.expr(f"r - l > (cols[col].right_x - cols[col].left_x) * {SPANNING}")
    ).drop("cols")


def continues_word(before: Column, after: Column) -> Column:
    """Whether two pieces on different lines are one word or number."""
    return (
        (before.rlike(r"\p{L}$") & after.rlike(r"^\p{Ll}"))
        | (before.rlike(r"[-:]$") & after.rlike(r"^[\p{L}\p{Nd}]"))
        | (before.rlike(r"[./]$") & after.rlike(r"^\p{Nd}"))
        | (before.rlike(r"\p{Nd}$") & after.rlike(r"^\p{Nd}"))
    )


def cell_texts(placed: DataFrame, cell: list[str]) -> DataFrame:
    """Text, box and weakest confidence of each cell; pieces of a word join without a space."""
    order = W.partitionBy(*cell).orderBy("t", "l", "run_id")
    prev = {n: F.lag(n).over(order).alias(f"p_{n}") for n in ("text", "t", "b", "r")}
    rows = placed.select("*", *prev.values(), F.lead(F.lit(1)).over(order).alias("__more"), F.row_number().over(order).alias("__nth"))
    same_line = F.abs(F.col("t") - F.col("p_t")) < (F.col("p_b") - F.col("p_t")) * 0.5
    spaced = F.when(same_line, F.col("l") - F.col("p_r") > (F.col("p_b") - F.col("p_t")) * 0.2).otherwise(
        ~continues_word(F.col("p_text"), F.col("text"))
    )
    rows = rows.withColumn("piece", F.when(F.col("p_text").isNotNull() & spaced, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    # Windows of one order share one sort; grouping would sort all pieces again.  Each row of a window carries its list, so lists end
    # after STRETCH pieces; what a longer cell has behind them is joined from one row for each further stretch.
    whole, stretch = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), order.rowsBetween(1 - STRETCH, 0)
    heads = rows.select(
        *cell, "t", "l", "run_id", "piece", "__more", F.col("__nth").cast("long").alias("runs"),
        F.collect_list(F.when(F.col("__nth") <= STRETCH, F.col("piece"))).over(whole).alias("__head"),
        *[f(c).over(whole).alias(o) for o, f, c in (
            ("__l", F.min, "l"), ("__t", F.min, "t"), ("__r", F.max, "r"), ("__b", F.max, "b"), ("min_conf", F.min, "conf"),
            ("has_ocr", F.max, F.expr("origin = 'Ocr'")), ("spanning", F.bool_or, "spanning"),
        )],
    ).where(f"__more IS NULL OR runs > {STRETCH}").withColumn("__head", F.when(F.col("__more").isNull(), F.array_join("__head", "")))
    tails = heads.withColumn("__tail", F.collect_list(F.coalesce("piece", F.lit(""))).over(stretch)).where(f"__more IS NULL OR runs % {STRETCH} = 0")
    last = f"IF(runs > {STRETCH}, array_join(slice(__tail, CAST(-1 - (runs - 1) % {STRETCH} AS INT), {STRETCH}), ''), '')"
    ends = tails.withColumn("__tail", F.expr(last)).withColumn("__tails", F.collect_list("__tail").over(whole)).where("__more IS NULL")
    return ends.select(
        *cell, F.trim(F.concat("__head", F.array_join("__tails", ""))).alias("text"), *[F.col(f"__{x}").alias(x) for x in "ltrb"],
        "min_conf", "has_ocr", "spanning", "runs",
    )


def build_grid(runs: DataFrame) -> DataFrame:
    """Runs to grid cells: doc_id, page, row_no, col, text, box, confidence."""
    units = page_units(runs)
    lined = written(cluster_lines(runs, units), "lines")
    gaps = written(line_gaps(line_boxes(lined)), "gaps")
    rows = group_rows(gaps, row_thresholds(gaps, units)).select(*PAGE, "line", "row_no")
    placed = assign_columns(lined, column_spans(lined, units)).join(rows, [*PAGE, "line"])
    return cell_texts(placed, [*PAGE, "row_no", "col"])


def box_fractions(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes as fractions of the page, clamped; a page without size gives the whole page.

    The source kind follows the page's first run: recognised pages are images.
    """
    clamp = "IF(width > 0 AND height > 0, greatest(least({0} / {1}, 1D), 0D), {2})"
    return boxes.join(pages, PAGE).selectExpr(
        *[c for c in boxes.columns if c not in ("l", "t", "r", "b")],
        f"{clamp.format('l', 'width', '0D')} AS l", f"{clamp.format('t', 'height', '0D')} AS t",
        f"{clamp.format('r', 'width', '1D')} AS r", f"{clamp.format('b', 'height', '1D')} AS b",
        "IF(first_origin = 'Ocr', 'ImageRegion', 'PdfSpan') AS source_kind",
    )


def page_sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*PAGE).agg(
        F.max("r").alias("width"), F.max("b").alias("height"), F.min_by("origin", "run_id").alias("first_origin")
    )


def sheet_grid(cells: DataFrame, placed_rows: DataFrame) -> DataFrame:
    """Given cells as a grid: chosen sheet rows move to their placed row, columns stay where they are.

    ``placed_rows``: doc_id, sheet, row_no (sheet row), placed.
    """
    return cells.where("trim(text) <> ''").join(placed_rows, ["doc_id", "sheet", "row_no"]).selectExpr(
        "doc_id", "sheet", "placed AS row_no", "col", "text", "row_no AS sheet_row",
        "col * 100D AS l", "placed * 20D AS t", "col * 100D + 80 AS r", "placed * 20D + 10 AS b",
    )


def sheet_sources(boxes: DataFrame, placed_rows: DataFrame) -> DataFrame:
    """The sheet cell a box of a sheet grid came from; an unknown placed row stands for itself."""
    at = boxes.selectExpr("*", "CAST(floor(t / 20) AS BIGINT) AS placed", "CAST(floor(l / 100) AS INT) AS source_col")
    rows = placed_rows.select("doc_id", "sheet", "placed", F.col("row_no").alias("sheet_row_found"))
    return at.join(rows, ["doc_id", "sheet", "placed"], "left").withColumn(
        "source_row", F.coalesce("sheet_row_found", "placed")
    ).drop("sheet_row_found", "placed")
