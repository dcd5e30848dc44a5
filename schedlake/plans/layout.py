"""Page selection, run merging, table reconstruction and confidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.functions.ordered import number_rows

from schedlake.functions import vocabulary as V
from schedlake.operators import confidence as Q
from schedlake.operators import geometry as G
from schedlake.operators import pages as P
from schedlake.plans import checking as C
from schedlake.plans.registry import query
from schedlake.session import written
from schedlake.sources.rendered import duck, rendered

HINTS = "SELECT doc_id, page FROM {runs} WHERE doc_id % 2 = 0 AND (page + doc_id) % 3 = 0"
KEEP = "doc_id, page, run_id, text"


@query(
    "page_select",
    f"""WITH r AS MATERIALIZED ({duck('runs')}), h AS MATERIALIZED (SELECT DISTINCT * FROM ({HINTS.format(runs='r')})), d AS (SELECT DISTINCT doc_id, true AS asked FROM h)
    SELECT {KEEP} FROM r LEFT JOIN d USING (doc_id) LEFT JOIN (SELECT *, true AS wanted FROM h) w USING (doc_id, page) WHERE asked IS NULL OR wanted""",
)
def page_select(spark, sf_dir):
    runs = written(rendered(spark, sf_dir, "runs"), "runs")  # rendered once, read twice
    hints = runs.where("doc_id % 2 = 0 AND (page + doc_id) % 3 = 0").select("doc_id", "page")
    return P.select_pages(runs, hints).select(*KEEP.split(", "))


@query(
    "page_crop",
    f"""WITH r AS MATERIALIZED ({duck('runs')}), p AS (SELECT doc_id, page, max(r) AS width, max(b) AS height FROM r GROUP BY ALL)
    SELECT {KEEP} FROM r JOIN p USING (doc_id, page) WHERE doc_id % 3 = 0 OR ((l + r) / 2 / width BETWEEN 0.25 AND 0.75 AND (t + b) / 2 / height BETWEEN 0 AND 0.5)""",
)
def page_crop(spark, sf_dir):
    runs = written(rendered(spark, sf_dir, "runs"), "runs")
    sized = runs.join(G.page_sizes(runs), ["doc_id", "page"])
    regions = runs.where("doc_id % 3 > 0").selectExpr("doc_id", "0.25D AS x0", "0.75D AS x1", "0D AS y0", "0.5D AS y1").distinct()
    return P.crop(sized, regions).select(*KEEP.split(", "))


PAGED = f"SELECT CAST(floor(doc_id / 40) AS BIGINT) AS doc_id, CAST(doc_id % 40 AS INT) AS page, row_no, col, text FROM ({{cells}}) c"


def paged(spark, sf_dir):
    return rendered(spark, sf_dir, "sheet_cells").selectExpr(
        "CAST(floor(doc_id / 40) AS BIGINT) AS doc_id", "CAST(doc_id % 40 AS INT) AS page", "row_no", "col", "text"
    )


@query(
    "top_pages",
    f"""WITH src AS ({PAGED.format(cells=duck('sheet_cells'))}), {C.time_tokens('src', 'doc_id, page, row_no, col')},
    tt AS (SELECT DISTINCT doc_id, page, row_no, col FROM c_read),
    e AS (SELECT s.doc_id, s.page, count(*) FILTER (regexp_matches(text, '{V.WEEKDAY_NAME}') OR tt.doc_id IS NOT NULL) AS evidence
      FROM src s LEFT JOIN tt USING (doc_id, page, row_no, col) GROUP BY ALL)
    SELECT doc_id, page, evidence FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY evidence DESC, page) <= 12""",
)
def top_pages(spark, sf_dir):
    return P.top_pages(paged(spark, sf_dir))


THIN = "(page % 7 > 0 OR row_no = 0) AND page % 11 > 0"


@query(
    "text_layer_status",
    f"""WITH a AS ({PAGED.format(cells=duck('sheet_cells'))}), p AS (SELECT DISTINCT doc_id, page FROM a), c AS (SELECT doc_id, page, sum(length(text)) AS ch, count(*) AS n FROM a WHERE {THIN} GROUP BY ALL),
    u AS (SELECT doc_id, page, coalesce(ch, 0) >= 24 AND coalesce(n, 0) >= 4 AS usable FROM p LEFT JOIN c USING (doc_id, page))
    SELECT doc_id, count(*) FILTER (usable) AS usable, count(*) FILTER (NOT usable) AS issues,
      CASE WHEN count(*) FILTER (usable) = 0 THEN 'NoTextLayer' WHEN count(*) FILTER (NOT usable) = 0 THEN 'Success' ELSE 'Partial' END AS status FROM u GROUP BY doc_id""",
)
def text_layer_status(spark, sf_dir):
    runs = paged(spark, sf_dir)
    pages = runs.select("doc_id", "page").distinct()
    return P.layer_status(P.text_layer(runs.where(THIN), pages))


LINE = ["doc_id", "line_no"]


@query(
    "phrase_merge",
    f"""WITH w AS ({duck('word_boxes')}), m AS (SELECT *, b - t > (r - l) * 2 AS tall FROM w), a AS (SELECT doc_id, line_no, bool_and(tall) AS al FROM m GROUP BY ALL),
    u AS (SELECT m.* FROM m JOIN a USING (doc_id, line_no) WHERE al OR NOT tall), g AS (SELECT doc_id, line_no, avg((r - l) / length(text)) * 2 AS gap FROM u GROUP BY ALL),
    s AS (SELECT u.*, CASE WHEN l - lag(r) OVER (PARTITION BY doc_id, line_no ORDER BY l, pos) <= gap THEN 0 ELSE 1 END AS st FROM u JOIN g USING (doc_id, line_no)),
    p AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, line_no ORDER BY l, pos) AS part FROM s)
    SELECT doc_id, line_no, CAST(part AS BIGINT) AS part, md5(string_agg(text, ' ' ORDER BY l, pos)) AS digest, min(l) AS l, max(r) AS r, min(conf) AS conf, count(*) AS n FROM p GROUP BY ALL""",
)
def phrase_merge(spark, sf_dir):
    out = P.merge_phrases(rendered(spark, sf_dir, "word_boxes"), LINE, keep=("conf",))
    return out.selectExpr(*LINE, "part", "md5(CAST(text AS BINARY)) AS digest", "l", "r", "conf", "n")


@query(
    "glyph_runs",
    f"""WITH s AS (SELECT *, CASE WHEN l - lag(r) OVER (PARTITION BY doc_id, line_no ORDER BY l, pos) <= (2 + doc_id % 3 * 5) * 4 THEN 0 ELSE 1 END AS st FROM ({duck('word_boxes')}) w),
    p AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, line_no ORDER BY l, pos) AS part FROM s)
    SELECT doc_id, line_no, CAST(part AS BIGINT) AS part, md5(string_agg(text, '' ORDER BY l, pos)) AS digest, min(l) AS l, max(r) AS r, count(*) AS n FROM p GROUP BY ALL""",
)
def glyph_runs(spark, sf_dir):
    glyphs = rendered(spark, sf_dir, "word_boxes").withColumn("space", F.expr("2 + doc_id % 3 * 5"))
    out = P.merge_glyphs(glyphs, LINE, keep=())
    return out.selectExpr(*LINE, "part", "md5(CAST(text AS BINARY)) AS digest", "l", "r", "n")


# ---- geometry ----

UNITS = f"r AS ({duck('runs')}), un AS (SELECT doc_id, page, median(b - t) AS unit FROM r GROUP BY ALL)"


def runs_of(spark, sf_dir):
    return written(rendered(spark, sf_dir, "runs"), "runs")


@query("page_unit", f"WITH {UNITS} SELECT * FROM un")
def page_unit(spark, sf_dir):
    return G.page_units(rendered(spark, sf_dir, "runs"))


# Runs drift down the page inside a row, so lines depend on the running mean.
DRIFT = "SELECT doc_id, page, run_id, text, l, t + (run_id % 16) * 1.25 AS t, r, b + (run_id % 16) * 1.25 AS b, conf, origin FROM {runs}"


@query(
    "line_cluster",
    f"""WITH RECURSIVE r AS ({DRIFT.format(runs=f"({duck('runs')}) x")}), un AS (SELECT doc_id, page, median(b - t) AS unit FROM r GROUP BY ALL),
    o AS (SELECT r.*, unit, (t + b) / 2 AS c, row_number() OVER (PARTITION BY doc_id, page ORDER BY (t + b) / 2, run_id) AS rn FROM r JOIN un USING (doc_id, page)),
    f AS (SELECT doc_id, page, run_id, rn, c AS s, 1 AS k, 0 AS line FROM o WHERE rn = 1
      UNION ALL SELECT o.doc_id, o.page, o.run_id, o.rn, CASE WHEN abs(o.c - f.s / f.k) > o.unit * 0.6 THEN o.c ELSE f.s + o.c END,
        CASE WHEN abs(o.c - f.s / f.k) > o.unit * 0.6 THEN 1 ELSE f.k + 1 END, CASE WHEN abs(o.c - f.s / f.k) > o.unit * 0.6 THEN f.line + 1 ELSE f.line END
      FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.rn = f.rn + 1)
    SELECT doc_id, page, run_id, CAST(line AS BIGINT) AS line FROM f""",
)
def line_cluster(spark, sf_dir):
    runs_of(spark, sf_dir).createOrReplaceTempView("placed_runs")
    runs = spark.sql(DRIFT.format(runs="placed_runs"))
    return G.cluster_lines(runs, G.page_units(runs)).select("doc_id", "page", "run_id", "line")


BOX_TAIL = """
    bx AS (SELECT doc_id, page, line, min(t) AS t, max(b) AS b FROM ln GROUP BY ALL),
    gp AS (SELECT *, greatest(t - lag(b) OVER (PARTITION BY doc_id, page ORDER BY line), 0) AS gap, line > 0 AS later FROM bx),
    so AS (SELECT doc_id, page, gap, row_number() OVER w AS i, lead(gap) OVER w AS nx, first_value(gap) OVER w AS g0, count(*) OVER (PARTITION BY doc_id, page) AS n FROM gp WHERE later WINDOW w AS (PARTITION BY doc_id, page ORDER BY gap)),
    th AS (SELECT doc_id, page, min_by((gap + nx) / 2, row(-(nx - gap), i)) AS threshold FROM so JOIN un USING (doc_id, page)
      WHERE n >= 3 AND nx - gap >= greatest(unit * 0.15, (gap - g0) * 3) GROUP BY ALL)"""
# Rows of the sheets stand 20 apart; every third one is pulled up to wrap onto the row before.
WRAPPED = "SELECT doc_id, page, run_id, text, l, t - CASE WHEN t % 60 = 40 THEN 8 ELSE 0 END AS t, r, b - CASE WHEN t % 60 = 40 THEN 8 ELSE 0 END AS b, conf, origin FROM {runs}"
BOXES = f"""r AS ({WRAPPED.format(runs=f"({duck('runs')}) x")}), un AS (SELECT doc_id, page, median(b - t) AS unit FROM r GROUP BY ALL),
    ln AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY t) - 1 AS line FROM r),
{BOX_TAIL}"""


def wrapped(spark, sf_dir):
    runs_of(spark, sf_dir).createOrReplaceTempView("placed_runs")
    runs = written(spark.sql(WRAPPED.format(runs="placed_runs")), "runs")
    units = G.page_units(runs)
    return units, written(G.line_gaps(G.line_boxes(G.cluster_lines(runs, units))), "gaps")


@query("row_threshold", f"WITH {BOXES} SELECT * FROM th")
def row_threshold(spark, sf_dir):
    units, gaps = wrapped(spark, sf_dir)
    return G.row_thresholds(gaps, units)


@query(
    "row_group",
    f"""WITH {BOXES} SELECT doc_id, page, line, CAST(sum(CASE WHEN NOT later THEN 0 WHEN threshold IS NULL OR gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS BIGINT) AS row_no
    FROM gp LEFT JOIN th USING (doc_id, page)""",
)
def row_group(spark, sf_dir):
    units, gaps = wrapped(spark, sf_dir)
    return G.group_rows(gaps, G.row_thresholds(gaps, units)).select("doc_id", "page", "line", "row_no")


COLS = f"""{UNITS}, ln AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY t) - 1 AS line FROM r),
    pg AS (SELECT doc_id, page, min(l) AS x0, max(r) AS x1, list_sort(list(r - l))[count(*) // 2 + 1] AS w, max(line) + 1 AS lines FROM ln GROUP BY ALL),
    pb AS (SELECT *, greatest(unit * 0.25, 0.5) AS bucket, CAST(floor((x1 - x0) / greatest(unit * 0.25, 0.5)) AS BIGINT) + 1 AS n FROM pg JOIN un USING (doc_id, page)),
    cov AS (SELECT DISTINCT doc_id, page, line, r - l > w * 1.2 AS wide, unnest(generate_series(least(CAST(floor((l - x0) / bucket) AS INT), n - 1), least(CAST(floor((r - x0) / bucket) AS INT), n - 1))) AS i FROM ln JOIN pb USING (doc_id, page)),
    cnt AS (SELECT doc_id, page, i, count(*) FILTER (NOT wide) AS c, count(*) FILTER (wide) AS s FROM cov GROUP BY ALL),
    bs AS (SELECT doc_id, page, max(c) AS busiest FROM cnt GROUP BY ALL),
    busy AS (SELECT cnt.*, x0, x1, bucket, n, greatest(CAST(floor(unit * 0.4 / bucket) AS INT), 1) AS narrow FROM cnt JOIN bs USING (doc_id, page) JOIN pb USING (doc_id, page)
      WHERE NOT (c <= busiest * 0.15 AND s <= greatest(CAST(floor(lines * 0.25) AS INT), 4))),
    isl AS (SELECT *, sum(CASE WHEN i - p > narrow THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY i) AS col FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, page ORDER BY i) AS p FROM busy)),
    sp AS (SELECT doc_id, page, CAST(col AS INT) AS col, any_value(x0) + min(i) * any_value(bucket) AS left_x,
        CASE WHEN any_value(n) - max(i) - 1 < any_value(narrow) THEN any_value(x1) ELSE any_value(x0) + (max(i) + 1) * any_value(bucket) END AS right_x FROM isl GROUP BY doc_id, page, col)"""


@query("column_spans", f"WITH {COLS} SELECT doc_id, page, col, round(left_x, 4) AS left_x, round(right_x, 4) AS right_x FROM sp")
def column_spans(spark, sf_dir):
    runs = runs_of(spark, sf_dir)
    units = G.page_units(runs)
    spans = G.column_spans(written(G.cluster_lines(runs, units), "lines"), units)
    return spans.selectExpr("doc_id", "page", "col", "round(left_x, 4) AS left_x", "round(right_x, 4) AS right_x")


@query(
    "cell_assign",
    f"""WITH {COLS}, cand AS (SELECT r.doc_id, r.page, run_id, col, right_x - left_x AS cw, r - l AS w, (l + r) / 2 BETWEEN left_x AND right_x AS inside, abs((left_x + right_x) / 2 - (l + r) / 2) AS d FROM r JOIN sp USING (doc_id, page))
    SELECT doc_id, page, run_id, col, w > cw * 1.2 AS spanning FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, page, run_id ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE d END, col) = 1""",
)
def cell_assign(spark, sf_dir):
    runs = runs_of(spark, sf_dir)
    units = G.page_units(runs)
    lines = written(G.cluster_lines(runs, units), "lines")
    return G.assign_columns(lines, G.column_spans(lines, units)).select("doc_id", "page", "run_id", "col", "spanning")


# Five words of a text line make one cell, wrapped over three lines and cut unevenly.
PIECES = """SELECT doc_id, line_no, CAST(floor(pos / 5) AS INT) AS cell, pos AS run_id, CASE WHEN pos % 4 = 1 THEN CAST(pos AS STRING) || '-' WHEN pos % 7 = 2 THEN CAST(pos AS STRING) ELSE text END AS text,
    l, CAST(floor(pos % 5 / 2) * 12 AS DOUBLE) AS t, CASE WHEN doc_id % 2 = 0 THEN l + 49 ELSE r END AS r, CAST(floor(pos % 5 / 2) * 12 + 10 AS DOUBLE) AS b, conf, 'Ocr' AS origin, false AS spanning FROM {boxes}"""


@query(
    "cell_text",
    f"""WITH p AS ({PIECES.format(boxes=f"({duck('word_boxes')}) w")}),
    q AS (SELECT *, lag(text) OVER w AS pt, lag(t) OVER w AS ptop, lag(r) OVER w AS pr FROM p WINDOW w AS (PARTITION BY doc_id, line_no, cell ORDER BY t, l, run_id)),
    s AS (SELECT *, CASE WHEN pt IS NULL THEN '' WHEN abs(t - ptop) < 5 THEN CASE WHEN l - pr > 2 THEN ' ' ELSE '' END
        WHEN (regexp_matches(pt, '\\p{{L}}$') AND regexp_matches(text, '^\\p{{Ll}}')) OR (regexp_matches(pt, '[-:]$') AND regexp_matches(text, '^[\\p{{L}}\\p{{Nd}}]'))
          OR (regexp_matches(pt, '[./]$') AND regexp_matches(text, '^\\p{{Nd}}')) OR (regexp_matches(pt, '\\p{{Nd}}$') AND regexp_matches(text, '^\\p{{Nd}}')) THEN '' ELSE ' ' END AS sep FROM q)
    SELECT doc_id, line_no, cell, md5(trim(string_agg(sep || text, '' ORDER BY t, l, run_id))) AS digest, min(conf) AS min_conf FROM s GROUP BY ALL""",
)
def cell_text(spark, sf_dir):
    rendered(spark, sf_dir, "word_boxes").createOrReplaceTempView("word_boxes")
    cells = G.cell_texts(spark.sql(PIECES.format(boxes="word_boxes")), ["doc_id", "line_no", "cell"])
    return cells.selectExpr("doc_id", "line_no", "cell", "md5(CAST(text AS BINARY)) AS digest", "min_conf")


@query(
    "table_grid",
    f"""WITH {COLS}, {BOX_TAIL},
    rw AS (SELECT doc_id, page, line, sum(CASE WHEN NOT later THEN 0 WHEN threshold IS NULL OR gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS row_no FROM gp LEFT JOIN th USING (doc_id, page)),
    cand AS (SELECT ln.doc_id, ln.page, run_id, line, col, (l + r) / 2 BETWEEN left_x AND right_x AS inside, abs((left_x + right_x) / 2 - (l + r) / 2) AS d FROM ln JOIN sp USING (doc_id, page)),
    pick AS (SELECT doc_id, page, run_id, line, col FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, page, run_id ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE d END, col) = 1)
    SELECT doc_id, page, CAST(row_no AS BIGINT) AS row_no, col, count(*) AS runs FROM pick JOIN rw USING (doc_id, page, line) GROUP BY ALL""",
)
def table_grid(spark, sf_dir):
    """The whole chain: positioned runs to lines, rows, columns and cells."""
    return G.build_grid(runs_of(spark, sf_dir)).select("doc_id", "page", "row_no", "col", "runs")


@query(
    "box_fraction",
    f"""WITH r AS ({duck('runs')}), p AS (SELECT doc_id, page, CASE WHEN page = 5 THEN 0 ELSE max(r.r) * 0.9 END AS width, max(b) AS height, min_by(origin, run_id) AS o FROM r GROUP BY doc_id, page)
    SELECT doc_id, page, run_id, CASE WHEN width > 0 THEN round(greatest(least(l / width, 1), 0), 4) ELSE 0 END AS l, CASE WHEN width > 0 THEN round(greatest(least(t / height, 1), 0), 4) ELSE 0 END AS t,
      CASE WHEN width > 0 THEN round(greatest(least(r / width, 1), 0), 4) ELSE 1 END AS r, CASE WHEN width > 0 THEN round(greatest(least(b / height, 1), 0), 4) ELSE 1 END AS b,
      CASE WHEN o = 'Ocr' THEN 'ImageRegion' ELSE 'PdfSpan' END AS source_kind FROM r JOIN p USING (doc_id, page)""",
)
def box_fraction(spark, sf_dir):
    runs = runs_of(spark, sf_dir)
    sizes = G.page_sizes(runs).withColumn("width", F.expr("IF(page = 5, 0D, width * 0.9)"))
    boxes = G.box_fractions(runs.select("doc_id", "page", "run_id", "l", "t", "r", "b"), sizes)
    return boxes.selectExpr("doc_id", "page", "run_id", *[f"round({c}, 4) AS {c}" for c in "ltrb"], "source_kind")


def placed_rows(spark, sf_dir):
    """All filled rows of each sheet, placed one after the other."""
    cells = written(rendered(spark, sf_dir, "sheet_cells"), "cells")
    rows = cells.select("doc_id", "sheet", "row_no").distinct()
    return cells, number_rows(rows, ["doc_id", "sheet"], ["row_no"], "placed").withColumn("placed", F.col("placed") - 1)


SHEET = f"""c AS ({duck('sheet_cells')}), g AS (SELECT doc_id, sheet, dense_rank() OVER (PARTITION BY doc_id, sheet ORDER BY row_no) - 1 AS row_no, col, text, row_no AS sheet_row FROM c)"""


@query("sheet_grid", f"WITH {SHEET} SELECT doc_id, row_no, col, text, sheet_row FROM g")
def sheet_grid(spark, sf_dir):
    cells, rows = placed_rows(spark, sf_dir)
    return G.sheet_grid(cells, rows).select("doc_id", "row_no", "col", "text", "sheet_row")


@query(
    "sheet_source",
    f"WITH {SHEET} SELECT doc_id, row_no, col, CAST(CASE WHEN row_no = 3 THEN 3 ELSE sheet_row END AS BIGINT) AS source_row, col AS source_col FROM g",
)
def sheet_source(spark, sf_dir):
    cells, rows = placed_rows(spark, sf_dir)
    grid = G.sheet_grid(cells, rows)
    known = rows.where("placed <> 3")
    return G.sheet_sources(grid, known).selectExpr(
        "doc_id", "row_no", "col", "CAST(source_row AS BIGINT) AS source_row", "source_col"
    )


# ---- confidence ----

SCORED = "SELECT doc_id, line_no, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE conf END AS conf, CASE WHEN doc_id % 3 = 0 THEN 'PdfTextLayer' ELSE 'Ocr' END AS origin, floor(pos / 3) AS part FROM {boxes}"


@query(
    "field_confidence",
    f"""WITH s AS (SELECT doc_id, line_no, CAST(part AS BIGINT) AS part, count(*) FILTER (origin = 'Ocr') AS o, min(conf) FILTER (origin = 'Ocr') AS w FROM ({SCORED.format(boxes=f"({duck('word_boxes')}) w")}) x GROUP BY ALL),
    l0 AS (SELECT *, CASE WHEN o = 0 THEN 'High' WHEN w IS NULL THEN 'Medium' WHEN w >= 0.85 THEN 'High' WHEN w >= 0.6 THEN 'Medium' ELSE 'Low' END AS level FROM s),
    l AS (SELECT doc_id, line_no, part, level FROM l0 UNION ALL SELECT doc_id, line_no, max(part) + 1, 'Missing' FROM l0 GROUP BY doc_id, line_no)
    SELECT doc_id, line_no, part, level, CASE level WHEN 'Medium' THEN 'read from an image' WHEN 'Low' THEN 'this was hard to read' WHEN 'Missing' THEN 'nothing was read here' END AS reason, CASE level WHEN 'High' THEN 'Medium' ELSE level END AS derived_level FROM l""",
)
def field_confidence(spark, sf_dir):
    rendered(spark, sf_dir, "word_boxes").createOrReplaceTempView("word_boxes")
    runs = spark.sql(SCORED.format(boxes="word_boxes")).withColumn("part", F.col("part").cast("long"))
    # every line has one value more than it has words for
    at = ["doc_id", "line_no"]
    values = runs.select(*at, "part").distinct().unionByName(runs.groupBy(*at).agg((F.max("part") + 1).alias("part")))
    return Q.score(runs, [*at, "part"], values).drop("runs", "ocr_runs", "weakest")


FIELDS = ["title", "date", "weekday", "start", "end", "location"]


@query(
    "confidence_profile",
    " UNION ALL ".join(
        f"""SELECT doc_id, '{f}' AS field, CASE {f}_level WHEN 'Low' THEN 'Check' WHEN 'Missing' THEN 'Missing' ELSE 'Ready' END AS state, count(*) AS n FROM ({duck('entries')}) e GROUP BY ALL"""
        for f in FIELDS
    ),
)
def confidence_profile(spark, sf_dir):
    return Q.profile(rendered(spark, sf_dir, "entries"), FIELDS, ["doc_id"])
