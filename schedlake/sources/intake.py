"""Files and text on the way in, snapshots and results on the way out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions.ordered import running_total

# Leading bytes of each format, in the order they are tested.
SIGNATURES = (
    ("Pdf", "255044462D"),
    ("Xlsx", "504B0304"),
    ("Image", "89504E47"),
    ("Image", "FFD8FF"),
    ("Image", "474946383761"),
    ("Image", "474946383961"),
)
PROBE_BYTES = 512
DELIMITERS = (",", ";", "\t", "|")
# What windows-1252 puts where ISO-8859-1 has the controls 80 to 9F.
CP1252_BYTES = "8082838485868788898A8B8C8E9192939495969798999A9B9C9E9F"
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A file lake: path, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length", "content"
    )


def _without_bom(content: str) -> str:
    return f"IF(startswith({content}, X'EFBBBF'), substring({content}, 4), {content})"


FILLED = r"{} RLIKE r'[^\p{{Zs}}]'"  # more than spaces of any script; trim knows only the one of ASCII


def sniff_format(files: DataFrame) -> DataFrame:
    """Adds ``format`` from the first 512 bytes: signature, then delimited lines, then text."""
    head = files.withColumn("__h", F.expr(f"substring(content, 1, {PROBE_BYTES})"))
    text = "make_valid_utf8(CAST({0} AS STRING))".format(_without_bom("__h"))
    head = head.withColumn("__t", F.expr(text))
    lines = f"filter(split(__t, '\\r\\n|\\n|\\r'), l -> {FILLED.format('l')})"
    head = head.withColumn("__l", F.expr(f"slice({lines}, 1, greatest(size({lines}) - 1, 0))"))
    same = " OR ".join(
        f"(length(__l[0]) > length(replace(__l[0], '{d}', '')) AND "
        f"forall(__l, l -> length(l) - length(replace(l, '{d}', '')) = length(__l[0]) - length(replace(__l[0], '{d}', ''))))"
        for d in DELIMITERS
    )
    arms = " ".join(f"WHEN startswith(__h, X'{sig}') THEN '{fmt}'" for fmt, sig in SIGNATURES)
    fmt = f"""CASE {arms}
        WHEN length(__h) >= 12 AND startswith(__h, X'52494646') AND substring(__h, 9, 4) = X'57454250' THEN 'Image'
        WHEN length(__h) >= 12 AND substring(__h, 5, 4) = X'66747970' THEN 'Image'
        WHEN length(__h) = 0 OR contains(__h, X'00') THEN 'Unsupported'
        WHEN size(__l) >= 3 AND ({same}) THEN 'Csv'
        WHEN {FILLED.format('__t')} AND (length(__t) - length(replace(__t, '\ufffd', ''))) * 20 < length(__t) THEN 'PlainText'
        ELSE 'Unsupported' END"""
    return head.withColumn("format", F.expr(fmt)).drop("__h", "__t", "__l")


def intake_gate(files: DataFrame, limits_mb: dict[str, int] | None = None, most_mb: int | None = None) -> DataFrame:
    """Adds ``refusal``: gone, empty, or over a size limit where the caller sets one (by format, and for the rest)."""
    arms = " ".join(f"WHEN format = '{f}' THEN {mb}" for f, mb in (limits_mb or {}).items())
    limit = f"CASE {arms} WHEN true THEN {'NULL' if most_mb is None else most_mb} END"
    return files.withColumn(
        "refusal",
        F.expr(
            f"""CASE WHEN NOT present THEN 'PermissionRevoked' WHEN size_bytes = 0 THEN 'Empty'
            WHEN size_bytes > {limit} * 1048576L THEN 'TooLarge' END"""
        ),
    )


def decode_text(files: DataFrame) -> DataFrame:
    """Text of a file: UTF-8 when valid, else windows-1252; a NUL anywhere means it is no text."""
    body = files.withColumn("__b", F.expr(_without_bom("content")))
    source = "decode(X'{}', 'ISO-8859-1')".format(CP1252_BYTES)
    western = f"translate(decode(__b, 'ISO-8859-1'), {source}, '{CP1252_CHARS}')"
    kind = f"""CASE WHEN length(__b) = 0 OR contains(__b, X'00') THEN 'refused'
        WHEN is_valid_utf8(CAST(__b AS STRING)) THEN 'utf-8' ELSE 'windows-1252' END"""
    body = body.withColumn("encoding", F.expr(kind))
    return body.withColumn(
        "text", F.expr(f"CASE encoding WHEN 'utf-8' THEN CAST(__b AS STRING) WHEN 'windows-1252' THEN {western} END")
    ).drop("__b")


def text_lines(documents: DataFrame, line_height: int = 12, width: int = 500) -> DataFrame:
    """Non-empty trimmed lines, numbered, with the synthetic boxes plain text gets."""
    trimmed = r"transform(split(text, '\\r\\n|\\n|\\r'), l -> regexp_replace(l, '^\\s+|\\s+$', ''))"
    rows = documents.selectExpr("doc_id", f"posexplode(filter({trimmed}, l -> l <> '')) AS (line_no, text)")
    return rows.selectExpr(
        "doc_id", "line_no", "text", "0.0D AS l", f"CAST(line_no * {line_height} AS DOUBLE) AS t",
        f"CAST({width} AS DOUBLE) AS r", f"CAST(line_no * {line_height} + {line_height} AS DOUBLE) AS b",
        "'PlainText' AS origin",
    )


def infer_delimiters(lines: DataFrame) -> DataFrame:
    """The delimiter of each file from all its non-blank lines, quotes respected.

    Least and most fields per file and delimiter are combined before the shuffle.
    """
    bare = lines.where("trim(text) <> ''").selectExpr("file_id", "regexp_replace(text, '\"[^\"]*(\"|$)', '') AS bare")
    options = ", ".join(f"named_struct('rank', {i}, 'd', '{d}')" for i, d in enumerate(DELIMITERS))
    fields = bare.selectExpr("file_id", "bare", f"inline(array({options}))").selectExpr(
        "file_id", "rank", "d", "length(bare) - length(replace(bare, d, '')) + 1 AS fields"
    )
    per = fields.groupBy("file_id", "rank", "d").agg(
        F.count("*").alias("lines"), F.min("fields").alias("lo"), F.max("fields").alias("hi")
    )
    return per.groupBy("file_id").agg(
        F.max("lines").alias("lines"),
        F.max_by("d", F.expr("IF(lo = hi AND lo > 1, struct(lo, -rank), NULL)")).alias("best"),
    ).selectExpr("file_id", "lines", "coalesce(best, IF(lines > 1, ',', NULL)) AS delimiter")


def delimited_cells(lines: DataFrame, delimiters: DataFrame, bucket: str = "line_no div 4096") -> DataFrame:
    """Cells of delimited files: quotes, doubled quotes, quoted line breaks, ragged rows.

    A record starts on a line reached with an even number of quotes; which lines
    that are follows from a running count, so a file is never one task.
    """
    quotes = F.expr("length(text) - length(replace(text, '\"', ''))")
    rows = running_total(lines, ["file_id"], ["line_no"], quotes, "__q", F.expr(bucket))
    rows = rows.withColumn("__start", F.expr("(__q - (length(text) - length(replace(text, '\"', '')))) % 2 = 0"))
    # an empty line between records is no record and has no number
    rows = rows.where("NOT __start OR text <> ''")
    rows = running_total(rows, ["file_id"], ["line_no"], F.col("__start").cast("int"), "__rec", F.expr(bucket))
    records = rows.groupBy("file_id", "__rec").agg(
        F.min("line_no").alias("line_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    pieces = """transform(split(text, '"'), (s, i) -> IF(i % 2 = 0, replace(s, delimiter, '\x01'), s))"""
    doubled = """array_join(transform(__p, (s, i) -> IF(i % 2 = 0 AND s = '' AND i > 0 AND i < size(__p) - 1, '"', s)), '')"""
    cells = records.join(delimiters.where("delimiter IS NOT NULL"), "file_id")
    cells = cells.selectExpr("file_id", "__rec - 1 AS row_no", f"{pieces} AS __p").selectExpr(
        "file_id", "row_no", f"posexplode(split({doubled}, '\x01')) AS (col, text)"
    )
    return cells.selectExpr("file_id", "row_no", "col", r"regexp_replace(text, '^\\s+|\\s+$', '') AS text")


SNAPSHOT = """format STRING, pages ARRAY<STRUCT<index INT, widthPt DOUBLE, heightPt DOUBLE,
    runs ARRAY<STRUCT<id BIGINT, text STRING, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE, conf DOUBLE, origin STRING>>>>,
    issues ARRAY<STRUCT<kind STRING, detail STRING>>"""


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Captured documents (JSON) as one row per run; the file is the document key."""
    docs = spark.read.schema(SNAPSHOT).option("multiLine", multi_line).json(path)
    return snapshot_runs(docs.withColumn("doc", F.col("_metadata.file_name")))


def snapshot_runs(docs: DataFrame) -> DataFrame:
    """One row per run; a run without an id of its own is numbered by its place on the page."""
    pages = docs.selectExpr("doc", "format", "inline(pages)")
    return pages.selectExpr(
        "doc", "format", "index AS page", "widthPt AS width", "heightPt AS height", "posexplode(runs) AS (place, run)"
    ).selectExpr("doc", "format", "page", "width", "height", "coalesce(run.id, place) AS run_id", "run.*").drop("id")


def snapshot_fragments(runs: DataFrame, part_of: str = "run_id div 1000", pages: DataFrame | None = None) -> DataFrame:
    """Runs as snapshot JSON, cut into page fragments of a bounded number of runs.

    A page may appear in several fragments; runs carry their ids, the reader appends them, and no task ever holds more than one
    fragment.  Each names its document.  ``pages`` (doc_id, page, format, width, height, issues) says what the file and
    the page are; where it is silent the format is Unknown, the page as large as its runs, and there are no issues.
    """
    run = F.struct("run_id", F.struct(F.col("run_id").alias("id"), "text", "l", "t", "r", "b", "conf", "origin").alias("run"))
    parts = runs.withColumn("part", F.expr(part_of)).groupBy("doc_id", "page", "part").agg(
        F.array_sort(F.collect_list(run)).alias("rs"), F.max("r").alias("__w"), F.max("b").alias("__h")
    )
    if pages is None:
        parts = parts.selectExpr("*", "CAST(NULL AS STRING) AS format", "CAST(NULL AS DOUBLE) AS width", "CAST(NULL AS DOUBLE) AS height",
                                 "CAST(NULL AS ARRAY<STRUCT<kind STRING, detail STRING>>) AS issues")
    else:
        parts = parts.join(pages, ["doc_id", "page"], "left")
    body = """to_json(named_struct('doc', CAST(doc_id AS STRING), 'format', coalesce(format, 'Unknown'),
        'pages', array(named_struct('index', page, 'widthPt', coalesce(width, __w), 'heightPt', coalesce(height, __h), 'runs', transform(rs, x -> x.run))),
        'issues', coalesce(issues, array())))"""
    return parts.selectExpr("doc_id", "page", "part", f"{body} AS json")


def content_identity(files: DataFrame) -> DataFrame:
    """Adds the content hash (first 8 bytes of SHA-256) and ``hash/group``."""
    return files.withColumn("hash", F.expr("substring(sha2(content, 256), 1, 16)")).withColumn(
        "identity", F.expr("concat(hash, '/', coalesce(group_id, ''))")
    )
