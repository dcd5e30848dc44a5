"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.plans.registry import query
from schedlake.session import shared_folder, written
from schedlake.sources import intake as N
from schedlake.sources.rendered import duck, rendered

HEX = "substr(hex(content), 1, 1024)"
HEAD = "CASE WHEN starts_with(h, 'EFBBBF') THEN substr(h, 7) ELSE h END"
LENIENT = "coalesce(TRY(decode(unhex(x))), TRY(decode(unhex(x[:-3]))), TRY(decode(unhex(x[:-5]))), TRY(decode(unhex(x[:-7]))))"
SAME = " OR ".join(
    f"(length(l[1]) > length(replace(l[1], {d}, '')) AND len(list_filter(l, lambda y: length(y) - length(replace(y, {d}, '')) <> length(l[1]) - length(replace(l[1], {d}, '')))) = 0)"
    for d in ("','", "';'", "chr(9)", "'|'")
)


@query(
    "format_sniff",
    f"""WITH a AS (SELECT path, {HEX} AS h FROM ({duck('file_bytes')}) f), b AS (SELECT *, {HEAD} AS x FROM a),
    c AS (SELECT *, CASE WHEN regexp_matches(x, '^(..)*00') THEN NULL ELSE {LENIENT} END AS txt FROM b),
    d AS (SELECT *, list_filter(string_split(txt, chr(10)), lambda y: trim(y) <> '')[:-2] AS l FROM c)
    SELECT path, CASE WHEN starts_with(h, '255044462D') THEN 'Pdf' WHEN starts_with(h, '504B0304') THEN 'Xlsx'
      WHEN starts_with(h, '89504E47') OR starts_with(h, 'FFD8FF') OR starts_with(h, '474946383961') OR (starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250') OR substr(h, 9, 8) = '66747970' THEN 'Image'
      WHEN h = '' THEN 'Unsupported' WHEN starts_with(h, 'E92080') THEN CASE WHEN length(h) / 2 > 40 THEN 'PlainText' ELSE 'Unsupported' END
      WHEN txt IS NULL THEN 'Unsupported' WHEN len(l) >= 3 AND ({SAME}) THEN 'Csv' WHEN trim(txt) <> '' THEN 'PlainText' ELSE 'Unsupported' END AS format
    FROM d""",
)
def format_sniff(spark, sf_dir):
    return N.sniff_format(rendered(spark, sf_dir, "file_bytes")).select("path", "format")


FILES = """SELECT doc_id, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'Csv' WHEN 1 THEN 'PlainText' ELSE 'Pdf' END AS format,
    doc_id % 19 > 0 AS present, CASE WHEN doc_id % 23 = 0 THEN 0 ELSE n_chars * (doc_id % 17) * 5000 END AS size_bytes FROM {documents}"""


@query(
    "intake_gate",
    f"""SELECT format, coalesce(CASE WHEN NOT present THEN 'PermissionRevoked' WHEN size_bytes = 0 THEN 'Empty'
       WHEN size_bytes > CASE format WHEN 'Csv' THEN 20 WHEN 'PlainText' THEN 5 ELSE 100 END * 1048576 THEN 'TooLarge' END, 'accepted') AS outcome, count(*) AS files
    FROM ({FILES.format(documents='documents')}) f GROUP BY ALL""",
)
def intake_gate(spark, sf_dir):
    files = spark.sql(FILES.format(documents=f"parquet.`{sf_dir}/documents.parquet`"))
    files = N.intake_gate(files, {"Csv": 20, "PlainText": 5}, 100)
    return files.groupBy("format", F.coalesce("refusal", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("files"))


# windows-1252 by hex pairs: place of the pair in the code page, and the code page as a list of characters
_CODE_PAGE = {**{i: i for i in range(256)}, **dict(zip(bytes.fromhex(N.CP1252_BYTES), map(ord, N.CP1252_CHARS), strict=True))}
_DIGIT = "instr('0123456789ABCDEF', substr(p, {}, 1))"
WESTERN = f"list_extract([{', '.join(f'chr({c})' for _, c in sorted(_CODE_PAGE.items()) if c)}], ({_DIGIT.format(1)} - 1) * 16 + {_DIGIT.format(2)} - 1)"


@query(
    "decode_text",
    f"""WITH a AS (SELECT path, hex(content) AS h FROM ({duck('file_bytes')}) f), b AS (SELECT *, {HEAD} AS x FROM a),
    c AS (SELECT *, CASE WHEN x = '' OR regexp_matches(x, '^(..)*00') THEN 'refused' WHEN TRY(decode(unhex(x))) IS NOT NULL THEN 'utf-8' ELSE 'windows-1252' END AS encoding FROM b)
    SELECT path, encoding, md5(t) AS digest, length(t) AS chars FROM (SELECT *, CASE encoding WHEN 'utf-8' THEN decode(unhex(x))
       WHEN 'windows-1252' THEN array_to_string(list_transform(regexp_extract_all(x, '..'), lambda p: {WESTERN}), '') END AS t FROM c)""",
)
def decode_text(spark, sf_dir):
    files = N.decode_text(rendered(spark, sf_dir, "file_bytes"))
    return files.selectExpr("path", "encoding", "md5(CAST(text AS BINARY)) AS digest", "length(text) AS chars")


@query(
    "text_lines",
    """SELECT doc_id, CAST(i - 1 AS INT) AS line_no, md5(ls[i]) AS digest, CAST((i - 1) * 12 AS DOUBLE) AS t, CAST(i * 12 AS DOUBLE) AS b FROM (
      SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'),
        lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')), lambda y: y <> '') AS ls FROM documents))""",
)
def text_lines(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return N.text_lines(documents).selectExpr("doc_id", "line_no", "md5(CAST(text AS BINARY)) AS digest", "t", "b")


INFER = f"""SELECT file_id, n AS lines, coalesce(best, CASE WHEN n > 1 THEN ',' END) AS delimiter FROM (
      SELECT file_id, max(n) AS n, max_by(d, f * 10 - k) FILTER (lo = hi AND lo > 1) AS best FROM (
        SELECT file_id, k, d, count(*) AS n, min(f) AS lo, max(f) AS hi, min(f) AS f FROM (
          SELECT file_id, k, d, length(bare) - length(replace(bare, d, '')) + 1 AS f FROM (
            SELECT file_id, regexp_replace(text, '"[^"]*("|$)', '', 'g') AS bare FROM ({duck('delim_lines')}) x WHERE trim(text) <> '') y,
          (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) c(k, d)) z GROUP BY ALL) g GROUP BY file_id)"""


@query("delimiter_inference", INFER)
def delimiter_inference(spark, sf_dir):
    return N.infer_delimiters(rendered(spark, sf_dir, "delim_lines"))


@query(
    "csv_cells",
    f"""WITH l AS (SELECT *, length(text) - length(replace(text, '"', '')) AS q FROM ({duck('delim_notes')}) x),
    r AS (SELECT *, sum(q) OVER (PARTITION BY file_id ORDER BY line_no) - q AS before FROM l),
    s AS (SELECT *, sum(CASE WHEN before % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS rec FROM r WHERE before % 2 = 1 OR text <> ''),
    g AS (SELECT file_id, rec, string_agg(text, chr(10) ORDER BY line_no) AS text FROM s GROUP BY ALL),
    d AS (SELECT g.*, delimiter FROM g JOIN ({INFER}) i USING (file_id)),
    p AS (SELECT *, list_transform(string_split(text, '"'), lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, delimiter, chr(1)) ELSE x END) AS p FROM d),
    f AS (SELECT file_id, rec, string_split(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 1 AND x = '' AND i > 1 AND i < len(p) THEN '"' ELSE x END), ''), chr(1)) AS fs FROM p)
    SELECT file_id, CAST(rec - 1 AS BIGINT) AS row_no, CAST(unnest(range(0, len(fs))) AS INT) AS col, regexp_replace(unnest(fs), '^\\s+|\\s+$', '', 'g') AS text FROM f""",
)
def csv_cells(spark, sf_dir):
    delimiters = N.infer_delimiters(rendered(spark, sf_dir, "delim_lines"))
    return N.delimited_cells(rendered(spark, sf_dir, "delim_notes"), delimiters)


@query(
    "snapshot_runs",
    f"SELECT doc_id, page, CAST(run_id AS BIGINT) AS run_id, text, l, t, r, b, conf, origin FROM ({duck('runs')}) r",
)
def snapshot_runs(spark, sf_dir):
    """Runs written as snapshot files and read back: one JSON object per line, sixteen runs a fragment here."""
    path = shared_folder(spark, "snapshots")
    fragments = N.snapshot_fragments(rendered(spark, sf_dir, "runs"), "run_id div 16")
    fragments.select(F.col("json").alias("value")).write.text(path)
    docs = spark.read.schema(N.SNAPSHOT + ", doc STRING").json(path)
    return N.snapshot_runs(docs).select(
        F.col("doc").cast("long").alias("doc_id"), "page", "run_id", "text", "l", "t", "r", "b", "conf", "origin"
    )


# What a file is goes with its document, sizes and issues with the page; some pages are not described.
PAGES = """SELECT DISTINCT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN 'Pdf' WHEN doc_id % 3 = 1 THEN 'Image' ELSE 'Xlsx' END AS format,
    CASE WHEN page % 4 < 3 THEN CAST(2612 AS DOUBLE) END AS width, CASE WHEN page % 4 < 3 THEN CAST(3792 + page AS DOUBLE) END AS height, page % 5 = 4 AS poor FROM {runs} WHERE page % 7 <> 6"""


@query(
    "snapshot_write",
    f"""WITH r AS (SELECT *, run_id // 1000 AS part, '{{"id":' || CAST(run_id AS BIGINT) || ',"text":"' || text || '","l":' || l || ',"t":' || t || ',"r":' || r || ',"b":' || b
        || CASE WHEN conf IS NULL THEN '' ELSE ',"conf":' || conf END || ',"origin":"' || origin || '"}}' AS j FROM ({duck('runs')}) x), pg AS ({PAGES.format(runs='r')})
    SELECT doc_id, page, CAST(part AS BIGINT) AS part, '{{"doc":"' || doc_id || '","format":"' || coalesce(any_value(format), 'Unknown') || '","pages":[{{"index":' || page || ',"widthPt":' || coalesce(any_value(width), max(r)) || ',"heightPt":' || coalesce(any_value(height), max(b))
        || ',"runs":[' || string_agg(j, ',' ORDER BY run_id) || ']}}],"issues":[' || CASE WHEN any_value(poor) THEN '{{"kind":"LowContrast","detail":"page ' || page || '"}}' ELSE '' END || ']}}' AS json
    FROM r LEFT JOIN pg USING (doc_id, page) GROUP BY doc_id, page, part""",
)
def snapshot_write(spark, sf_dir):
    runs = written(rendered(spark, sf_dir, "runs"), "runs")
    runs.createOrReplaceTempView("snapshot_source")
    issue = "IF(poor, array(named_struct('kind', 'LowContrast', 'detail', concat('page ', page))), CAST(array() AS ARRAY<STRUCT<kind STRING, detail STRING>>)) AS issues"
    pages = spark.sql(PAGES.format(runs="snapshot_source")).selectExpr("doc_id", "page", "format", "width", "height", issue)
    return N.snapshot_fragments(runs, pages=pages)


@query(
    "content_identity",
    f"SELECT path, sha256(content)[1:16] AS hash, sha256(content)[1:16] || '/g' || (doc_id % 3) AS identity FROM ({duck('file_bytes')}) f",
)
def content_identity(spark, sf_dir):
    files = rendered(spark, sf_dir, "file_bytes").withColumn("group_id", F.expr("concat('g', doc_id % 3)"))
    return N.content_identity(files).select("path", "hash", "identity")
