"""Secret scan: three fixed patterns, and character Markov models of random strings and ordinary identifiers.

What the patterns find are the labelled samples of random strings; the other tokens of all documents
are those of ordinary ones.  Transition counts of both kinds become one table of log-likelihood ratios of
128 x 128 cells, however large the corpus.  A token whose transitions sum to more than a margin, and do so
per character too, is a further span.

Everything is DataFrame functions.  Positions are running sums over the matches of one document; texts stay
in the scan and never move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from schedlake.llm.common import table, whole
from schedlake.session import written

# fixed patterns of the base scan; letters of the key words in either case
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = "AKIA[A-Z0-9]{16,}"  # 20 or more: the first AKIA of a run is followed by most
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]"
KINDS = ("assign", "access", "hex", "markov")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all(pattern: str) -> str:
    """Each match with the text before it.  \\G lets a search begin only where the last match ended: linear, also without a match."""
    return f"regexp_extract_all(text, {_quoted('(?s)' + chr(92) + 'G.*?' + '(?:' + pattern + ')')}, 0)"


def _matches(kind: int, pattern: str, kept: str = "true", gate: str | None = None) -> str:
    """Structs of a kind's matches in order: characters before and in the match, the match, and whether it counts."""
    found = _all(pattern)
    if gate:
        found = f"if({gate}, {found}, cast(array() as array<string>))"
    item = f"regexp_extract(x, {_quoted('(?:' + pattern + ')$')}, 0)"
    pieces = f"transform({found}, x -> named_struct('x', x, 'm', {item}))"
    return (
        f"transform({pieces}, (p, i) -> named_struct('kind', {kind}, 'i', i, 'moved', char_length(p.x), "
        f"'size', char_length(p.m), 'm', p.m, 'kept', {kept}))"
    )


def _base() -> list[str]:
    value = f"regexp_extract(p.m, {_quoted('^' + ASSIGN + '(' + VALUE + ')$')}, 1)"
    return [
        _matches(0, ASSIGN + VALUE, f"char_length({value}) >= 6"),
        _matches(1, ACCESS, gate="contains(text, 'AKIA')"),
        _matches(2, HEX),
    ]


def samples(docs: DataFrame, text_col: str = "text", least: int = 8) -> DataFrame:
    """(sample, random): what the patterns find, and the other tokens of all documents of ``least`` or more characters."""
    rows = docs.select(whole(text_col).alias("text"))
    found = rows.select("text", F.expr(f"filter(concat({', '.join(_base())}), x -> x.kept)").alias("found"))
    bare = "text"
    for pattern in (ASSIGN + VALUE, ACCESS, HEX):
        bare = f"regexp_replace({bare}, {_quoted(pattern)}, ' ')"
    value = f"if(x.kind = 0, regexp_extract(x.m, {_quoted('^' + ASSIGN + '(' + VALUE + ')$')}, 1), x.m)"
    both = found.select(
        F.expr(
            f"concat(transform(found, x -> named_struct('sample', {value}, 'random', true)),"
            f" transform(regexp_extract_all({bare}, '{TOKEN}{{{least},}}', 0), x -> named_struct('sample', x, 'random', false)))"
        ).alias("s")
    )
    return both.select(F.explode("s").alias("s")).select("s.sample", "s.random")


def train(labelled: DataFrame) -> DataFrame:
    """One row, ``model``: thousandths of nats of log P(next | last, random) - log P(next | last, ordinary), cell last * 128 + next.

    ``labelled``: (sample, random).  Null samples and characters beyond ASCII are skipped.  Without samples of both kinds all cells are 0.
    """
    known = labelled.where("sample is not null and random is not null").groupBy("sample", "random").agg(F.count(F.lit(1)).alias("n"))
    codes = known.select("random", "n", F.expr("transform(split(sample, ''), c -> ascii(c))").alias("codes"))
    steps = codes.where("size(codes) > 1").select(
        "random", "n", F.explode(F.expr("zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes) - 1), (a, b) -> if(a < 128 and b < 128, a * 128 + b, null))")).alias("cell")
    )
    counts = steps.where("cell is not null").groupBy("cell").agg(
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(a) for a, c in (("r", F.col("random")), ("o", ~F.col("random")))]
    )
    counts = written(counts, "secret-transitions")
    spark = labelled.sparkSession
    cells = spark.range(128 * 128).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    cells = cells.select("cell", F.expr("cell div 128").alias("last"), F.expr("cell % 128").alias("next"), *[F.coalesce(c, F.lit(0)).alias(c) for c in "ro"])

    def log_share(c: str):
        # a character after another one, drawn to the share of the character at all by the weight of ten transitions
        share = (F.sum(c).over(W.partitionBy("next")) + 0.5) / (F.sum(c).over(W.partitionBy(F.lit(0))) + 64)
        return F.ln((F.col(c) + 10 * share) / (F.sum(c).over(W.partitionBy("last")) + 10))

    scored = cells.select("cell", "r", "o", F.round((log_share("r") - log_share("o")) * 1000).cast("int").alias("milli"))
    model = scored.agg(F.array_sort(F.collect_list(F.struct("cell", "milli"))).alias("all"), F.sum("r").alias("r"), F.sum("o").alias("o"))
    return model.select(F.expr("if(r > 0 and o > 0, transform(all, x -> x.milli), transform(all, x -> 0))").alias("model"))


def scan(
    docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least: int = 16, margin: int = 12_000, mean: int = 700,
) -> DataFrame:
    """One row per row: the id, ``found`` (array of kind, start, end; sorted by start, then kind) and the match counts.

    Positions are code points, ends exclusive.  A Markov span is a token of ``least`` or more characters whose ratio
    is over ``margin`` thousandths of nats in all and ``mean`` per transition, and which overlaps no base span.
    Null texts are empty; repeated rows and rows without an id each give a row.  Other columns are not read.
    """
    token = _matches(3, f"{TOKEN}{{{least},}}", "true")
    score = (
        "transform(array(transform(split(x.m, ''), c -> ascii(c))), codes -> aggregate(sequence(1, size(codes) - 1), 0L,"
        " (n, i) -> n + model[codes[i - 1] * 128 + codes[i]]))[0]"
    )
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    one = written(model, "secret-model")
    rows = rows.select("row", "id", F.expr(f"concat({', '.join([*_base(), token])})").alias("found"))
    hits = rows.select("row", "id", F.explode_outer("found").alias("x")).withColumn("model", one.scalar())
    hits = hits.select("row", "id", "x.*", F.expr(f"if(x.kind = 3, {score}, 0L)").alias("score"))
    order = W.partitionBy("row", "kind").orderBy("i")
    placed = hits.withColumn("end", F.sum("moved").over(order)).withColumn("start", F.expr("end - size"))
    likely = F.expr(f"kept and (kind < 3 or (score >= {margin} and score >= {mean}L * (size - 1)))")
    placed = placed.withColumn("kept", F.coalesce(likely, F.lit(False)))
    base = F.expr("kept and kind < 3")
    inner = W.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(inner.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(inner.rowsBetween(0, W.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    placed = placed.withColumn("kept", F.col("kept") & (F.col("kind").isNull() | (F.col("kind") < 3) | free))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("no"), "end", name.alias("kind"))
    counts = [F.count(F.when(F.col("kept") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return placed.groupBy("row").agg(
        F.max("id").alias(id_col), F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("found"), *counts
    ).drop("row")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(samples(docs)))
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.expr(text.format("filter(found, x -> x.no < 3)")), 256).alias("base_sha256"),
        F.expr(text.format("found")).alias("spans"),
        "n_markov",
    )


# ---- the same in the checking engine's SQL ----


def _either_case(words: str) -> str:
    """Letters as classes of both cases: the other engine's switch would fold beyond ASCII."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_KEYS = _either_case("(?:password|passwd|secret|token|api_?key)")
_ASSIGN = _KEYS + r"""["'']?\x20*[:=]\x20*["'']?"""
_PATTERNS = (_ASSIGN + VALUE, ACCESS, HEX, TOKEN + "{16,}")
_BARE = "text"
for _p in _PATTERNS[:3]:
    _BARE = f"regexp_replace({_BARE}, '{_p}', ' ', 'g')"


def _found_sql(kind: int) -> str:
    p = _PATTERNS[kind]
    return f"""select doc_id, {kind} as kind, i, length(x) as moved, regexp_extract(x, '({p})$', 1) as m
        from (select doc_id, unnest(l) as x, unnest(range(len(l))) as i from (select doc_id, regexp_extract_all(text, '(?s).*?(?:{p})') as l from d))"""


_SHARE = "ln(({c} + 10 * ((sum({c}) over (partition by cell % 128) + 0.5) / (sum({c}) over () + 64))) / (sum({c}) over (partition by cell // 128) + 10))"
CHECK = f"""
    with d as (select doc_id, coalesce(text, '') as text from documents),
    f as ({' union all '.join(_found_sql(k) for k in range(4))}),
    v as (select *, case when kind = 0 then regexp_extract(m, '^{_ASSIGN}({VALUE})$', 1) else m end as value from f),
    b as (select *, kind < 3 and (kind > 0 or length(value) >= 6) as base, sum(moved) over (partition by doc_id, kind order by i) as stop from v),
    s as (select value as sample, true as random from b where base
        union all select unnest(regexp_extract_all({_BARE}, '{TOKEN}{{8,}}')), false from d),
    t as (select random, unnest(list_transform(range(1, len(c)), lambda i: case when c[i] < 128 and c[i + 1] < 128 then c[i] * 128 + c[i + 1] end)) as cell
        from (select random, list_transform(string_split(sample, ''), lambda x: ascii(x)) as c from s)),
    n as (select cell, count(*) filter (random) as r, count(*) filter (not random) as o from t where cell is not null group by cell),
    g as (select k.cell, coalesce(r, 0) as r, coalesce(o, 0) as o from (select unnest(range(16384)) as cell) k left join n using (cell)),
    w as (select cell, sum(r) over () > 0 and sum(o) over () > 0 as both_kinds, CAST(round(({_SHARE.format(c='r')} - {_SHARE.format(c='o')}) * 1000) as BIGINT) as milli from g),
    model as (select list(case when both_kinds then milli else 0 end order by cell) as ratios from w),
    c as (select b.*, case when kind = 3 then list_sum(list_transform(range(1, len(k)), lambda i: ratios[k[i] * 128 + k[i + 1] + 1])) end as score
        from (select *, case when kind = 3 then list_transform(string_split(m, ''), lambda x: ascii(x)) end as k from b) b, model),
    p as (select doc_id, kind, stop - length(m) as start, stop, base,
        base or (kind = 3 and score >= 12000 and score >= 700 * (length(m) - 1)) as likely from c),
    q as (select *, max(case when base then stop end) over (partition by doc_id order by start, kind rows between unbounded preceding and current row) as before_,
        min(case when base then start end) over (partition by doc_id order by start, kind rows between current row and unbounded following) as after_ from p),
    z as (select *, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || CAST(start as VARCHAR) || ':' || CAST(stop as VARCHAR) as span from q
        where likely and (base or (coalesce(before_, 0) <= start and coalesce(after_, stop) >= stop)))
    select d.doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
        sha256(coalesce(string_agg(span, ',' order by start, kind) filter (base), '')) as base_sha256,
        coalesce(string_agg(span, ',' order by start, kind), '') as spans, count(*) filter (kind = 3) as n_markov
    from d left join z using (doc_id) group by d.doc_id
"""
