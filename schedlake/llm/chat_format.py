"""Chat formatting after a cumulative-snapshot collapse.

Chat logs often hold the same conversation again and again, each time with a few turns more.  Every turn
is hashed with its index; the running sum over these hashes is the hash of the prefix that ends there.  A
conversation is a snapshot if its last prefix hash is an inner prefix hash of another one, which an anti-join
over distinct (length, hash) keys finds; of equal conversations the smallest id stays.  Only the maximal
ones are rendered.

Turns are numbered and summed in ranges of turn numbers, so a conversation that holds much of the table
is spread over many tasks until it is rendered as the one text it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions.ordered import ordered_scan
from schedlake.llm.common import table
from schedlake.session import written

MODULUS = (1 << 61) - 1
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, width: int) -> DataFrame:
    """Numbered turns with two prefix hashes.  Turns that tie are ordered by role and text, repeats stay."""
    turns = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    )
    # repeats are numbered apart so that the order is total
    turns = turns.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    turns = turns.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    # a null conversation is one of its own; joins need a key that is never null
    turns = turns.select(
        F.struct(F.col("conv").isNull().alias("none"), F.coalesce("conv", F.lit(0).cast(dict(turns.dtypes)["conv"])).alias("id")).alias("key"),
        F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text", "again",
    )
    order = ["turn", "role", "text", "again"]
    bucket = F.floor(F.col("turn") / width)
    turns = written(ordered_scan(turns, ["key"], order, bucket, totals={"no": F.lit(1)}), "chat-turns")

    def hashed(seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "no", "role", "text"), F.lit(MODULUS))

    # sums of residues: at most 2^61 each, so they are summed in two halves of 31 and 30 bits
    totals = {}
    for name, seed in (("a", 1), ("b", 2)):
        totals[f"{name}_low"] = hashed(seed).bitwiseAND(F.lit((1 << 31) - 1))
        totals[f"{name}_high"] = F.shiftrightunsigned(hashed(seed), 31)
    return ordered_scan(turns, ["key"], ["no"], F.floor(F.col("no") / width), totals=totals)


def collapse(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", width: int = 4096
) -> DataFrame:
    """(key, n_turns, status) of every conversation: ``kept``, ``copy`` of one with a smaller id, or ``prefix`` of a longer one.

    ``key`` is a struct of whether the id is null, and the id.  A copy of a prefix is a prefix.
    """
    hashed = written(_turns(rows, conv_col, turn_col, role_col, text_col, width), "chat-hashes")
    sums = ["a_low", "a_high", "b_low", "b_high"]
    prefix = F.struct("no", *sums).alias("prefix")
    whole = hashed.groupBy("key").agg(F.max(F.struct("no", *sums)).alias("prefix"))
    whole = written(whole, "chat-wholes")
    # inner prefixes: every turn but the last
    last = whole.select("key", F.col("prefix.no").alias("last"))
    inner = hashed.join(last, "key").where("no < last").select(prefix).distinct()
    first = whole.groupBy("prefix").agg(F.min("key").alias("first"))
    maximal = written(first.join(inner, "prefix", "left_anti"), "chat-maximal")
    status = F.when(F.col("first").isNull(), "prefix").when(F.col("first") == F.col("key"), "kept").otherwise("copy")
    return whole.join(maximal, "prefix", "left").select("key", F.col("prefix.no").alias("n_turns"), status.alias("status"))


def _plain(text: Column) -> Column:
    """Marks inside a text are spelled with a space, so that they end nothing."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def chat_format(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", width: int = 4096
) -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``status`` and, for kept ones, ``rendered``.

    Rendered: ``<|im_start|>role``, line break, text, ``<|im_end|>``, line break for each turn in order.  A null role is
    ``unknown``, a null text empty, a null turn comes first, rows without an id are one conversation.  Turns that tie
    are ordered by role and text; repeated rows are turns of their own.  Other columns are not read.
    """
    state = written(collapse(rows, conv_col, turn_col, role_col, text_col, width), "chat-status")
    key = F.struct(
        F.col(conv_col).isNull().alias("none"), F.coalesce(conv_col, F.lit(0).cast(dict(rows.dtypes)[conv_col])).alias("id")
    )
    role, text = F.coalesce(role_col, F.lit("unknown")), F.coalesce(text_col, F.lit(""))
    turns = rows.select(
        key.alias("key"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62))).alias("turn"), role.alias("role"), text.alias("text")
    ).join(state.where("status = 'kept'").select("key"), "key", "left_semi")

    def said(x: Column) -> Column:
        return F.concat(F.lit(OPEN), _plain(x["role"]), F.lit("\n"), _plain(x["text"]), F.lit(CLOSE + "\n"))

    told = turns.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    told = told.select("key", F.array_join(F.transform("turns", said), "").alias("rendered"))
    return state.join(told, "key", "left").select(
        F.when(~F.col("key.none"), F.col("key.id")).alias(conv_col), F.col("n_turns").cast("long").alias("n_turns"), "status", "rendered"
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


CHECK = """
    with t as (
        select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) as no,
            coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
    ), p as (
        select conv_id, no, string_agg(sha256(role || chr(0) || text), ',') over (partition by conv_id order by no) as prefix,
            count(*) over (partition by conv_id) as n_turns from t
    ), w as (select * from p where no = n_turns),
    inner_prefixes as (select distinct prefix from p where no < n_turns),
    s as (
        select conv_id, n_turns, case when prefix in (select prefix from inner_prefixes) then 'prefix'
            when conv_id is not distinct from min(conv_id) over (partition by prefix) then 'kept' else 'copy' end as status from w
    ), r as (
        select conv_id, string_agg('<|im_start|>' || replace(replace(role, '<|', '< |'), '|>', '| >') || chr(10)
            || replace(replace(text, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10), '' order by no) as rendered
        from t group by 1
    )
    select s.conv_id, n_turns, status, case when status = 'kept' then rendered end as rendered
    from s join r on s.conv_id is not distinct from r.conv_id
"""
