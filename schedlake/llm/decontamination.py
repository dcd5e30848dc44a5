"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, units behind a number and names (capitalised inside a sentence) turn
into typed placeholders, other words are folded and lose outer punctuation.  Windows are hashed on both sides
as templates, as templates whose names are folded words, and as folded words alone, which no change of case
and no text before the first word alters, and joined on the hash.  A run of windows on one diagonal of a document and an
item is an alignment; equal slots of the item must be equal in the document, and some of the words must be
literal ones, which catches re-parameterised questions and rejects chance hits of a common frame.
Windows of slots only are looked up where others have found an alignment.  An alignment counts by its
literal words alone, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import arrow, arrow_types, per_text, table, whole
from schedlake.session import written

# units that count as slots behind a number
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal ms s sec min h hr hrs hz khz mhz ghz w kw mw v a pa kpa "
    "bar j kj cal kcal n c f k b kb mb gb tb px dpi usd eur gbp dollars dollar cents cent euros euro pounds pound "
    "metres meters metre meter kilometres kilometers miles mile feet foot inches inch grams gram kilograms litres "
    "liters litre liter seconds second minutes minute hours hour days day weeks week months month years year "
    "percent degrees degree".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
OUTER = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE_ENDS = frozenset(".!?:;…")
LITERAL, NUMERIC, UNIT, CAPITAL, EMPTY = range(5)
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Raw word to its place in the task's arrays of kind, folded hash and whether it ends a sentence."""

    def __init__(self):
        self.new: list[tuple[int, int, bool]] = []  # words not yet in the arrays, which grow by doubling
        self.n = 0
        self.arrays = np.zeros(1024, np.int8), np.zeros(1024, np.uint64), np.zeros(1024, bool)

    def __missing__(self, raw: str) -> int:
        import xxhash

        word = OUTER.sub("", raw)
        if NUMBER.fullmatch(word):
            kind = NUMERIC
        elif not word:
            kind = EMPTY
        elif word.lower() in UNITS:
            kind = UNIT
        elif word[0].isupper() and word[1:].islower():
            kind = CAPITAL
        else:
            kind = LITERAL
        self.new.append((kind, xxhash.xxh3_64_intdigest(word.casefold()), raw.rstrip("\"')]»”’")[-1:] in SENTENCE_ENDS))
        self[raw] = self.n + len(self.new) - 1
        return self[raw]

    def columns(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            end = self.n + len(self.new)
            if end > len(self.arrays[0]):
                self.arrays = tuple(np.concatenate([a[: self.n], np.zeros(2 * end - self.n, a.dtype)]) for a in self.arrays)
            for a, column in zip(self.arrays, zip(*self.new, strict=True), strict=True):
                a[self.n : end] = np.array(column, a.dtype)
            self.new, self.n = [], end
        return tuple(a[at] for a in self.arrays)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = out * MIX + h[i : len(h) - size + 1 + i]
    return (out ^ (out >> np.uint64(29))) * ODD


def template(text: str, table_: _Words) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words, hash of each in the template and by itself, and which are slots; words of punctuation only are left out."""
    words = text.split()
    if not words:
        return [], *np.zeros((2, 0), np.uint64), np.zeros(0, bool)
    kind, literal, ends = table_.columns(words)
    real = kind != EMPTY
    # a word begins a sentence if the last word that is real or ends one does so
    last = np.r_[-1, np.maximum.accumulate(np.where(real | ends, np.arange(len(words)), -1))[:-1]]
    starts = (last < 0) | ends[last]
    kind, literal, starts = kind[real], literal[real], starts[real]
    words = [w for w, r in zip(words, real.tolist(), strict=True) if r] if not real.all() else words
    behind = np.r_[False, kind[:-1] == NUMERIC]
    slot = np.select([kind == NUMERIC, (kind == UNIT) & behind, (kind == CAPITAL) & ~starts], [1, 2, 3], 0).astype(np.uint64)
    return words, np.where(slot > 0, slot, literal), literal, slot > 0


WINDOWS = "size int, pos int, hash bigint, slots array<int>, fillers array<string>"


def template_windows(
    rows: DataFrame, id_col: str, text_col: str, sizes: list[int], wanted=None, table_size: int = 300_000
) -> DataFrame:
    """(id, size, pos, hash, slots, fillers, tokens) of every window of each text, once for each form that differs; ``slots`` are positions in the window,
    ``fillers`` the folded words there, ``tokens`` the words of the text.

    ``wanted`` (a broadcast, sorted array of hashes) leaves only windows with those hashes.
    """
    schema = f"id {dict(rows.dtypes)[id_col]}, {WINDOWS}, tokens int"
    types = arrow_types(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ = _Words()
        if wanted is not None:
            sought = wanted.value
            maybe = np.zeros(1 << 20, bool)
            maybe[sought & np.uint64((1 << 20) - 1)] = True
        for batch in batches:
            found = []
            for row_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(words_) > table_size:
                    words_ = _Words()
                words, frame, literal, slot = template(text, words_)
                forms = [(frame, slot, None)]
                if slot.any():
                    names = slot & (frame == 3)
                    if names.any():
                        forms.append((np.where(names, literal, frame), slot & ~names, np.r_[0, np.cumsum(names)]))
                    typed = slot & ~names
                    if typed.any():
                        forms.append((literal, np.zeros(len(slot), bool), np.r_[0, np.cumsum(typed)]))
                for size in sizes:
                    if len(words) < size:
                        continue
                    n = len(words) - size + 1
                    for form, slots, sums in forms:
                        # what has the same words in the form before has the same hash
                        differs = np.ones(n, bool) if sums is None else sums[size:] > sums[:n]
                        if not differs.any():
                            continue
                        hashes = _rolled(form, size) * ODD + np.uint64(size)
                        if wanted is None:
                            hits = np.flatnonzero(differs)
                        else:
                            hits = np.flatnonzero(maybe[hashes & np.uint64((1 << 20) - 1)] & differs)
                            near = np.minimum(np.searchsorted(sought, hashes[hits]), len(sought) - 1)
                            hits = hits[sought[near] == hashes[hits]] if len(sought) else hits[:0]
                        for at in hits.tolist():
                            held = np.flatnonzero(slots[at : at + size]).tolist()
                            fill = [OUTER.sub("", words[at + i]).casefold() for i in held]
                            found.append((row_id, size, at, int(hashes[at].astype(np.int64)), held, fill, len(words)))
                        if len(found) >= 20_000:
                            yield arrow([list(c) for c in zip(*found, strict=True)], types)
                            found = []
            if found:
                yield arrow([list(c) for c in zip(*found, strict=True)], types)

    return rows.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(run, schema)


def _short(line: str, fewest: int) -> tuple[int, int] | None:
    """Number of words and hash of a line of fewer than ``fewest`` words; words of punctuation only stay as they are."""
    import xxhash

    words = [(OUTER.sub("", w), w) for w in line.split()]
    n = sum(1 for bare, _ in words if bare)
    if not 0 < n < fewest:
        return None
    return n, int(np.uint64(xxhash.xxh3_64_intdigest("\0".join(bare.casefold() or w for bare, w in words))).astype(np.int64))


def short_texts(rows: DataFrame, id_col: str, text_col: str, fewest: int, lines: bool) -> DataFrame:
    """(id, n, hash) of whole texts, or also of their ``lines``, that have 1 to ``fewest`` - 1 words."""

    def work():
        def one(text: str) -> tuple[list]:
            found = {_short(part, fewest) for part in ([text, *text.splitlines()] if lines else [text])} - {None}
            return ([{"n": n, "hash": h} for n, h in found],)

        return one

    found = per_text(rows, id_col, text_col, "short array<struct<n: int, hash: bigint>>", work)
    return found.select(F.col(id_col).alias("id"), F.explode("short").alias("s")).select("id", "s.n", "s.hash").distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 8, enough: int = 13, fewest: int = 5, most_broadcast: int = 2_000_000,
    least_literals: int = 2,
) -> DataFrame:
    """(id, ``item_id``, ``covered``, ``item_tokens``, ``same_slots``) of every document that holds part of an item.

    A pair counts if an alignment covers ``enough`` words of the item, or half of it where that is less, but a window
    at least; items shorter than ``window`` must lie in the document whole, those under ``fewest`` words must be its text or a line of it.
    Beside slots that differ a quarter of the covered words, and ``least_literals`` at least, must be literal ones.
    ``same_slots``: numbers, units and names are those of the item (as opposed to re-parameterised).
    Up to ``most_broadcast`` distinct item hashes are sent to the tasks to thin out the documents' windows; beyond, all
    windows meet in the join.  Rows without an id, on either side, count as one row with a null id.  Repeated rows change nothing.
    """
    spark = docs.sparkSession
    ids = [F.col(item_col).alias("item_id"), whole(item_text_col).alias("text")]
    items = written(template_windows(benchmark.select(*ids), "item_id", "text", list(range(fewest, window + 1))), "item-windows")
    items = items.where(F.col("size") == F.least("tokens", F.lit(window))).dropDuplicates(["id", "size", "pos", "hash", "fillers"])
    items = written(items, "item-windows")
    sizes = [r.size for r in items.select("size").distinct().collect()]  # window - fewest + 1 values at most
    distinct = items.select("hash").distinct()
    wanted = None
    if distinct.count() <= most_broadcast:
        hashes = np.array([r.hash for r in distinct.collect()], np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(hashes))
    found = template_windows(docs, id_col, text_col, sizes, wanted).drop("tokens")
    if wanted is not None:
        found = written(found, "document-windows")
    sides = items.select(
        F.col("id").alias("item_id"), "size", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"),
        F.col("fillers").alias("item_fillers"), F.col("tokens").alias("item_tokens"),
    )
    columns = ["id", "item_id", "item_tokens", "diagonal", "size", "item_pos", "slots", "fillers", "item_fillers"]
    pairs = found.where("size(slots) < size").join(sides.where("size(item_slots) < size"), ["size", "hash"]).where("slots = item_slots")
    pairs = written(pairs.withColumn("diagonal", F.expr("pos - item_pos")).select(*columns), "window-pairs")
    alignment = ["id", "item_id", "item_tokens", "diagonal"]
    bare = sides.where("size(item_slots) = size")
    if not bare.isEmpty():
        anchors = pairs.select(*alignment, "size").distinct().alias("a")
        at = [F.col("a.item_id").eqNullSafe(F.col("b.item_id")), F.expr("a.item_tokens = b.item_tokens"), F.expr("a.size = b.size")]
        sought = anchors.join(bare.alias("b"), at).select("a.*", "b.hash", "b.item_pos", "b.item_slots", "b.item_fillers", F.expr("a.diagonal + b.item_pos").alias("pos"))
        at = [F.col("f.id").eqNullSafe(F.col("s.id")), *[F.col(f"f.{c}") == F.col(f"s.{c}") for c in ("size", "pos", "hash")]]
        more = found.where("size(slots) = size").alias("f").join(sought.alias("s"), at)
        pairs = pairs.unionByName(written(more.select("s.id", "s.item_id", "s.item_tokens", "s.diagonal", "s.size", "s.item_pos", "f.slots", "f.fillers", "s.item_fillers"), "bare-pairs"))
    filled = (
        pairs.select(*alignment, F.explode(F.arrays_zip("fillers", "item_fillers")).alias("x"))
        .select(*alignment, F.col("x.fillers").alias("here"), F.col("x.item_fillers").alias("there"))
        .distinct()
    )
    consistent = filled.groupBy(*alignment).agg(
        F.count(F.lit(1)).alias("maps"), F.countDistinct("there").alias("theres"),
        F.bool_and(F.expr("here = there")).alias("same"),
    )
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in alignment]
    literal = F.when(F.expr("fillers = item_fillers"), F.col("item_pos"))
    places = {"at": F.col("item_pos"), "literal_at": literal}
    covered = pairs.groupBy(*alignment).agg(F.max("size").alias("size"), *[F.array_sort(F.collect_set(c)).alias(n) for n, c in places.items()])
    word = F.expr("explode(transform(array_except(sequence(0, size - 1), slots), i -> item_pos + i))").alias("word")
    words = pairs.select(*alignment, word).groupBy(*alignment).agg(F.countDistinct("word").alias("literals"))
    reach = "case size({0}) when 0 then 0 when 1 then size else aggregate(sequence(0, size({0}) - 2), size, (n, i) -> n + least(size, {0}[i + 1] - {0}[i])) end"
    covered = covered.select(*alignment, "size", F.expr(reach.format("at")).alias("covered"), F.expr(reach.format("literal_at")).alias("literal_covered"))
    same_words = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in alignment]
    joined = covered.alias("p").join(consistent.alias("s"), same, "left").join(words.alias("w"), same_words, "left").select(
        *[F.col(f"p.{c}").alias(c) for c in [*alignment, "size", "covered", "literal_covered"]],
        F.coalesce("w.literals", F.lit(0)).alias("literals"),
        (F.col("s.maps").isNull() | (F.col("s.maps") == F.col("s.theres"))).alias("consistent"),
        F.coalesce("s.same", F.lit(True)).alias("same_slots"),
    )
    enough_words = F.least(F.lit(enough), F.greatest(F.ceil(F.col("item_tokens") / 2), F.col("size")))
    # slots that do not fit, or too few words beside them, leave what is literally the same
    joined = joined.withColumn("consistent", F.expr(f"consistent and literals >= {least_literals} and literals * 4 >= covered"))
    joined = joined.withColumn("covered", F.expr("if(consistent, covered, literal_covered)")).withColumn("same_slots", F.expr("same_slots or not consistent"))
    kept = joined.where(F.col("covered") >= enough_words)
    kept = kept.select("id", "item_id", "covered", "same_slots", "item_tokens")
    short = written(short_texts(benchmark.select(*ids), "item_id", "text", fewest, False), "short-items")
    if not short.isEmpty():
        short = short.select(F.col("id").alias("item_id"), "n", "hash")
        lines = short_texts(docs, id_col, text_col, fewest, True).join(short, ["n", "hash"])
        kept = kept.unionByName(lines.select("id", "item_id", F.col("n").alias("covered"), F.lit(True).alias("same_slots"), F.col("n").alias("item_tokens")))
    return (
        kept.groupBy(F.col("id").alias(id_col), "item_id")
        .agg(F.max(F.struct("covered", "same_slots", "item_tokens")).alias("best"))
        .select(id_col, "item_id", F.col("best.covered").alias("covered"), F.col("best.item_tokens").alias("item_tokens"), F.col("best.same_slots").alias("same_slots"))
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows without a contaminated pair, whole; a row is known by its id and its text."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(whole(text_col)).alias("h"))
    rows = docs.withColumn("__key", key)
    found = contaminated(rows.select("__key", F.col(text_col).alias("text")), benchmark, "__key", "text", **how)
    gone = written(found.select(F.col("__key").alias("__gone")).distinct(), "contaminated")
    return rows.join(gone, F.col("__key").eqNullSafe(F.col("__gone")), "left_anti").select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
