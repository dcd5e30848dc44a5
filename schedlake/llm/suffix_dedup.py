"""Removal of repeated substrings by suffix arrays of shards.

A window of ``least`` bytes belongs to the smallest hash of the short grams inside it (the leftmost of equal
ones).  Which gram that is depends on the window alone, so equal windows have equal owners, wherever they
lie.  Windows with one owner lie side by side; such a stretch and its bytes are a piece.

1. Pieces come out as hashes.  Owners that occur once are done.  Pieces that occur as a whole more than once
   are repeated as a whole; hashes settle that, and pieces of copies and shared passages stop here.
2. What is left are pieces whose owner occurs elsewhere in other bytes.  They are cut into blocks of windows
   by their distance to the owner; all windows of a block have a core in common, so equal windows have equal
   cores.  The same two questions are asked of the blocks.  Near copies, whose edits lie closer together than
   a window is long, stop here.
3. Blocks that are left lie at the edges of copies and passages.  Their bytes, with one representative of
   every repeated block, are dealt by core to shards of a few megabytes.  A shard's suffix array is induced
   in linear time; permuted common prefixes show which windows share all their bytes with another one.
4. A core with more than ``most`` different blocks does not fit a shard: its windows are counted by their
   128-bit hashes instead, which adds up before it is shuffled.

Hashes that decide are of 128 bits (owner or core, and bytes, 64 each; or a window's).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import arrow, arrow_types, table, whole
from schedlake.llm.suffix_array import common_prefixes, suffix_array
from schedlake.session import written

CHUNK = 1 << 19  # windows looked at together; a position in a chunk has 20 bits
PLACE = (1 << 20) - 1


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of an odd base and of its inverse (modulo 2^64)."""
    rng = np.random.default_rng(20)
    of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return of_byte, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def pieces(raw: bytes, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of every piece, and its owner's place and hash."""
    n_windows, w = len(raw) - least + 1, least - gram + 1
    if n_windows < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    data, out = np.frombuffer(raw, np.uint8), []
    for at in range(0, n_windows, CHUNK):
        part = data[at : min(at + CHUNK, n_windows) + least - 1]
        of_byte, up, down = _powers(CHUNK + least)
        sums = np.append(np.uint64(0), np.cumsum(of_byte[part] * up[: len(part)], dtype=np.uint64))
        h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        key = (h & ~np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        # the least key of each window from the least ones before and behind block borders
        blocks = np.append(key, np.full(-len(key) % w, ~np.uint64(0))).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(blocks, axis=1).ravel()
        n = len(key) - w + 1
        owner = (np.minimum(ahead[:n], behind[w - 1 : w - 1 + n]) & np.uint64(PLACE)).astype(np.int64)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out.append((first + at, np.append(first[1:], n) - 1 + at, owner[first] + at, h[owner[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


KEY = ["id", "h"]  # a row: its id and a hash of its text
# a stretch of windows: hashes of what its windows share and of all its bytes, first and last window, the owner's
# place, and for how many equal ones it stands (the last one ends with window ``upto``); not open ones are settled
SEEN = "a bigint, t bigint, low int, high int, upto int, own int, n int, open boolean"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("raw"))


def _digests(raw: bytes, low: np.ndarray, stop: np.ndarray) -> np.ndarray:
    import xxhash

    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[x:y]) for x, y in zip(low.tolist(), stop.tolist(), strict=True)), np.uint64, len(low))


def _stretches(rows: DataFrame, found_in: Callable[..., tuple]) -> DataFrame:
    """(id, h, base) and the columns of ``SEEN`` that ``found_in`` returns for each row of (id, h, bytes, ...)."""
    schema = f"id {dict(rows.dtypes)['id']}, h bigint, base int, {SEEN}"
    types = arrow_types(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, bases, found, held = [], [], [], [], 0

            def out():
                return arrow([ids, hs, bases, *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], types)

            for row_id, h, base, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = found_in(*rest)
                n = len(columns[0])
                if n:
                    ids += [row_id] * n
                    hs += [h] * n
                    bases += [base] * n
                    found.append(columns)
                    held += n
                if held > 50_000:
                    yield out()
                    ids, hs, bases, found, held = [], [], [], [], 0
            if held:
                yield out()

    return rows.mapInArrow(run, schema)


def _pieces_of(rows: DataFrame, least: int, gram: int) -> DataFrame:
    def found_in(raw: bytes):
        low, high, own, a = pieces(raw, least, gram)
        t = _digests(raw, low, high + least)
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (t[1:] != t[:-1]))) if len(low) else low
        n = np.diff(np.append(head, len(low)))  # equal pieces side by side, as in a text with a period, are one
        upto = high[head + n - 1]
        return a[head].view(np.int64), t[head].view(np.int64), low[head], high[head], upto, own[head], n, np.ones(len(head), bool)

    return _stretches(rows.select("id", "h", F.lit(0).alias("base"), "raw"), found_in)


def _blocks_of(cut: DataFrame, least: int, gram: int, blocks: int) -> DataFrame:
    size = -(-(least - gram + 1) // blocks)

    def found_in(a: int, low: int, own: int, settled: bool, raw: bytes):
        at = np.arange(blocks)
        high = low + len(raw) - least
        first, last = np.maximum(own - (at + 1) * size + 1, low), np.minimum(own - at * size, high)
        some = first <= last
        at, first, last = at[some], first[some], last[some]
        core = own - at * size  # the last window of a whole block; its first one is size - 1 before
        shared = _digests(raw, core - low, core - size + 1 + least - low)
        shared = (shared ^ np.uint64(a & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)
        t = _digests(raw, first - low, last + least - low)
        weight = np.full(len(at), 2 if settled else 1)
        return shared.view(np.int64), t.view(np.int64), first, last, last, np.full(len(at), own), weight, np.full(len(at), not settled)

    return _stretches(cut.select("id", "h", F.col("low").alias("base"), "a", "low", "own", "settled", "bytes"), found_in)


def _settle(seen: DataFrame, least: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans of the open stretches that hashes show to be repeated as a whole, and the stretches that bytes must decide."""
    seen = written(seen, name)
    owners = seen.groupBy("a").agg(F.sum("n").alias("all"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    owners = written(owners.where("all > 1").select("a", (F.col("t0") == F.col("t1")).alias("alike")), f"{name}-owners")
    met = written(seen.join(owners, "a"), f"{name}-met")
    span = ["id", "h", F.col("low").alias("start"), (F.col("upto") + least).alias("stop")]
    spans = met.where("alike AND open").select(*span)
    unlike = met.where("NOT alike")
    place = F.struct("id", "h", "base", "low", "high", "own")
    kinds = written(unlike.groupBy("a", "t").agg(F.sum("n").alias("all"), F.min(place).alias("one")), f"{name}-kinds")
    often = kinds.where("all > 1").select("a", "t")
    spans = spans.unionByName(unlike.where("open").join(often, ["a", "t"], "left_semi").select(*span))
    return spans, kinds.select("a", "one.*", (F.col("all") > 1).alias("settled"))


def _bytes_of(rows: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(a, id, h, low, own, settled, bytes) of the stretches asked for, from rows of (id, h, base, raw)."""
    key = F.struct("id", "h", "base").alias("k")
    wanted = asked.groupBy(key).agg(F.collect_list(F.struct("a", "low", "high", "own", "settled")).alias("wanted"))
    got = rows.select(key, "raw").join(wanted, "k").select("k.*", "raw", F.explode("wanted").alias("x"))
    part = F.expr(f"substring(raw, x.low - base + 1, x.high - x.low + {least})")
    return got.select("x.a", "id", "h", "x.low", "x.own", "x.settled", part.alias("bytes"))


SPANS = "id {}, h bigint, start int, stop int"


def shard_repeats(rows: list[tuple[bool, bytes]], least: int) -> list[np.ndarray]:
    """For each (settled, bytes): the windows found elsewhere in the shard.  A settled piece counts as there already twice."""
    sizes = np.array([len(b) for _, b in rows])
    begins = np.append(0, np.cumsum(sizes + 1)[:-1])
    text = np.frombuffer(b"\0".join(b for _, b in rows), np.uint8).astype(np.int64) + 1
    text[begins[1:] - 1] = 0  # between pieces
    order = suffix_array(text)
    most = 2 * int(sizes.max()) + least  # a prefix this long covers what may be derived from it
    shared = common_prefixes(text, order, begins, most)
    weight = np.zeros(len(text), np.int64)
    for (settled, _), begin, size in zip(rows, begins.tolist(), sizes.tolist(), strict=True):
        weight[begin : begin + size - least + 1] = 2 if settled else 1
    group = np.cumsum(shared[order] < least)  # runs of suffixes with the same window
    often = np.bincount(group, weights=weight[order]) > 1
    repeated = np.zeros(len(text), bool)
    repeated[order] = often[group]
    repeated &= weight == 1
    return [np.flatnonzero(repeated[b : b + s]) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of neighbouring numbers."""
    head = np.flatnonzero(np.append(True, np.diff(at) > 1)) if len(at) else []
    return [(int(at[i]), int(at[j - 1])) for i, j in zip(head, np.append(head[1:], len(at)), strict=True)] if len(at) else []


def _by_shards(cut: DataFrame, least: int, shard_bytes: int) -> DataFrame:
    """Spans of the repeated windows of pieces; all pieces of an owner meet in one shard."""
    schema = SPANS.format(dict(cut.dtypes)["id"])
    types = arrow_types(cut.sparkSession, schema)

    def solve(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = []
        for (_, row_id, h, low, _, _), at in zip(shard, shard_repeats([(x[4], x[5]) for x in shard], least), strict=True):
            found += [(row_id, h, low + first, low + last + least) for first, last in _runs(at)]
        if found:
            yield arrow([list(c) for c in zip(*found, strict=True)], types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= shard_bytes and row[0] != shard[-1][0]:
                    yield from solve(shard)
                    shard, held = [], 0
                shard.append(row)
                held += len(row[5])
        if shard:
            yield from solve(shard)

    return cut.repartition("a").sortWithinPartitions("a").mapInArrow(run, schema)


def _by_hashes(cut: DataFrame, least: int) -> DataFrame:
    """The same for pieces of owners too frequent for a shard, over window hashes."""
    kind = dict(cut.dtypes)["id"]
    schema = f"id {kind}, h bigint, start int, settled boolean, w1 bigint, w2 bigint"
    types = arrow_types(cut.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = []
                for _, row_id, h, low, settled, raw in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    view = memoryview(raw)
                    for i in range(len(raw) - least + 1):
                        w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(view[i : i + least]), np.int64).tolist()
                        found.append((row_id, h, low + i, settled, w1, w2))
                if found:
                    yield arrow([list(c) for c in zip(*found, strict=True)], types)

    windows = written(cut.mapInArrow(run, schema), "window-hashes")
    often = windows.groupBy("w1", "w2").agg(F.sum(F.when(F.col("settled"), 2).otherwise(1)).alias("n")).where("n > 1").select("w1", "w2")
    hits = windows.where("not settled").join(written(often, "window-repeats"), ["w1", "w2"], "left_semi")
    return hits.select("id", "h", "start", (F.col("start") + least).alias("stop"))


def repeated_spans(rows: DataFrame, least: int, gram: int, blocks: int, most: int, shard_bytes: int) -> DataFrame:
    """(id, h, start, stop): spans of bytes, overlapping ones too, that cover every repeated window and nothing else."""
    of_pieces, asked = _settle(_pieces_of(rows, least, gram), least, "pieces")
    cut = written(_bytes_of(rows.withColumn("base", F.lit(0)), asked, least), "piece-bytes")
    of_blocks, asked = _settle(_blocks_of(cut, least, gram, blocks), least, "blocks")
    crowded = asked.groupBy("a").count().where(F.col("count") > most).select("a", F.lit(True).alias("crowded"))
    crowded = written(crowded, "block-crowds")
    edges = written(_bytes_of(cut.select("id", "h", F.col("low").alias("base"), F.col("bytes").alias("raw")), asked, least), "block-bytes")
    edges = edges.drop("own").join(crowded, "a", "left")
    cold, hot = edges.where("crowded IS NULL").drop("crowded"), edges.where("crowded").drop("crowded")
    spans = of_pieces.unionByName(of_blocks)
    return spans.unionByName(_by_shards(cold, least, shard_bytes)).unionByName(_by_hashes(hot, least))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400,
    gram: int = 64, blocks: int = 4, most: int = 2000, shard_bytes: int = 1 << 21,
) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary, the rest).

    A byte goes if a string of ``least`` bytes that covers it also starts anywhere else, in this text or another,
    judged on the texts as given.  Null texts are empty.  A repeated row is another place: texts of ``least`` bytes or
    more that occur twice go as a whole.  Rows without an id are treated like others.  Other columns are not read.
    """
    if not 0 < gram <= least:
        raise ValueError("a gram lies inside a window")
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, least, gram, blocks, most, shard_bytes)
    one = F.struct(*KEY).alias("k")
    merged = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(one, "spans")
    schema = f"`{id_col}` {dict(rows.dtypes)['id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    types = arrow_types(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = []
                for row_id, raw, spans in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    keep, end, runs, gone = [], 0, 0, 0
                    for start, stop in sorted((x["start"], x["stop"]) for x in spans or []):
                        if start > end or not runs:
                            keep.append(raw[end:start])
                            runs, gone, end = runs + 1, gone + stop - start, stop
                        elif stop > end:
                            gone, end = gone + stop - end, stop
                    found.append((row_id, len(raw), gone, runs, b"".join([*keep, raw[end:]])))
                if found:
                    yield arrow([list(c) for c in zip(*found, strict=True)], types)

    joined = rows.select(one, "raw").join(merged, "k", "left").select("k.id", "raw", "spans")
    return joined.mapInArrow(run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
