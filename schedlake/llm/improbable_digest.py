"""Document fingerprints from improbable features.

Every byte window of a text has an entropy; a corpus-wide histogram over all windows of all texts says how
rare each entropy is.  In each run of neighbouring windows the rarest one (leftmost of equals) gets a vote, and
windows with enough votes are features.  Features go into a chain of Bloom filters, a fixed number to a filter,
and two digests are compared by the overlap of their filters' bits, normalised by what chance and the number
of bits allow.  A feature depends on the bytes around it alone, so an edit changes only the features it touches.

The query also needs the next document in descending id order.  Keys alone are sorted first; their range
borders then deal every text once, and the first row of a range goes to the range before it as well.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import arrow, arrow_types, table, whole

WINDOW, RUN, VOTES = 16, 32, 8  # bytes of a window; windows of a run; votes that make a feature
CLASSES, WEAK = 1001, 100  # entropy in thousandths of the highest; below WEAK a window says next to nothing
FILTER_BITS, HASHES, FEATURES = 2048, 5, 160  # of a filter; bits a feature sets; features of a full filter
ORDER = ("none", "back", "hash")  # of documents: descending ids, those without one last; equal ids by a hash of the text
ALPHA = 0.3  # share of the span between chance and full overlap that still counts as chance

_COST = np.round(np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1)) * 2**20).astype(np.int64)
_STEP = np.diff(_COST)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy class of every window of the bytes; a text shorter than a window has none."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    order = np.argsort(data, kind="stable")  # places of each byte value, ascending
    keys = data[order].astype(np.int64) * (n + WINDOW) + order
    back, forth = np.zeros(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):  # the same byte, k places of it further on, in one window with this one
        near = keys[k:] - keys[:-k] < WINDOW
        if not near.any():
            break
        back[k:] += near
        forth[:-k] += near
    here, ahead = np.empty(n, np.uint8), np.empty(n, np.uint8)  # in the window that ends here, without it; that begins here, with it
    here[order], ahead[order] = back, forth
    # sum of c * log2(c) over the bytes of a window, carried from each window to the next one
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = _COST[np.bincount(data[:WINDOW])].sum()
    np.cumsum(_STEP[here[WINDOW:]] - _STEP[ahead[: n - WINDOW] - 1], out=sums[1:])
    sums[1:] += sums[0]
    return ((_COST[WINDOW] - sums) * ((CLASSES - 1) / _COST[WINDOW])).astype(np.int64)


def ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each class: 0 for the rarest; weak ones come last, classes never seen count as rarest."""
    order = np.lexsort((np.arange(CLASSES), histogram, np.arange(CLASSES) < WEAK))
    rank = np.empty(CLASSES, np.int64)
    rank[order] = np.arange(CLASSES)
    return rank


def features(data: np.ndarray, classes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes of the distinct features, in the order of their places; of a short text, one for its bytes."""
    n = len(classes)
    if not n:
        chosen = np.zeros((min(len(data), 1), WINDOW), np.uint8)
        chosen[:, : len(data)] = data
    else:
        pad = np.full(RUN - 1, np.iinfo(np.int64).max)
        least = np.concatenate([pad, (rank[classes] << 32) | np.arange(n), pad])  # runs reach over both ends
        wide = 1
        while wide < RUN:
            step = min(wide, RUN - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        votes = np.bincount(least & 0xFFFFFFFF, minlength=n)
        places = np.flatnonzero(votes >= min(VOTES, votes.max()))
        chosen = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places]
    hashes = np.full(len(chosen), (len(data) if not n else WINDOW) + 1, np.uint64)
    for column in np.ascontiguousarray(chosen).view("<u8").T:
        hashes = (hashes ^ column) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain: a row of bytes for every FEATURES features."""
    bits = np.zeros((-(-len(hashes) // FEATURES), FILTER_BITS), bool)
    row = np.arange(len(hashes)) // FEATURES
    for i in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * i)).astype(np.int64) % FILTER_BITS] = True
    return np.packbits(bits, axis=1)


class Digest:
    """Filters of a text and the number of its features."""

    __slots__ = ("n", "rows", "size")

    def __init__(self, data: np.ndarray, classes: np.ndarray, rank: np.ndarray):
        hashes = features(data, classes, rank)
        self.n, self.rows = len(hashes), filters(hashes).view(np.uint64)
        self.size = np.bitwise_count(self.rows).sum(axis=1, dtype=np.int64)

    def __str__(self) -> str:
        return f"{self.n}:{base64.b64encode(self.rows.tobytes()).decode()}"


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1, the same both ways: each filter of the shorter digest against its best match, weighted by features.

    Two digests without features are alike; with and without are not.
    """
    if not a.n or not b.n:
        return float(a.n == b.n)
    if (a.n, a.rows.tobytes()) > (b.n, b.rows.tobytes()):
        a, b = b, a
    total, step = 0.0, max(1, 65536 // len(b.rows))
    for at in range(0, len(a.rows), step):
        rows, size = a.rows[at : at + step, None], a.size[at : at + step, None]
        common = np.bitwise_count(rows & b.rows[None]).sum(axis=2, dtype=np.int64)
        most = np.minimum(size, b.size)
        chance = size * b.size / FILTER_BITS
        floor = chance + ALPHA * (most - chance)
        score = np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(axis=1)
        held = np.minimum(a.n - FEATURES * np.arange(at, at + len(score)), FEATURES)
        total += float((score * held).sum())
    return min(1.0, total / a.n)


def entropy_histogram(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all texts have each entropy class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for text in batch.column(0):
                seen += np.bincount(entropies(np.frombuffer(text.as_py().encode(), np.uint8)), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(seen)], names=["class", "n"])

    rows = docs.select(whole(text_col).alias("text")).mapInArrow(run, "class long, n long")
    found = np.zeros(CLASSES, np.int64)
    for r in rows.groupBy("class").agg(F.sum("n").alias("n")).collect():  # as many rows as classes
        found[r["class"]] = r.n
    return found


def _borders(rows: DataFrame, ranges: int) -> list[tuple]:
    """Key of the first row of each of so many ranges, along the order of documents.  Only keys move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                break

    keys = rows.select(*ORDER).repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER)
    return sorted(tuple(r) for r in keys.mapInArrow(run, "none boolean, back long, hash long").collect())


def digest_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 1 << 26) -> DataFrame:
    """Fingerprint of every row and of its edited text, and how alike they and the next document's are.

    The next document is the one with the next smaller id, after the last one the first; rows with equal ids follow
    each other by a hash of their texts, rows without id come last, and a lone row is its own next one.  The edited
    text has its last third replaced by as much of the next text.  Null texts are empty: no features, an
    empty chain (``0:``).  Repeated rows come out as often as they go in; other columns are not read.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    histogram = entropy_histogram(docs, text_col)
    rank = ranks(histogram)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(histogram.sum() // part_bytes) + 1)
    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"),
        F.col(id_col).isNull().alias("none"), F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(0)).alias("back"),
    )
    borders = _borders(rows, 4 * tasks)  # some ranges to each task even out
    dealt = f"part long, none boolean, back long, hash long, closes boolean, id {kind}, text string"
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    to_types, out_types = arrow_types(spark, dealt), arrow_types(spark, schema)
    first = set(borders)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, take, closes = [], [], []
            for i, key in enumerate(zip(*(batch[c].to_pylist() for c in ORDER), strict=True)):
                at = max(0, bisect_right(borders, key) - 1)
                part.append(at)
                take.append(i)
                closes.append(False)
                if key in first:
                    part.append((at - 1) % len(borders))
                    take.append(i)
                    closes.append(True)
            rows = batch.take(pa.array(take, pa.int64()))
            yield arrow([part, *(rows[c] for c in ORDER), closes, rows["id"], rows["text"]], to_types)

    def digest(text: str) -> tuple[bytes, np.ndarray, np.ndarray, Digest]:
        data = np.frombuffer(raw := text.encode(), np.uint8)
        classes = entropies(data)
        return raw, data, classes, Digest(data, classes, rank)

    def answer(id_, text: str, made: tuple, next_text: str, next_made: tuple) -> tuple:
        raw, data, classes, mine = made
        cut = len(text) - len(text) // 3
        head, tail = text[:cut].encode(), next_text[: len(text) // 3].encode()
        after = head + tail
        if after == raw:
            theirs = mine
        else:
            new = np.frombuffer(after, np.uint8)
            kept = max(0, len(head) - WINDOW + 1)  # windows that the edit does not touch
            theirs = Digest(new, np.concatenate([classes[:kept], entropies(new[kept:])]), rank)
        return (id_, len(text), hashlib.sha256(after).hexdigest(), str(mine), str(theirs), likeness(mine, theirs), likeness(mine, next_made[3]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waits, out = None, None, []
        for batch in itertools.chain(batches, [None]):
            for at, closes, id_, text in zip(*(batch[c].to_pylist() for c in ("part", "closes", "id", "text")), strict=True) if batch is not None else []:
                if at != part:
                    part, waits = at, None
                elif waits is None:  # closing rows with the same key: one is enough
                    continue
                made = digest(text)
                if waits is not None:
                    out.append(answer(*waits, text, made))
                waits = None if closes else (id_, text, made)
                if len(out) >= 1024:
                    yield arrow(list(map(list, zip(*out, strict=True))), out_types)
                    out = []
        if out:
            yield arrow(list(map(list, zip(*out, strict=True))), out_types)

    parts = rows.mapInArrow(deal, dealt).repartition(tasks, "part").sortWithinPartitions("part", "closes", *ORDER)
    return parts.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_with_next(table(spark, sf_dir, "documents"))
