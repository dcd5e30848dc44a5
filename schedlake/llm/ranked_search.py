"""Ranked lexical search by treaps over grids of terms and documents.

Documents are cut into blocks.  A block is a grid: rows are its terms in order, columns its documents by id, a point is
an occurrence with its impact ``(10**9 * tf) div (1000 * tf + 8 * m)``.  Points are sorted along the Z curve, and a
quadtree over them keeps only cells with at least two occupied quadrants (compressed); every cell holds the largest
impact inside it.  The weight of a term belongs to its row as a whole, so it is not stored: a query multiplies.

A query follows one path of cells for each of its terms.  All paths descend together over ranges of documents; the sum
of weight times cell maximum bounds the score of every document in the range, and is the score where the
range is one document.  Ranges are taken best first until none can get among the best any more.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schedlake.llm.common import arrow, arrow_types, table, whole
from schedlake.session import written

#: A-Z in lower case; 0-9, a-z and all bytes of other scripts as they are; the rest separates
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOGETHER = 256  # ranges that are split in one step
INDEX = "doc_ids array<long>, vocabulary binary, df binary, codes binary, impacts binary, levels binary, firsts binary, kids binary"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def _pack(values: np.ndarray, steps: bool = False) -> bytes:
    """Compressed bytes, those of equal weight together; ``steps``: of ascending values, the differences."""
    import zstandard

    if steps:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = values.reshape(-1, 1).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes, kind: type, steps: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if steps else values


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers with a zero bit above each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def quadtree(codes: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted points: (level, place of the first point, four children or -1) of every inner cell, and all maxima, points first.

    Cells are numbered behind the points, smaller cells first; the last one holds everything.
    """
    n = len(codes)
    levels, firsts, kids, most = [], [], [], [impacts]
    node, first, best, made, level = np.arange(n), np.arange(n), impacts, n, 0
    while len(node) > 1:
        level += 1
        key = codes[first] >> np.uint64(2 * level)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(node)])
        new = counts > 1
        if not new.any():
            continue
        best_of = np.maximum.reduceat(best, starts)
        size = int(new.sum())
        own = np.full((size, 4), -1, np.int32)
        inside = np.repeat(new, counts)
        quadrant = (codes[first[inside]] >> np.uint64(2 * level - 2)).astype(np.int64) & 3
        own[np.repeat(np.arange(size), counts[new]), quadrant] = node[inside]
        levels.append(np.full(size, level, np.uint8))
        firsts.append(first[starts[new]].astype(np.int32))
        kids.append(own)
        most.append(best_of[new])
        node = node[starts]
        node[new] = np.arange(made, made + size)
        first, best, made = first[starts], best_of, made + size
    empty = np.empty(0)
    return (
        np.concatenate([empty.astype(np.uint8), *levels]), np.concatenate([empty.astype(np.int32), *firsts]),
        np.concatenate([empty.astype(np.int32).reshape(0, 4), *kids]), np.concatenate(most).astype(np.int32),
    )


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [len(terms(t.as_py())) for batch in batches for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(c > 0 for c in counts)]), pa.array([sum(counts)])], names=["n", "l"])

    sums = docs.select(whole(text_col).alias("text")).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return sums[0] or 0, sums[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 4096, block_points: int = 2_000_000) -> DataFrame:
    """A written table with a row for each block of at most ``block_docs`` documents (a block also ends beyond ``block_points`` points).

    All terms of all rows are in it.  Rows without terms (null and empty texts among them) are left out, since no query can find them.  Repeated
    rows and rows that share an id are documents of their own; those without an id come last among equals.  Other columns are not read.
    """
    spark = docs.sparkSession
    n_docs, n_terms = corpus_size(docs, text_col)
    types = arrow_types(spark, INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, owners, points, tfs, sizes, known, held = [], [], [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            column = np.empty(len(ids), np.int64)
            column[order] = np.arange(len(ids))
            words = sorted(known)
            row = np.empty(len(words), np.int64)
            row[[known[w] for w in words]] = np.arange(len(words))
            rows = row[np.concatenate(points)]
            where = np.repeat(np.arange(len(ids)), owners)
            tf = np.concatenate(tfs)
            m = 10 + 90 * np.array(sizes, np.int64) * n_docs // n_terms
            impacts = 10**9 * tf // (1000 * tf + 8 * m[where])
            codes = (_spread(rows) << np.uint64(1)) | _spread(column[where])
            by = np.argsort(codes)
            codes, impacts = codes[by], impacts[by].astype(np.int32)
            levels, firsts, kids, most = quadtree(codes, impacts)
            return arrow(
                [
                    [[ids[i] for i in order]], [_pack(np.frombuffer(b"\n".join(words), np.uint8))], [_pack(np.bincount(rows).astype(np.int32))],
                    [_pack(codes, True)], [_pack(most)], [_pack(levels)], [_pack(firsts)], [_pack(kids.reshape(-1))],
                ],
                types,
            )

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                found = Counter(words)
                ids.append(id_)
                sizes.append(len(words))
                owners.append(len(found))
                points.append(np.array([known.setdefault(w, len(known)) for w in found]))
                tfs.append(np.fromiter(found.values(), np.int64, len(found)))
                held += len(found)
                if len(ids) >= block_docs or held >= block_points:
                    yield block()
                    ids, owners, points, tfs, sizes, known, held = [], [], [], [], [], {}, 0
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    return written(rows.mapInArrow(run, INDEX), "search-index")


class Block:
    """A block of the index, unpacked."""

    def __init__(self, row: dict):
        codes = _unpack(row["codes"], np.uint64, True)
        levels, firsts = _unpack(row["levels"], np.uint8), _unpack(row["firsts"], np.int32)
        self.ids, n = row["doc_ids"], len(codes)
        self.most = _unpack(row["impacts"], np.int32).astype(np.int64)
        self.kids = _unpack(row["kids"], np.int32).reshape(-1, 4)
        self.level = np.concatenate([np.zeros(n, np.int64), levels])
        code = np.concatenate([codes, codes[firsts]])
        self.row, self.col, self.points = _gather(code >> np.uint64(1)), _gather(code), n
        self.words = _unpack(row["vocabulary"], np.uint8).tobytes().split(b"\n")

    def rows_of(self, wanted: dict[bytes, int]) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words) if w in wanted}

    def _split(self, level: np.ndarray, col: np.ndarray, state: np.ndarray, node: np.ndarray, row: np.ndarray):
        """Halves of document ranges: for each half with cells left, (parent, half, where its cells begin), and the cells with their term."""
        own = self.level[node] == level[state]
        at, lower = np.flatnonzero(own), np.flatnonzero(~own)
        bit = (row[at] >> (level[state[at]] - 1)) & 1
        kid = self.kids[node[at] - self.points]
        picked = kid[np.arange(len(at))[:, None], 2 * bit[:, None] + np.array([0, 1])]
        ok = picked >= 0
        depth = self.level[np.where(ok, picked, 0)]
        ok &= (self.row[np.where(ok, picked, 0)] >> depth) == (row[at][:, None] >> depth)
        which, half = np.nonzero(ok)
        beside = (self.col[node[lower]] >> (level[state[lower]] - 1)) - 2 * col[state[lower]]
        pair = np.concatenate([at[which], lower])
        half = np.concatenate([half, beside])
        cell = np.concatenate([picked[ok], node[lower]])
        order = np.argsort(2 * state[pair] + half, kind="stable")
        pair, half, cell = pair[order], half[order], cell[order]
        key = 2 * state[pair] + half
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        return state[pair[starts]], half[starts], starts, pair, cell

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offers every document that may be among the best for the weighted rows."""
        if not self.points:
            return
        root, top = len(self.level) - 1, int(max(self.row.max(), self.col.max())).bit_length()
        on = rows >> self.level[root] == self.row[root] >> self.level[root]
        rows, weights = rows[on], weights[on]
        bound = int((weights * self.most[root]).sum())
        queue = [_Entry((-bound, 0, top, np.full(len(rows), root), rows, weights))] if len(rows) else []
        while queue:
            taken = []
            while queue and len(taken) < TOGETHER:
                entry = heapq.heappop(queue)
                first = self.ids[entry[1] << entry[2]]
                if not best.wants(-entry[0], first):
                    if -entry[0] < best.least():
                        queue = []  # nor any that follows
                    continue
                if entry[2]:
                    taken.append(entry)
                else:
                    best.offer(-entry[0], first)
            if not taken:
                continue
            level, col = (np.array([e[i] for e in taken], np.int64) for i in (2, 1))
            node, row, weight = (np.concatenate([e[i] for e in taken]) for i in (3, 4, 5))
            state = np.repeat(np.arange(len(taken)), [len(e[3]) for e in taken])
            parent, half, starts, pair, cell = self._split(level, col, state, node, row)
            if not len(starts):
                continue
            row, weight = row[pair], weight[pair]
            bounds = np.add.reduceat(weight * self.most[cell], starts)
            ends = np.r_[starts[1:], len(cell)].tolist()
            for bound, p, h, s, e in zip(bounds.tolist(), parent.tolist(), half.tolist(), starts.tolist(), ends, strict=True):
                below = int(level[p]) - 1
                if bound > 0 and bound >= best.least():
                    heapq.heappush(queue, _Entry((-bound, 2 * int(col[p]) + h, below, cell[s:e], row[s:e], weight[s:e])))


class _Entry(tuple):
    """A range in the queue; of equal bounds the smaller range, then the earlier one, goes first."""

    def __lt__(self, other: tuple) -> bool:
        return (self[0], self[2], self[1]) < (other[0], other[2], other[1])


class Best:
    """The ``k`` highest scores so far, of equal ones the smallest ids; ids that are null come last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @staticmethod
    def _key(score: int, id_: int | None) -> tuple:
        return (score, id_ is not None, -(id_ or 0))

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) >= self.k else 0

    def wants(self, score: int, id_: int | None) -> bool:
        return score > 0 and (len(self.heap) < self.k or self._key(score, id_) > self.heap[0])

    def offer(self, score: int, id_: int | None) -> None:
        (heapq.heappush if len(self.heap) < self.k else heapq.heappushpop)(self.heap, self._key(score, id_))

    def rows(self) -> list[tuple[int, int | None]]:
        return [(score, -minus if there else None) for score, there, minus in self.heap]


def _item_slices(items: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> Iterator[dict]:
    """Items with their distinct terms, in slices of some ``slice_bytes`` of terms; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                words = sorted(set(terms(text.as_py())))
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(words), kind), pa.array(words, pa.binary())], names=["item", "word"])

    kind = arrow_types(items.sparkSession, f"item {dict(items.dtypes)[id_col]}")[0][1]
    rows = items.select(F.col(id_col).alias("item"), whole(text_col).alias("text")).mapInArrow(run, f"item {dict(items.dtypes)[id_col]}, word binary")
    rows = written(rows.distinct(), "search-items")
    size = rows.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    slices = -(-size // slice_bytes)
    for s in range(slices):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == s).toArrow()
        found: dict = {}
        for item, word in zip(part["item"].to_pylist(), part["word"].to_pylist(), strict=True):
            found.setdefault(item, []).append(word)
        if found:
            yield found


def _weights(index: DataFrame, words: set[bytes], n_docs: int) -> dict[bytes, int]:
    """Weights of the words that some document has.  At most a row a word comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for packed, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _unpack(df, np.int32)
                seen.update({w: int(counts[i]) for i, w in enumerate(_unpack(packed, np.uint8).tobytes().split(b"\n")) if w in words})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "df"])

    sums = index.select("vocabulary", "df").mapInArrow(run, "word binary, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    return {bytes(r.word): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in sums}


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, slice_bytes: int = 4_000_000) -> DataFrame:
    """(item id, rank, doc_id, score): the ``k`` best documents with a score above 0 for each item.

    The items go to the tasks in slices of some ``slice_bytes`` of terms (an item is never cut), each slice in a pass over the index, so that what
    is sent is bounded however many items there are.  Items without terms, null texts among them, and items that nothing matches have no rows.
    """
    spark, kind = index.sparkSession, dict(items.dtypes)[id_col]
    schema = f"item {kind}, doc_id long, score long"
    types = arrow_types(spark, schema)
    n_docs = index.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    found = None
    for part in _item_slices(items, id_col, text_col, slice_bytes):
        weights = _weights(index, {w for words in part.values() for w in words}, n_docs)
        sent = spark.sparkContext.broadcast((part, weights))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            part, weights = sent.value
            best = {item: Best(k) for item in part}
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block(batch.slice(i, 1).to_pylist()[0])
                    row = block.rows_of(weights)
                    for item, words in part.items():
                        own = [w for w in words if w in row]
                        if own:
                            block.search(np.array([row[w] for w in own]), np.array([weights[w] for w in own]), best[item])
            rows = [(item, id_, score) for item, b in best.items() for score, id_ in b.rows()]
            if rows:
                yield arrow(list(map(list, zip(*rows, strict=True))), types)

        one = index.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # each task has at most k rows an item; groups of tasks are thinned out first
    near = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


CHECK = r"""
    with d as materialized (
        select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
        from documents where text is not null
    ), sized as materialized (select doc_id, words, len(words)::bigint as n from d where len(words) > 0),
    corpus as (select count(*)::bigint as docs, sum(n)::bigint as terms from sized),
    item as materialized (
        select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as word
        from benchmark
    ), point as materialized (
        select doc_id, n, word, count(*)::bigint as tf from (select doc_id, n, unnest(words) as word from sized)
        where word in (select word from item) group by all
    ), weight as (
        select word, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
        from (select word, count(*)::bigint as df from point group by word), corpus
    ), scored as (
        select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
        from item join point using (word) join weight using (word), corpus group by item_id, doc_id
    )
    select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
    from scored where score > 0 qualify rank <= 10
"""
