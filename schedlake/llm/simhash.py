"""Near duplicates by SimHash and multi-index hashing.

A fingerprint is cut into two halves of 32 bits.  Two fingerprints at most three bits apart have a half
in which they differ by at most one bit, so a table holds each fingerprint under both of its halves,
and each probes the ball of radius one around either half (33 keys).  What meets in a bucket is verified
on all 64 bits.  Only links that join two parts of a bucket come out (a spanning forest), never all pairs.

Equal fingerprints are one row throughout.  A bucket with more than ``most`` members is cut again by the
two quarters of the other half, again with balls of radius one: under such a key lie at most 65,536
table rows, whatever the number of documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import give_back, per_text, sent_whole, table, whole
from schedlake.llm.components import components
from schedlake.session import written

SEED = 42


def simhash(text: str, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint over the words' shingles, A-Z in lower case; 0 without words."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z fold, only ASCII white space separates
    if not words:
        return 0
    if len(words) < shingle:
        joined = iter([b" ".join(words)])
        n = 1
    else:
        joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))  # ends with the shortest
        n = len(words) - shingle + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        size = min(65536, n - at)
        h = np.fromiter((digest(s, SEED) for _, s in zip(range(size), joined)), np.dtype(">u8"), size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The id and ``fingerprint`` (bigint) of every row; null texts are empty and have fingerprint zero."""

    def work():
        return lambda text: (simhash(text, shingle),)

    return per_text(docs, id_col, text_col, "fingerprint bigint", work)


def _cut(rows: DataFrame, keep: list[str], low: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Table rows, and probes one bit away, of the two parts of ``size`` bits from bit ``low`` (SQL) on."""

    def keyed(values: str) -> DataFrame:
        parts = [
            f"transform({values.format(part=f'(shiftrightunsigned(fingerprint, int({low}) + {i * size}) & {(1 << size) - 1}L)')},"
            f" v -> named_struct('part', {i}, 'value', v))"
            for i in (0, 1)
        ]
        return rows.select(*keep, "fingerprint", F.expr(f"explode(concat({', '.join(parts)}))").alias("k")).select(
            *keep, "k.part", "k.value", "fingerprint"
        )

    return keyed("array({part})"), keyed(f"transform(sequence(0, {size - 1}), b -> {{part}} ^ shiftleft(1L, b))")


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the members' links."""
    found, left, stack = [], members, []
    while len(left):
        if not stack:
            stack, left = [left[0]], left[1:]
        node = stack.pop()
        near = np.bitwise_count((left ^ node).view(np.uint64)) <= radius  # of signed numbers it counts the absolute value
        if near.any():
            stack.extend(left[near])
            found.extend((int(node), int(x)) for x in left[near])
            left = left[~near]
    return found


def _each_bucket(batches: Iterator[pa.RecordBatch], keys: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by their first ``keys`` columns; the fingerprint follows."""
    rest = np.empty((0, keys + 1), np.int64)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
        if not len(rest):
            continue
        starts = np.flatnonzero(np.r_[True, (rest[1:, :keys] != rest[:-1, :keys]).any(axis=1)])
        ends = np.r_[starts[1:], len(rest)]
        if batch is not None:  # the last bucket may go on
            starts, ends = starts[:-1], ends[:-1]
        found = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s > 1:
                found += _forest(np.unique(rest[s:e, keys]), radius)
        rest = rest[ends[-1] if len(ends) else 0 :]
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_links(prints: DataFrame, radius: int = 3, most: int = 2048) -> DataFrame:
    """(a, b): links between the distinct ``fingerprint`` values at most ``radius`` (up to 3) bits apart.

    All links are found; of those inside one bucket a spanning forest comes out, which has the same components.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one cover at most three bits")
    nodes = written(prints.select("fingerprint").where("fingerprint is not null").distinct(), "fingerprints")
    halves = ["part", "value"]
    rows = _buckets(*_cut(nodes, [], "0", 32), halves, most)
    links = _linked(rows.where("not hot").select(*halves, "fingerprint"), radius)
    # the other half of what lies in a hot bucket, cut into quarters
    hot = rows.where("hot").select(F.col("part").alias("half"), F.col("value").alias("key"), "fingerprint").distinct()
    outer = ["half", "key"]
    finer = _buckets(*_cut(written(hot, "simhash-hot"), outer, "(1 - half) * 32", 16), [*outer, *halves], None)
    return links.unionByName(_linked(finer.select(*outer, *halves, "fingerprint"), radius))


def _buckets(tab: DataFrame, probes: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """Members of the buckets in which a table row meets another row; ``hot``: more than ``most`` of them.

    Spark takes 66 exploded probes for one row, and keys pack well: joins are shuffled whatever the estimates.
    """
    sizes = written(tab.groupBy(*keys).count(), "bucket-sizes")
    hits = written(probes.join(sizes.hint("merge"), keys), "bucket-hits")
    met = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("probed"))
    met = sizes.join(met.hint("merge"), keys, "left").select(*keys, (F.col("count") + F.coalesce("probed", F.lit(0))).alias("members"))
    met = written(met.where("members > 1"), "bucket-members")
    rows = tab.unionByName(hits.drop("count")).join(met.hint("merge"), keys)
    return rows.select(*keys, "fingerprint", (F.lit(False) if most is None else F.col("members") > most).alias("hot"))


def _linked(members: DataFrame, radius: int) -> DataFrame:
    keys = members.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each_bucket(batches, len(keys), radius)

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The id, ``fingerprint`` (bigint) and ``component_id`` (smallest id reachable over links) of every row.

    Rows without text have fingerprint zero and are linked like any other.  Repeated rows come out as often
    as they go in.  Ids that are null are never a component's id; a component without any id has null.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    roots = components(near_links(prints, radius), "a", "b").select(F.col("node").alias("fingerprint"), "root")
    least = prints.groupBy("fingerprint").agg(F.min(id_col).alias("__least"))
    least = written(least.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "__least"), "simhash-roots")
    component = least.groupBy("root").agg(F.min("__least").alias("component_id"))
    of = written(least.join(component, "root").select("fingerprint", "component_id"), "simhash-components")
    return prints.join(of, "fingerprint").select(id_col, "fingerprint", "component_id")


def shingle_hashes(text: str, shingle: int = 5) -> np.ndarray:
    """Distinct hashes, sorted, of the words' shingles, folded as in ``simhash``; a shorter text is one shingle."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def band_values(hashes: np.ndarray, factors: np.ndarray, depth: int) -> list[int]:
    """One number for the ``depth`` minima of each band; each factor orders the hashes anew."""
    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        mixed = hashes[at : at + 2048] * factors[:, None]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    out = np.zeros(len(factors) // depth, np.uint64)
    for row in least.reshape(-1, depth).T:
        out = (out ^ row) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def _alike(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the pairs whose sets have a Jaccard similarity of ``percent`` or more."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left, stack, found = np.ones(len(sets), bool), [], []
    while left.any():
        if not stack:
            stack.append(int(np.argmax(left)))
            left[stack[0]] = False
        node = stack.pop()
        mine = sets[node]
        at = np.minimum(np.searchsorted(mine, flat), max(len(mine) - 1, 0))
        common = np.bincount(owner[mine[at] == flat], minlength=len(sets)) if len(mine) else np.zeros(len(sets), int)
        near = np.flatnonzero(left & (common * 100 >= percent * (sizes + len(mine) - common))).tolist()
        stack.extend(near)
        left[near] = False
        found.extend((nodes[node], nodes[x]) for x in near)
        if len(near) * 2 > len(sets):  # what has been found need not be compared again
            rest = left[owner]
            flat, owner = flat[rest], owner[rest]
    return found


def similar_links(docs: DataFrame, key_col: str, text_col: str, shingle: int = 5, percent: int = 80, bands: int = 20, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(key, ``node``) of every row and (a, b): links between nodes whose word shingles have a Jaccard similarity of ``percent`` or more.

    Candidates share a SimHash component (three bits, by multi-index hashing) or one of ``bands`` bands of ``depth`` minima; a
    pair at 0.8 shares none of 20 bands with probability 3e-5.  The bands carry most of this stage: at 0.8 some 15 % of
    the bits of two fingerprints differ.  Texts stay in the scan: rows that meet another one give their shingle hashes there,
    once.  Every member of a bucket is compared with the smallest one in plain joins, which Spark can split; only buckets
    with a member unlike that one are compared whole, each in a task.  Links that hold come out, enough to join what is alike.
    """
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, bands * depth, np.uint64) * np.uint64(2) + np.uint64(1)

    def work():
        return lambda text: (simhash(text, shingle), band_values(shingle_hashes(text, shingle), factors, depth))

    sketch = per_text(docs, key_col, text_col, "fingerprint bigint, bands array<bigint>", work)
    node = F.xxhash64(f"{key_col}.id", f"{key_col}.h").alias("node")
    sketch = written(sketch.select(key_col, node, "fingerprint", "bands"), "near-sketches")
    roots = components(near_links(sketch), "a", "b").select(F.col("node").alias("fingerprint"), "root")
    prints = sketch.select("node", "fingerprint").distinct().join(roots, "fingerprint", "left")
    rows = sketch.select("node", F.posexplode("bands").alias("band", "value")).distinct().unionByName(
        prints.select("node", F.lit(-1).alias("band"), F.coalesce("root", "fingerprint").alias("value"))
    )
    rows = written(rows, "near-bands")
    # of buckets with the same members one is enough
    sizes = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"))
    sizes = written(sizes.where("n > 1").dropDuplicates(["n", "who"]), "near-buckets")
    members = written(rows.join(sizes.select("band", "value"), ["band", "value"]), "near-members")
    nodes = written(members.select("node").distinct(), "near-nodes")
    texts = docs.select(F.xxhash64(f"{key_col}.id", f"{key_col}.h").alias("node"), F.col(text_col).alias("text"))

    def hashes():
        return lambda text: (shingle_hashes(text, shingle).view(np.int64),)

    sets = per_text(texts.join(sent_whole(nodes, 2_000_000), "node", "left_semi"), "node", "text", "hashes array<bigint>", hashes)
    sets = written(sets.dropDuplicates(["node"]), "near-sets")
    leaders = written(members.groupBy("band", "value").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")), "near-leaders")
    followers = members.join(leaders, ["band", "value"]).where("node != leader")
    pairs = written(followers.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "hashes": "__a"}), "a").join(sets.withColumnsRenamed({"node": "b", "hashes": "__b"}), "b")
    common = F.size(F.array_intersect("__a", "__b"))
    alike = both.where(common * 100 >= percent * (F.size("__a") + F.size("__b") - common)).select("a", "b")
    alike = written(alike, "near-alike")
    # a bucket whose members are all like its leader is settled; else one that is not may be like another member
    apart = followers.where("n > 2").join(alike, (F.col("leader") == F.col("a")) & (F.col("node") == F.col("b")), "left_anti")
    rest = written(apart.select("band", "value").distinct(), "near-rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            found = _alike(nodes, sets, percent) if len(nodes) > 1 else []
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            column = batch.column(3)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if k != key:
                    yield from links()
                    key, nodes, sets = k, [], []
                nodes.append(batch.column(2)[i].as_py())
                sets.append(values[ends[i] : ends[i + 1]].copy())
            batch = column = values = ends = None
        yield from links()
        nodes, sets = [], []
        give_back()

    keyed = members.join(rest, ["band", "value"], "left_semi").join(sets, "node").select("band", "value", "node", "hashes")
    links = keyed.repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(run, "a bigint, b bigint")
    return sketch.select(key_col, "node"), alike.unionByName(links)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **near) -> DataFrame:
    """The rows that stay, whole: of each component of similar texts the one with the smallest id (rows without an id come last).

    Rows that repeat both id and text stay together; exact dedup comes first where there may be such rows.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(whole(text_col)).alias("h"))
    rows = docs.withColumn("__key", key)
    keys, links = similar_links(rows.select("__key", F.col(text_col).alias("text")), "__key", "text", **near)
    of = written(keys.join(components(links, "a", "b"), "node").select("__key", "root"), "near-classes")
    least = of.groupBy("root").agg(F.min("__key").alias("least"))
    gone = written(of.join(least, "root").where("__key != least").select(F.col("__key").alias("__gone")).distinct(), "near-gone")
    return rows.join(sent_whole(gone), F.col("__key").eqNullSafe(F.col("__gone")), "left_anti").select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
