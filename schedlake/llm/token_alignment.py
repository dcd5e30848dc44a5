"""Alignment of two tokenizers: which tokens of one cover the bytes that tokens of the other cover.

Texts are cut at single spaces between other characters, where tokens of both always end (checked on the vocabulary
of the second one), and every distinct piece of a chunk of documents is encoded once.  Inside a piece the tokenizers' own
spans give most ends: character offsets of the first, piece spans of the second.  Tokens that end inside a
character, and byte-fallback tokens, have no span of their own; their ends come from decoded bytes.

Ends that both share cut the tokens into groups, and tokens of one group are linked.  How many documents hold a pair of ids
linked is counted corpus-wide; every document then sums the counts of its links.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schedlake.llm.common import arrow, arrow_types, table, whole
from schedlake.session import written

MARKER = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")
BESIDE = re.compile(r"\s | \s|^ | $")
LARGE = 4096  # pairs of tokens in a group from which on distinct ids are paired instead
AT_ONCE, TOGETHER = 20_000, 256  # pieces encoded in one call, and in one text of it
CHUNK = "docs array<struct<id:{kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, pieces binary, lengths binary, a binary, b binary, a_groups binary, b_groups binary, tokens binary"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Flat:
    """Tokens and groups of many pieces, one after the other: ids and groups of either side, and tokens and groups by piece."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_groups: np.ndarray, b_groups: np.ndarray, tokens: np.ndarray):
        self.a, self.b, self.a_groups, self.b_groups, self.tokens = a, b, a_groups, b_groups, tokens  # tokens: (pieces, 3), a, b, groups

    @staticmethod
    def join(parts: list[Flat]) -> Flat:
        groups = np.cumsum([0, *(int(p.tokens[:, 2].sum()) for p in parts)])
        return Flat(
            *(np.concatenate([np.empty(0, np.int64), *(getattr(p, side) for p in parts)]) for side in ("a", "b")),
            *(np.concatenate([np.empty(0, np.int64), *(getattr(p, side) + g for p, g in zip(parts, groups))]) for side in ("a_groups", "b_groups")),
            np.concatenate([np.empty((0, 3), np.int64), *(p.tokens for p in parts)]),
        )

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, pair of ids as one number, how often) of all linked token pairs, by piece; in large groups distinct ids are paired."""
        n = int(self.tokens[:, 2].sum())
        in_a, in_b = np.bincount(self.a_groups, minlength=n), np.bincount(self.b_groups, minlength=n)
        from_b = np.cumsum(in_b) - in_b
        piece_of = np.repeat(np.arange(len(self.tokens)), self.tokens[:, 2])
        large = in_a * in_b > LARGE
        some = np.flatnonzero(~large[self.a_groups])
        group = self.a_groups[some]
        times = in_b[group]
        at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(from_b[group], times)
        out = [(np.repeat(piece_of[group], times), (np.repeat(self.a[some], times) << 32) | self.b[at], np.ones(len(at), np.int64))]
        from_a = np.cumsum(in_a) - in_a
        for g in np.flatnonzero(large).tolist():
            a, n_a = np.unique(self.a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            out.append((np.full(len(a) * len(b), piece_of[g]), ((a[:, None] << 32) | b).reshape(-1), np.outer(n_a, n_b).reshape(-1)))
        piece, pair, times = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(out) > 1:
            order = np.argsort(piece, kind="stable")
            piece, pair, times = piece[order], pair[order], times[order]
        return piece, pair, times

    def n_links(self) -> np.ndarray:
        """Links of every piece."""
        n = int(self.tokens[:, 2].sum())
        each = np.bincount(self.a_groups, minlength=n) * np.bincount(self.b_groups, minlength=n)
        return _sums(each, self.tokens[:, 2])


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of the given lengths."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.cut = CUT if not any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces) else None  # else texts stay whole
        letters = _byte_letters()
        words = {i: w for w, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(letters[c] for c in words[i]) if set(words.get(i, " ")) <= letters.keys() else words.get(i, "").encode() for i in range(max(words) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        self.chars = self.b.encode("é", return_type="proto").pieces[-1].end == 1  # spans of the second count characters

    def split(self, text: str) -> list[str]:
        """The pieces of a text; where white space stands beside a space, that space does not cut."""
        if self.cut is None:
            return [text]
        return self.cut.split(text) if BESIDE.search(text) else text.split(" ")

    def tokens(self, pieces: list[str]) -> tuple[Flat, np.ndarray]:
        """Tokens and groups of the pieces whose tokens' bytes are those of a space and the piece, none of the others; which pieces those are."""
        gc.disable()  # many small objects, none in cycles
        try:
            if self.cut is not None:
                found = self._aligned(self._runs(pieces), pieces)
                if found is not None:
                    return found, np.ones(len(pieces), bool)
            each = [self._aligned([p], [p]) for p in pieces]
        finally:
            gc.enable()
        none = Flat(*(np.empty(0, np.int64) for _ in range(4)), np.zeros((1, 3), np.int64))
        return Flat.join([none if x is None else x for x in each]), np.array([x is not None for x in each], bool)

    @staticmethod
    def _runs(pieces: list[str]) -> list[str]:
        """Pieces joined by single spaces, some hundred to a text: both tokenizers cut there.  Pieces with white space at an end stay alone."""
        runs, run = [], []
        for piece in pieces:
            if piece[:1].isspace() or piece[-1:].isspace() or len(run) == TOGETHER:
                if run:
                    runs.append(" ".join(run))
                    run = []
                if piece[:1].isspace() or piece[-1:].isspace():
                    runs.append(piece)
                    continue
            run.append(piece)
        if run:
            runs.append(" ".join(run))
        return runs

    def _aligned(self, texts: list[str], pieces: list[str]) -> Flat | None:
        """Tokens and groups of the pieces, which one after the other make up the texts; None if a token's bytes differ or a piece has no end of its own."""
        encoded = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        protos = self.b.encode(texts, return_type="proto", num_threads=1)
        ids_a, ids_b = [e.ids for e in encoded], self.b.encode(texts, num_threads=1)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        full = "".join([" " + t for t in texts])
        raw = full.encode()
        if not all(b"".join([side[i] for i in ids.tolist()]) == raw for side, ids in ((self.a_bytes, flat_a), (self.b_bytes, flat_b))):
            return None
        # bytes of every character, and where the texts begin, in characters
        point = np.frombuffer(full.encode("utf-32-le"), np.uint32)
        byte_at = np.concatenate([[0], np.cumsum(1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))])
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        # first: a token that ends where the next one of its text has not begun ends at a character
        offsets = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(e.offsets for e in encoded)), np.int64).reshape(-1, 2)
        last = np.zeros(len(flat_a), bool)
        last[np.cumsum(n_a)[n_a > 0] - 1] = True
        sure = last | (np.r_[offsets[1:, 0], 0] >= offsets[:, 1])
        ends_a = np.where(sure, byte_at[np.repeat(begin[:-1], n_a) + offsets[:, 1]], np.cumsum(self.sizes[0][flat_a]))
        # second: an empty span says that the bytes of a character, or the leading space, go on
        stop = np.fromiter((p.end for x in protos for p in x.pieces), np.int64)
        first = np.cumsum(n_b)[n_b > 0] - n_b[n_b > 0]
        before = np.r_[0, stop[:-1]]
        before[first] = 0
        start = np.repeat(begin[:-1], n_b)
        coarse = byte_at[start + 1 + np.where(self.chars, stop, 0)] + np.where(self.chars, 0, stop)
        ends_b = np.where(stop > before, coarse, np.cumsum(self.sizes[1][flat_b]))
        at = np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))
        cuts = ends_a[ends_b[at] == ends_a] if len(ends_b) else ends_a[:0]
        ends = np.cumsum([len(p) + 1 for p in pieces])
        ends = byte_at[ends]
        after = np.searchsorted(cuts, ends, "right")
        if not len(cuts) or (cuts[np.maximum(after - 1, 0)] != ends).any():
            return None
        counts = [np.bincount(np.searchsorted(ends, x), minlength=len(pieces)) for x in (ends_a, ends_b)]
        return Flat(flat_a, flat_b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), np.stack([*counts, np.diff(after, prepend=0)], axis=1))

    def words_of(self, flat: Flat) -> list[str]:
        """Groups of every piece as text, each group closed by a semicolon."""
        g, n = int(flat.tokens[:, 2].sum()), len(flat.a) + len(flat.b)
        in_a, in_b = np.bincount(flat.a_groups, minlength=g), np.bincount(flat.b_groups, minlength=g)
        ids, mark = np.empty(n, np.int64), np.zeros(n, np.int64)
        place_a = np.arange(len(flat.a)) + (np.cumsum(in_b) - in_b)[flat.a_groups]
        place_b = np.arange(len(flat.b)) + np.cumsum(in_a)[flat.b_groups]
        ids[place_a], ids[place_b] = flat.a, flat.b
        ends = np.cumsum(in_a + in_b)
        mark[ends - in_b - 1], mark[ends - 1] = 1, 2
        signs = ",|;"
        parts = [f"{i}{signs[m]}" for i, m in zip(ids.tolist(), mark.tolist(), strict=True)]
        stops = np.cumsum(flat.tokens[:, 0] + flat.tokens[:, 1]).tolist()
        return ["".join(parts[s:e]) for s, e in zip([0, *stops], stops)]


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.int32).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32).astype(np.int64)


def aligned_chunks(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 23) -> DataFrame:
    """A written table with a row for each run of documents of some ``chunk_chars`` characters: their counts and digests, and the distinct pieces."""
    spark = docs.sparkSession
    schema = CHUNK.format(kind=dict(docs.dtypes)[id_col])
    types = arrow_types(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Aligner(a_file, b_file)

        def close(ids: list, rows: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
            parts, words, ok = [], [], []
            for at in range(0, len(texts), AT_ONCE):
                part, good = both.tokens(texts[at : at + AT_ONCE])
                parts.append(part)
                words += both.words_of(part)
                ok += good.tolist()
            alone: dict[int, int] = {}  # documents with a piece that is not all there are encoded whole
            if not all(ok):
                bad = ~np.array(ok)
                for k, row in enumerate(rows):
                    if bad[row].any():
                        alone[k] = len(words)
                        part, _ = both.tokens([" ".join(texts[i] for i in row.tolist())])
                        parts.append(part)
                        words += both.words_of(part)
                        rows[k] = np.array([alone[k]], np.int32)
            flat = Flat.join(parts)
            figures = np.concatenate([flat.tokens, flat.n_links()[:, None]], axis=1) if len(words) else np.empty((0, 4), np.int64)
            lengths = np.array([len(r) for r in rows], np.int64)
            used = np.concatenate([np.empty(0, np.int32), *rows])
            sums = np.stack([_sums(figures[used, c], lengths) for c in range(4)], axis=1).tolist()
            out = []
            for id_, row, figure in zip(ids, rows, sums, strict=True):
                line = "".join([words[i] for i in row.tolist()])[:-1]
                out.append((id_, *figure, hashlib.sha256(line.encode()).hexdigest() if line else ""))
            docs = [dict(zip(("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), d, strict=True)) for d in out]
            return arrow([[docs], [_pack(used)], [_pack(lengths)], *([_pack(x)] for x in (flat.a, flat.b, np.diff(flat.a_groups, prepend=0), np.diff(flat.b_groups, prepend=0), flat.tokens.T.reshape(-1)))], types)

        ids, rows, known, held = [], [], {}, 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(id_)
                rows.append(np.array([known.setdefault(p, len(known)) for p in (both.cut.split(text) if both.cut else [text])] if text else [], np.int32))
                held += len(text) + 64
                if held >= chunk_chars:
                    yield close(ids, rows, list(known))
                    ids, rows, known, held = [], [], {}, 0
        if ids:
            yield close(ids, rows, list(known))

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(run, schema)
    return written(rows.withColumn("chunk", F.monotonically_increasing_id()), "aligned-chunks")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, Flat]:
    """Pieces of the documents, how many each has, and the pieces' tokens."""
    a, b, a_steps, b_steps, tokens = (_unpack(row[c]) for c in ("a", "b", "a_groups", "b_groups", "tokens"))
    return _unpack(row["pieces"]), _unpack(row["lengths"]), Flat(a, b, np.cumsum(a_steps), np.cumsum(b_steps), tokens.reshape(3, -1).T)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``starts``."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair of ids is linked, and whether no other pair of its first id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                used, lengths, flat = _read(row)
                piece, pair, _ = flat.links()
                pairs, own = np.unique(pair, return_inverse=True)
                counts = np.bincount(piece, minlength=len(flat.tokens))
                starts = np.cumsum(counts) - counts
                seen, stamp = np.zeros(len(pairs), np.int64), np.empty(len(pairs), np.int64)
                ends = np.cumsum(lengths).tolist()
                for s, e in zip([0, *ends], ends):
                    some = used[s:e]
                    held = own[_spread(starts[some], counts[some])]
                    stamp[held] = at = np.arange(len(held))
                    seen[held[stamp[held] == at]] += 1  # of equal ones the last
                for at in range(0, len(pairs), 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 20)]), pa.array(seen[at : at + (1 << 20)])], names=["pair", "n"])

    columns = ("pieces", "lengths", "a", "b", "a_groups", "b_groups", "tokens")
    sums = written(chunks.select(*columns).mapInArrow(run, "pair long, n long").where("n > 0").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", 32)))  # an id meets at most the other vocabulary
    return written(sums.select("pair", "n", (F.col("n") == most).alias("best")), "pair-best")


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", slice_pairs: int = 4_000_000, chunk_chars: int = 1 << 23) -> DataFrame:
    """Per row: the id, tokens of both sides, groups, links, links that are their first id's best, the sum of pair counts over links, and a digest.

    Texts that are null or empty, or whose tokens' bytes on either side are not those of a space and the text (markers in it, say), have zeros and an
    empty digest and count for no pair.  Rows without an id and repeated rows each give a row and count each; other columns are not read.

    The counts go to the tasks in slices of some ``slice_pairs`` pairs (16 bytes each), each slice in a pass over the chunks; sums over slices add up.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    chunks = aligned_chunks(docs, a_file, b_file, id_col, text_col, chunk_chars)
    counts = pair_counts(chunks)
    slices = max(1, -(-counts.count() // slice_pairs))
    schema = f"chunk long, place int, {id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    types = arrow_types(spark, schema)
    fields = ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    found = None
    for s in range(slices):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == s).toArrow()
        keys = part["pair"].to_numpy()
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], part["n"].to_numpy()[order], part["best"].to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, n, best = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    used, lengths, flat = _read(row)
                    piece, pair, times = flat.links()
                    at = np.searchsorted(keys, pair)
                    at[at == len(keys)] = 0
                    here = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                    at, piece, times = at[here], piece[here], times[here]
                    per_piece = np.bincount(piece, minlength=len(flat.tokens))
                    sums = [_sums(_sums(x, per_piece)[used], lengths) for x in (times * best[at], times * n[at])]
                    docs = row["docs"]
                    for d in range(0, len(docs), 4096):
                        some = docs[d : d + 4096]
                        yield arrow([[row["chunk"]] * len(some), list(range(d, d + len(some))), *([x[f] for x in some] for f in fields), *(x[d : d + 4096].tolist() for x in sums)], types)

        one = chunks.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    if slices > 1:
        names = [c for c in found.columns if c not in ("n_best", "count_sum")]
        found = found.groupBy(*[F.col(c) for c in names]).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("chunk", "place")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
