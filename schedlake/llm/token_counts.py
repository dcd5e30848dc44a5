"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

The tokenizer cuts a text into pre-tokens by a pattern and merges inside each alone, so a document's count
is the sum over its pre-tokens.  The leaves of a document's tree are runs of ``leaf`` pre-tokens (characters
and tokens of each), inner nodes hold sums; the tree lies in two arrays, children of node i at 2 i and 2 i + 1.

Edits re-read only the leaves they touch and what the pattern can see around them.  Matching starts again
at the leaf that holds the second character before an edit (no alternative looks further ahead than two
characters behind its match) and goes on to the first old leaf border behind the edit on which a new
pre-token ends; from there on both texts are the same.  The pre-tokens read go into the same leaves, so
the tree keeps its shape and only the sums above these leaves change.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import arrow, arrow_types, per_text, table, whole

EDITS = "array<struct<start:int,end:int,text:string>>"
LOOKAHEAD = 2  # characters behind its end that decide a pre-token: two for a contraction not completed, or for white space


class Counter:
    """Pre-tokens and their token counts; keeps the counts of short pre-tokens, up to ``table_size`` of them."""

    def __init__(self, ranks_file: str, pattern: str, table_size: int = 300_000):
        import base64

        import regex
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the tokenizer's \s is the property White_Space; Python's takes four control characters more
        self.pattern = regex.compile(pattern.replace(r"^\s", r"^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, int] = {}
        self.table_size = table_size

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.encoding.encode_ordinary(word))
            if len(word) <= 64:
                if len(self.known) >= self.table_size:
                    self.known.clear()
                self.known[word] = n
        return n

    def leaves(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of ``n`` even runs of the pre-tokens."""
        at = np.arange(n + 1) * len(words) // n
        sums = (np.r_[0, np.cumsum(np.fromiter(map(f, words), np.int64, len(words)))] for f in (len, self.count))
        return tuple(np.diff(x[at]) for x in sums)


class Tree:
    """Characters and tokens of the leaves below each node."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of(cls, text: str, counter: Counter, leaf: int) -> Tree:
        words = counter.pattern.findall(text)
        n = max(1, -(-len(words) // leaf))
        width = 1 << (n - 1).bit_length()
        heaps = []
        for sums in counter.leaves(words, n):
            heap = np.zeros(2 * width, np.int64)
            heap[width : width + n] = sums
            heaps.append(heap)
        tree = cls(*heaps)
        tree.sum_above(0, width - 1)
        return tree

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    def sum_above(self, first: int, last: int) -> None:
        low, high = (first + self.width) // 2, (last + self.width) // 2
        while low:
            for heap in (self.chars, self.tokens):
                heap[low : high + 1] = heap[2 * low : 2 * high + 2].reshape(-1, 2).sum(axis=1)
            low, high = low // 2, high // 2

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character, and where that leaf starts; for positions behind the text, the last character's."""
        node, start = 1, 0
        position = max(0, min(position, int(self.chars[1]) - 1))
        while node < self.width:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def put(self, first: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        at = slice(self.width + first, self.width + first + len(chars))
        self.chars[at], self.tokens[at] = chars, tokens
        self.sum_above(first, first + len(chars) - 1)


def apply_edits(text: str, tree: Tree, counter: Counter, edits: list[tuple[int, int, str]]) -> int:
    """Updates the tree of ``text`` for sorted (start, end, new text); returns how many characters were read again."""
    if any(not 0 <= s <= e <= len(text) for s, e, _ in edits) or any(a[1] > b[0] for a, b in zip(edits, edits[1:], strict=False)):
        raise ValueError("edits are not sorted spans of their text")
    read, i, changes = 0, 0, []
    while i < len(edits):
        start = edits[i][0]
        first, begin = tree.find(start - LOOKAHEAD)
        pieces, at, last, border, step = [], begin, first, begin + int(tree.chars[tree.width + first]), 0
        while True:
            while i < len(edits) and (edits[i][0] - LOOKAHEAD < border or border == len(text)):
                pieces += [text[at : edits[i][0]], edits[i][2]]
                at = edits[i][1]
                i += 1
                if at >= border:
                    last, border = tree.find(at)
                    border += int(tree.chars[tree.width + last])
            body = "".join([*pieces, text[at:border]])
            ends, words = 0, []
            for m in counter.pattern.finditer(body + text[border : border + LOOKAHEAD]):
                if m.end() > len(body):
                    break
                words.append(m[0])
                ends = m.end()
            read += len(body)
            if ends == len(body) or border == len(text):
                break
            step = 2 * step or 1  # farther each time, so that little is read twice
            for _ in range(step):
                if border < len(text):
                    last += 1
                    border += int(tree.chars[tree.width + last])
        changes.append((first, *counter.leaves(words, last - first + 1)))
    for change in changes:  # positions above are those of the old text
        tree.put(*change)
    return read


TREE = "tree_chars array<int>, tree_tokens array<int>"


def build_trees(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 64) -> DataFrame:
    """Per row: the id, ``tree_chars``, ``tree_tokens`` and ``n_tokens``.  Null texts are empty."""

    def work():
        counter = Counter(ranks_file, pattern)

        def one(text: str):
            tree = Tree.of(text, counter, leaf)
            return tree.chars.tolist(), tree.tokens.tolist(), int(tree.tokens[1])

        return one

    return per_text(docs, id_col, text_col, f"{TREE}, n_tokens bigint", work)


def count_edits(
    docs: DataFrame, edits: str | Callable[[str], list[tuple[int, int, str]]], ranks_file: str, pattern: str,
    id_col: str = "doc_id", text_col: str = "text", trees: tuple[str, str] | None = None, leaf: int = 64,
) -> DataFrame:
    """Per row: the id, ``n_tokens`` before, ``n_edits``, ``n_tokens_after``, ``n_chars_read`` again, and the tree after.

    ``edits``: an array column of structs (start, end, text), or a rule that finds them in a text; code points of the
    text as it is given, ends exclusive, sorted and not overlapping (else an error).  A null array is no edit, a null
    replacement empty.  ``trees`` names the two columns of kept trees; without it, or where they are null, trees are
    built here.  Null texts are empty, repeated rows and rows without an id each give a row, other columns are not read.
    """
    fields = f"n_tokens bigint, n_edits int, n_tokens_after bigint, n_chars_read bigint, {TREE}"
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, {fields}"
    types = arrow_types(docs.sparkSession, schema)
    own = F.col(edits).cast(EDITS) if isinstance(edits, str) else F.lit(None).cast(EDITS)
    kept = [F.col(c) if c else F.lit(None).cast("array<int>") for c in (trees or (None, None))]
    source = docs.select(
        F.col(id_col).alias("id"), whole(text_col).alias("text"), own.alias("edits"), kept[0].alias("chars"), kept[1].alias("tokens")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = []
                for row_id, text, given, chars, tokens in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if chars is None:
                        tree = Tree.of(text, counter, leaf)
                    else:
                        tree = Tree(np.array(chars, np.int64), np.array(tokens, np.int64))
                    before = int(tree.tokens[1])
                    if isinstance(edits, str):
                        changes = [(x["start"], x["end"], x["text"] or "") for x in given or []]
                    else:
                        changes = edits(text)
                    read = apply_edits(text, tree, counter, changes)
                    found.append((row_id, before, len(changes), int(tree.tokens[1]), read, tree.chars.tolist(), tree.tokens.tolist()))
                if found:
                    yield arrow([list(c) for c in zip(*found, strict=True)], types)

    return source.mapInArrow(run, schema)


ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.-]*\w|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")


def mask_addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace mail and IPv4 addresses by a placeholder."""
    return [(m.start(), m.end(), "<mail>" if "@" in m[0] else "<ip>") for m in ADDRESS.finditer(text)]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_edits(
        table(spark, sf_dir, "documents"), mask_addresses, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return counted.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_read")
