"""Quality classifier by co-training on two views of a document: its text, and its metadata.

Each view has a logistic model of its own.  In every round both score all documents; the rows one view is
sure of become pseudo-labels for the other.  At the end each view is calibrated on labelled rows that no
model was fitted on, and the calibrated log-odds are added (less the prior, which both contain).

Labelled rows are a bounded sample, taken in the order of a hash of the id (``max_fit`` rows).  Everything else covers
all documents: feature vectors, scores, and the pseudo-labels, all of which enter the Newton steps as sums over tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import per_text, table
from schedlake.session import written

BUCKETS = 64
END = frozenset(".!?…")
_CLASS = np.zeros(256, np.int64)  # of a UTF-8 byte: other, upper, lower, digit, space, line break, sentence mark, symbol
for _i, _set in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:!?'\"()-", "#$%&*+/<=>@[\\]^_`{|}~"], 1):
    _CLASS[list(_set.encode())] = _i


def text_features(text: str) -> list[float]:
    """Shares and means that don't depend on the language; all zero but the first for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * 18
    raw = text.encode()
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=8) / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    often = max(counts.values())
    n = len(words)
    again = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    ends = sum(w[-1] in END for w in words)
    doubled = sum(not w[-2].isalnum() for w in words if len(w) > 1 and not w[-1].isalnum())
    capital = sum(w[0].isupper() for w in words)
    single = sum(not w.isalnum() for w in words if len(w) == 1)
    return [
        math.log1p(n), *kinds[1:].tolist(), float(lengths.mean()) / 10, float((lengths <= 3).mean()), float((lengths > 20).mean()),
        math.log(n / len(counts)) / 5, often / n, again / n, len(set(lines)) / len(lines), ends / n, doubled / n, capital / n + single / n,
    ]


N_TEXT = len(text_features("a"))


def features(
    docs: DataFrame, id_col: str, text_col: str, categories: list[str], numbers: list[str]
) -> DataFrame:
    """(id, text_x, meta_x, meta_b): text features, logarithms of the numbers, and a bucket for each category."""
    names = {id_col: "__id"} | {c: f"__m{i}" for i, c in enumerate([*categories, *numbers])}
    plain = docs.select(
        F.struct(*[F.col(c).alias(a) for c, a in names.items()]).alias("__row"), F.col(text_col).alias("__text")
    )
    with_text = per_text(plain, "__row", "__text", "text_x array<double>", lambda: lambda text: (text_features(text),))
    of = lambda c: F.col(f"__row.{names[c]}")
    logs = [F.coalesce(F.log1p(F.greatest(of(c).cast("double"), F.lit(0.0))), F.lit(0.0)) for c in numbers]
    places = [
        (F.pmod(F.xxhash64(F.lit(c), F.coalesce(of(c).cast("string"), F.lit(""))), F.lit(BUCKETS)) + i * BUCKETS).cast("int")
        for i, c in enumerate(categories)
    ]
    return with_text.select(
        of(id_col).alias("id"), "text_x", F.array(*logs).cast("array<double>").alias("meta_x"), F.array(*places).cast("array<int>").alias("meta_b")
    )


def _moments(x: np.ndarray) -> np.ndarray:
    """Number, sums and sums of squares of the rows."""
    return np.concatenate([[float(len(x))], x.sum(axis=0), (x * x).sum(axis=0)])


def _slopes(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the log-likelihood, flat."""
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p) + 1e-9)[:, None]).T @ z).reshape(-1)])


class Pseudo:
    """Pseudo-labelled rows in a written table (x, b, y): their sums are made in the tasks, however many rows there are."""

    def __init__(self, rows: DataFrame, n_buckets: int):
        self.rows, self.n_buckets = rows, n_buckets

    def sum(self, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | float:
        n_buckets = self.n_buckets

        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if not n_buckets:
                return x
            hot = np.zeros((batch.num_rows, n_buckets))
            places = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            hot[np.arange(batch.num_rows)[:, None], places] = 1
            return np.c_[x, hot]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [of(matrix(b), b.column(2).to_numpy(zero_copy_only=False).astype(float)) for b in batches if b.num_rows]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([sum(parts).tobytes()])], names=["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.frombuffer(v, float) for b in batches for v in b.column(0).to_pylist()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([sum(parts).tobytes()])], names=["sums"])

        # a row a task, then eight rows: what the driver adds up does not grow
        found = self.rows.mapInArrow(run, "sums binary").repartition(8).mapInArrow(add, "sums binary").collect()
        return sum((np.frombuffer(r.sums, float) for r in found), 0.0)


class Logistic:
    """Weights of a ridge logistic regression, fitted by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, more: Pseudo | None = None):
        moments = _moments(x) + (more.sum(lambda x, y: _moments(x)) if more else 0.0)
        mean, square = np.split(moments[1:] / moments[0], 2)
        scale = np.sqrt(np.maximum(square - mean * mean, 0))
        scale[scale < 1e-6 * (1 + np.abs(mean))] = 1.0  # constant but for rounding
        d = x.shape[1] + 1
        penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
        w = np.zeros(d)
        for _ in range(30):
            slopes = _slopes(x, y, mean, scale, w) + (more.sum(lambda x, y, w=w: _slopes(x, y, mean, scale, w)) if more else 0.0)
            step = np.linalg.solve(slopes[d:].reshape(d, d) + penalty, slopes[:d] - penalty @ w)
            step *= min(1.0, 8 / max(np.abs(step).max(), 1e-12))  # a flat region must not throw it far away
            w = w + step
            if np.abs(step).max() < (1e-3 if more else 1e-8):
                break
        self.weights = w[1:] / scale
        self.bias = float(w[0] - (self.weights * mean).sum())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights + self.bias, -30, 30)


class View:
    """A model and its calibration: slope and offset of the logit."""

    def __init__(self, model: Logistic, slope: float = 1.0, offset: float = 0.0):
        self.model, self.slope, self.offset = model, slope, offset

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> View:
        if len(set(y.tolist())) < 2:
            return self
        fit = Logistic(self.model.logit(x)[:, None], y)
        return View(self.model, float(fit.weights[0]), fit.bias)

    def column(self, values: str, buckets: str | None = None) -> Column:
        """The calibrated logit as an expression over the feature columns."""
        w = self.model.weights
        dense = len(w) if buckets is None else int(len(w) - self.n_buckets)
        # terms one by one: an array of weights would be walked by an interpreted lambda
        terms = [F.col(values)[i] * float(w[i]) for i in range(dense)]
        if buckets:
            weights = F.array(*[F.lit(float(v)) for v in w[dense:]])
            terms += [F.get(weights, F.col(buckets)[i]) for i in range(self.n_buckets // BUCKETS)]
        logit = F.lit(self.model.bias)
        for t in terms:
            logit = logit + t
        return F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0)) * self.slope + self.offset

    n_buckets = 0


def _dense(rows: list, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([r.text_x for r in rows], float).reshape(len(rows), N_TEXT)
    numbers = np.array([r.meta_x for r in rows], float).reshape(len(rows), -1)
    hot = np.zeros((len(rows), n_buckets))
    for i, r in enumerate(rows):
        hot[i, r.meta_b] = 1
    return text, np.c_[numbers, hot]


def _first_by_hash(rows: DataFrame, most: int, seed: int) -> list:
    """Up to ``most`` rows, the first in the order of a hash of the id.

    A limit alone would send that many rows of every partition to the driver, so rows far down the order go first.
    """
    order = F.xxhash64("id", F.lit(seed))
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(order < int(2**64 * 1.2 * most / n) - 2**63)
    return rows.orderBy(order, "id").limit(most).collect()


def co_train(
    vectors: DataFrame, labels: DataFrame, label_id: str, label: str, n_buckets: int,
    rounds: int = 2, sure: float = 0.98, max_fit: int = 20_000,
) -> tuple[View, View, float] | None:
    """Both calibrated views and the log-odds of the prior; None without labels of both classes.

    Labels are 0 or 1 (others and nulls are skipped); an id with both takes the more frequent one, 1 in a tie.
    """
    one = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    # labels grow with the corpus and pack well, so their file size says little about their size in memory: no broadcast
    shape = ["id", "text_x", "meta_x", "meta_b"]
    tagged = written(vectors.select(*shape).join(one.hint("merge"), "id", "left"), "quality-tagged")
    known = _first_by_hash(tagged.where("y IS NOT NULL"), max_fit, 0)
    y = np.array([r.y for r in known], float)
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(known)) % 4 == 3  # the order is that of a hash
    text, meta = _dense(known, n_buckets)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    unlabelled = tagged.where("y IS NULL")
    more: list[Pseudo | None] = [None, None]  # pseudo-labels for the text view, and for the metadata view
    for turn in range(rounds + 1):
        views = []
        for n, own in enumerate((text, meta)):
            view = View(Logistic(own[~held], y[~held], more=more[n])).calibrated(own[held], y[held])
            view.n_buckets = n_buckets if n else 0
            views.append(view)
        if turn == rounds:
            break
        edge = math.log(sure / (1 - sure))
        logits = [views[0].column("text_x"), views[1].column("meta_x", "meta_b")]
        for n, (x, b) in enumerate((("text_x", F.array().cast("array<int>")), ("meta_x", F.col("meta_b")))):
            scored = unlabelled.select(F.col(x).alias("x"), b.alias("b"), logits[1 - n].alias("logit"))
            confident = scored.where(F.abs("logit") >= edge).select("x", "b", (F.col("logit") > 0).cast("double").alias("y"))
            more[n] = Pseudo(written(confident, "quality-pseudo"), n_buckets if n else 0)
    return views[0], views[1], prior


def _scores(vectors: DataFrame, found: tuple[View, View, float] | None) -> DataFrame:
    """(id, p_text, p_meta, p_quality, accepted)"""
    if found is None:
        none = F.lit(None).cast("double")
        return vectors.select("id", none.alias("p_text"), none.alias("p_meta"), none.alias("p_quality"), F.lit(True).alias("accepted"))
    text, meta, prior = found
    scored = vectors.select("id", text.column("text_x").alias("t"), meta.column("meta_x", "meta_b").alias("m"))
    share = lambda x: 1 / (1 + F.exp(-x))
    both = F.col("t") + F.col("m") - prior
    return scored.select(
        "id", share(F.col("t")).alias("p_text"), share(F.col("m")).alias("p_meta"), share(both).alias("p_quality"), (both >= 0).alias("accepted")
    )


CATEGORIES, NUMBERS = ("lang", "source"), ("n_chars",)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality",
    categories: tuple[str, ...] = CATEGORIES, numbers: tuple[str, ...] = NUMBERS, **fit,
) -> DataFrame:
    """One row per row: the id, ``p_text``, ``p_meta``, ``p_quality`` and ``accepted`` (``p_quality`` at least a half).

    Null texts are empty, null metadata are a value of their own.  Without labels of both classes the probabilities
    are null and every row is accepted.  Rows without an id are scored but never labelled.  Other columns are not read.
    """
    vectors = written(features(docs, id_col, text_col, list(categories), list(numbers)), "quality-features")
    found = co_train(vectors, labels, label_id, label, BUCKETS * len(categories), **fit)
    return _scores(vectors, found).withColumnRenamed("id", id_col)


def accepted_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality",
    categories: tuple[str, ...] = CATEGORIES, numbers: tuple[str, ...] = NUMBERS, **fit,
) -> DataFrame:
    """The rows that ``classify`` accepts, whole: each row is judged by itself and travels with its features, unshuffled."""
    rows = docs.withColumn("__whole", F.struct(*docs.columns))
    vectors = written(features(rows, "__whole", text_col, list(categories), list(numbers)), "quality-rows")
    named = vectors.withColumn("id", F.col("id")[id_col])
    found = co_train(named, labels, label_id, label, BUCKETS * len(categories), **fit)
    return _scores(vectors, found).where("accepted").select("id.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
