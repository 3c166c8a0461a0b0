"""Quality classifier: ordinal cumulative-link regression on hashed text.

Graded ratings (0 reject, 1 poor, 2 good, ...) are modelled by one weight per hashed feature, shared
by all grades, and ordered thresholds: P(rating <= k) = sigmoid(threshold_k - weights * features).
A document's expected grade and the probability of the tail above a grade serve for selection.

The fit takes a bounded sample of labelled rows: TRAIN_ROWS at most, those with the smallest hash
of doc_id (so it never depends on partitioning), a documented parameter. Scoring covers all rows
and whole texts, one pass, no shuffle.

Features are presence and density of words, in lower case and stripped of surrounding signs, of
their beginnings, of word shapes (capitals, digits, signs), hashed to BUCKETS. Only features that differ between
grades in the sample get a weight.

Cases: null and empty texts have no features and get the grade that the thresholds alone give.
Labels without a document, and unlabelled documents, are not trained on. If a grade is missing in
the sample its threshold coincides with its neighbour's; with one grade or none, all documents get
that grade (grade of the top if none). Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .words import slices

BUCKETS = 1 << 18
TRAIN_ROWS = 24_000
#: Features with a weight at most, least documents of the sample that hold one, how many deviations
#: from chance the number of its holders of some grade has to be, ridge penalty.
SELECTED, LEAST_DOCS, DEVIATIONS, RIDGE = 2000, 5, 7.0, 0.02
#: Probability of the best grade that a document is kept with.
KEEP = 0.6
#: Lengths of the words' beginnings that are features too.
PREFIXES = (4, 5)
_STRIP = b".,;:!?()[]{}\"'*#&%$@|<>=+-_~^/\\`"


class Model(NamedTuple):
    """Weights of the selected features (dense over buckets, presence and density) and thresholds."""

    presence: np.ndarray
    density: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1


_SHAPES = (
    ("upper", re.compile(rb"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$")),
    ("signs", re.compile(rb"[^\w\s.,;:!?'\"()\x80-\xff-]{2,}$|[!?]{2,}")),
    ("digit", re.compile(rb"\d")),
    ("link", re.compile(rb"https?:|www\.|@")),
    ("bar", re.compile(rb"^[|>*#=_-]+$")),
    ("long", re.compile(rb"^.{25,}$")),
    ("single", re.compile(rb"^.$")),
)


class Buckets(dict):
    """Feature numbers of a word, remembered: its own and those of its shapes."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        plain = word.strip(_STRIP).lower() or word
        start = plain.decode("utf-8", "replace")
        names = [b"w " + plain, *(f"p {start[:n]}".encode() for n in PREFIXES if len(start) > n)] + [b"s " + s.encode() for s, r in _SHAPES if r.search(word)]
        self[word] = found = tuple(xxhash.xxh3_64_intdigest(n) % (BUCKETS - 1) for n in names)
        return found


_buckets = Buckets()
#: The bucket of words that repeat the one before.
_REPEAT = BUCKETS - 1


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and the share of its words in each."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    found = [b for w in words for b in _buckets[w]]
    found += [_REPEAT] * sum(a == b for a, b in zip(words, words[1:]))
    flat = np.array(found)
    which, n = np.unique(flat, return_counts=True)
    return which, n / len(words)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Ordinal:
    """Cumulative-link likelihood with ordered thresholds, fitted by accelerated gradient steps."""

    def __init__(self, grades: int):
        self.grades = grades

    def fit(self, doc: np.ndarray, column: np.ndarray, value: np.ndarray, rating: np.ndarray, size: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """Document, feature and density of each entry; returns weights and thresholds.

        The first `size` weights are those of presence, the others those of density.
        """
        share = np.clip(np.cumsum(np.bincount(rating, minlength=self.grades))[:-1] / len(rating), 1e-4, 1 - 1e-4)
        start = np.log(share / (1 - share))
        # Thresholds are a first one and positive gaps, so that they stay in order.
        theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
        weight = np.zeros(2 * size)
        moment = [np.zeros(2 * size), np.zeros(len(theta))]
        square = [np.zeros(2 * size), np.zeros(len(theta))]
        for step in range(1, steps + 1):
            cut = np.concatenate([[-np.inf], self._cuts(theta), [np.inf]])
            score = np.bincount(doc, weight[column] + value * weight[size + column], minlength=len(rating))
            above, below = _sigmoid(cut[rating + 1] - score), _sigmoid(cut[rating] - score)
            mass = np.maximum(above - below, 1e-9)
            up, down = above * (1 - above) / mass, below * (1 - below) / mass
            by_score = ((up - down) / len(rating))[doc]  # of the negative log likelihood
            d_cut = np.bincount(rating, -up, minlength=self.grades)[:-1] + np.bincount(rating, down, minlength=self.grades)[1:]
            tail = np.cumsum(d_cut[::-1])[::-1] / len(rating)
            by_weight = np.concatenate([np.bincount(column, by_score, minlength=size), np.bincount(column, value * by_score, minlength=size)])
            grads = [by_weight + RIDGE / len(rating) * weight, np.concatenate([tail[:1], tail[1:] * np.exp(theta[1:])])]
            rate = 0.1 * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, (g, target) in enumerate(zip(grads, (weight, theta))):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                target -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return weight, self._cuts(theta)

    @staticmethod
    def _cuts(theta: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def sample(docs: DataFrame, ratings: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and rating of the labelled documents with the smallest hash of doc_id."""
    chosen = ratings.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "rating").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # two numbers for each of `rows` rows at most


def _screened(table: DataFrame, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each grade, and the features whose holders are far from chance in some grade."""
    of_grade = [F.count_if(F.col("rating") == g).alias(f"g{g}") for g in range(grades)]
    docs = np.array(table.agg(*of_grade).first(), np.int64)
    # A row for each bucket at most, whatever the sample.
    counts = table.select("rating", F.explode("which").alias("bucket")).groupBy("bucket").agg(*of_grade).toArrow()
    bucket = np.asarray(counts["bucket"].combine_chunks(), np.int64) if len(counts) else np.empty(0, np.int64)
    own = np.stack([np.asarray(counts[f"g{g}"].combine_chunks(), np.float64) for g in range(grades)]) if len(counts) else np.empty((grades, 0))
    holders, total = own.sum(axis=0), docs.sum()
    apart = np.zeros(len(bucket))
    for g in np.flatnonzero(docs):
        share = docs[g] / total
        deviation = np.sqrt(np.maximum(holders * (1 - holders / total) * share * (1 - share), 1e-9))
        apart = np.maximum(apart, np.abs(own[g] - holders * share) / deviation)
    apart[(holders < LEAST_DOCS) | (holders == total)] = 0
    best = np.lexsort((bucket, -apart))[:SELECTED]
    return docs, bucket[best[apart[best] > DEVIATIONS]]


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample. docs: doc_id, text; ratings: doc_id, rating (0 ... grades - 1)."""
    valid = ratings.select(F.col("doc_id").cast("long"), F.col("rating").cast("int")).where(F.col("rating").between(0, grades - 1) & F.col("doc_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
            which, share = pa.array([w.astype(np.int32) for w, _ in found], pa.list_(pa.int32())), pa.array([d.astype(np.float32) for _, d in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), which, share], names=["doc_id", "rating", "which", "share"])

    table = sample(docs, valid, rows).select(F.col("doc_id").cast("long"), "text", "rating").mapInArrow(released(run), "doc_id bigint, rating int, which array<int>, share array<float>")
    table = written(table, "features")
    count, chosen = _screened(table, grades)
    if np.count_nonzero(count) < 2:
        grade = int(np.argmax(count)) if count.sum() else grades - 1
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), np.where(np.arange(grades - 1) < grade, -50.0, 50.0))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        for batch in batches:
            own, dense = [], []
            for which, share in zip(batch.column(2), batch.column(3)):
                at = number[np.asarray(which.values)]
                own.append(at[at >= 0])
                dense.append(np.asarray(share.values)[at >= 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float32()))], names=["doc_id", "rating", "own", "dense"])

    # What is left of the sample are its rows' selected features; in order of ids, so that reruns agree.
    kept = table.mapInArrow(held, "doc_id bigint, rating int, own array<int>, dense array<float>").toArrow().sort_by([("doc_id", "ascending"), ("rating", "ascending")])
    n = len(chosen)
    own, dense = kept["own"].combine_chunks(), kept["dense"].combine_chunks()
    doc = np.repeat(np.arange(len(kept)), np.diff(np.asarray(own.offsets)))
    column, value = np.asarray(own.flatten()).astype(np.int64), 10 * np.asarray(dense.flatten()).astype(np.float64)
    weight, cuts = Ordinal(grades).fit(doc, column, value, np.asarray(kept["rating"].combine_chunks()).astype(np.int64), n)
    presence, dense_weight = np.zeros(BUCKETS), np.zeros(BUCKETS)
    presence[chosen], dense_weight[chosen] = weight[:n], 10 * weight[n:]
    return Model(presence, dense_weight, cuts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected (grade), tails array<double>: P(rating >= k) for k = 1 ... grades - 1."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # of fixed size, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence, density, cuts = shared.value
        for batch in slices(batches, 1):
            linear = np.empty(len(batch))
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                which, share = features(text.as_py() or b"")
                linear[i] = presence[which].sum() + (density[which] * share).sum()
            tails = 1 - _sigmoid(cuts[None, :] - linear[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=["doc_id", "expected", "tails"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id bigint, expected double, tails array<double>")


def rating(quality: Column, toxic: Column) -> Column:
    """Graded rating of a review: 0 of low quality, 1 toxic, 2 neither; null if quality is unknown."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(quality == 1, 2)


def grade(docs: DataFrame, labels: DataFrame, keep: float = KEEP, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, expected, p_top (probability of the best grade), keep: whether p_top reaches a bound.

    rows are what is graded, if not docs, whose doc_id leads to the labels.

    The bound is never above the p_top of a text without features: one that has no evidence against
    it, such as an empty one, is kept.
    """
    model = fit(docs, labels.select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("rating")))
    bound = min(keep, float(1 - _sigmoid(model.thresholds[-1])) - 1e-9)
    p_top = F.col("tails")[1]
    return score(docs if rows is None else rows, model).select("doc_id", "expected", p_top.alias("p_top"), (p_top >= bound).alias("keep"))
