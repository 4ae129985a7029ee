"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are character n-grams inside words (A-Z lower-cased, with a mark at both word ends), hashed
into ``BUCKETS``. A document's value for a feature is the number of its distinct words that have it.
From the labelled training rows come, per feature, the log ratio of its smoothed shares in the two
classes; a logistic regression is fitted on values times ratios. Score: the logistic of the sum.

Scale. The fit reads a bounded sample (``ROWS_PER_CLASS`` of each class); feature counts of the
sample are summed in Spark and reach the driver as at most ``BUCKETS`` rows. Every feature of
``LEAST_DOCS`` documents is kept; the sampled documents' features stay in a table. The regression is
fitted on it by quasi-Newton steps until the gradient is at most ``TOLERANCE``; a step is one pass of
tasks, of which each returns one gradient over the kept features, and shuffles nothing. Scoring is one pass
over the texts without a shuffle; the broadcast model is one float per bucket. A task keeps the scores
of words it has met, at most ``WORD_CACHE``, and lays out the n-grams of ``SLICE`` characters at a time,
so one word of any length takes bounded memory beside its own text.

Defined results: a null or empty text has no features and scores the intercept. Without labelled rows
of both classes every score is the share of ones (0 where there is no label). Repeated rows each give
a row. An empty table gives no rows. Only ``text`` is an input of a score.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import CHUNK_ROWS, materialise, python_rows, release, text_bytes
from mentionkit.llm.labelled import ROWS_PER_CLASS, labelled_sample, prior_shift, share_of_ones
from mentionkit.operators.fitting import minimise, summed_gradient

NGRAMS = (2, 3, 4, 5, 6)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Features in fewer sampled documents are left out.
LEAST_DOCS = 5
SMOOTHING = 1.0
RIDGE = 1e-2
#: The fit ends when no part of the gradient (of the mean loss) is larger.
TOLERANCE = 1e-5
WORD_CACHE = 200_000
#: Characters whose n-grams are laid out at a time.
SLICE = 100_000
#: Tasks of a step of the fit, at most: each returns a gradient over the kept features.
STEP_TASKS = 8
#: Steps of the fit after which the driver's garbage is collected, so that it does not grow to its limit.
STEPS_HELD = 4
#: Features in a stored row of the fit, about.
BLOCK_ENTRIES = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def distinct_words(text: bytes | None) -> set[bytes]:
    return set(text.lower().split()) if text else set()


def word_groups(words: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The words in groups of at most about ``SLICE`` bytes; a longer word is a group by itself."""
    held: list[bytes] = []
    size = 0
    for w in words:
        if held and size + len(w) + 2 > SLICE:
            yield held
            held, size = [], 0
        held.append(w)
        size += len(w) + 2
    if held:
        yield held


def word_ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of every word; of a giant word each bucket once.

    A word beyond ``SLICE`` comes alone (see ``word_groups``); it is gone through in slices, and what
    is kept of it is a mark a bucket.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    joined = b" " + b"  ".join(words) + b" "  # a blank at both ends of every word
    points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(words) == 1 and len(points) > SLICE:
        met = np.zeros(BUCKETS, bool)
        for at in range(0, len(points), SLICE):
            part = points[at:at + SLICE + max(NGRAMS) - 1]
            own = min(SLICE, len(points) - at)
            for _, buckets in _hashed(part, np.arange(len(part), 0, -1)[:own]):
                met[buckets] = True
        buckets = np.flatnonzero(met)
        return np.zeros(len(buckets), np.int64), buckets
    ends = np.flatnonzero(points == 32)[1::2] + 1
    begins = np.r_[0, ends[:-1]]
    word = np.repeat(np.arange(len(ends)), ends - begins)
    found = [(word[at], buckets) for at, buckets in _hashed(points, np.repeat(ends, ends - begins) - np.arange(len(points)))]
    return np.concatenate([w for w, _ in found]), np.concatenate([b for _, b in found])


def _hashed(points: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and buckets of the n-grams that begin at the first ``len(left)`` points; ``left``: points up to the word's end."""
    points = points.astype(np.uint64)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, min(max(NGRAMS), len(points)) + 1):
        h[:len(points) - n + 1] = (h[:len(points) - n + 1] * np.uint64(0x100000001B3)) ^ points[n - 1:]
        if n in NGRAMS:
            at = np.flatnonzero(left >= n)
            mixed = (h[at] ^ np.uint64(n)) * _MIX
            yield at, (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting (numpy's own way for integers is a slower hash table)."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and in how many of its distinct words each is."""
    parts = []
    for words in word_groups(distinct_words(text)):
        row, bucket = word_ngrams(words)
        pairs = distinct(bucket * len(words) + row) // len(words)  # a word counts once
        parts.append(np.unique(pairs, return_counts=True))
    if len(parts) < 2:
        return parts[0] if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
    total = np.zeros(BUCKETS, np.int64)
    for bucket, n in parts:
        total[bucket] += n
    at = np.flatnonzero(total)
    return at, total[at]


def as_steps(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending feature numbers and counts as (gap, count) entries of a byte each.

    The first entry stands at number 0 with no count; a gap of more than a byte passes over entries
    without count, and a count of more than a byte is several entries of the same number.
    """
    more = (counts - 1) // 255
    ends = np.cumsum(more + 1) - 1
    split = np.full(len(counts) + int(more.sum()), 255)
    split[ends] = counts - 255 * more
    gaps = np.diff(np.repeat(numbers, more + 1), prepend=0)
    far = gaps // 255
    at = np.cumsum(far + 1)
    out = np.full(1 + len(gaps) + int(far.sum()), 255, np.uint8), np.zeros(1 + len(gaps) + int(far.sum()), np.uint8)
    out[0][0] = 0
    out[0][at], out[1][at] = gaps % 255, split
    return out


# -------------------------------------------------------------------- fit ---
def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic",
        per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept, learnt from ``labels`` rows that ``training`` allows."""
    sample, sizes = labelled_sample(docs, labels, label, training, per_class)
    taken = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not (taken.get(0) and taken.get(1)):
        p = min(max(share_of_ones(sizes), 1e-9), 1 - 1e-9)
        return np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p)))
    texts = sample.select("y", text_bytes().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BUCKETS), np.int64)  # words with a feature by class, documents
        for y, text in python_rows(batches):
            bucket, n = document_features(text)
            total[y, bucket] += n
            total[2, bucket] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)],
                                         names=["bucket", "n0", "n1", "docs"])

    counts = texts.mapInArrow(count, "bucket long, n0 long, n1 long, docs long").groupBy("bucket").agg(
        *(F.sum(c).alias(c) for c in ("n0", "n1", "docs"))).filter(F.col("docs") >= LEAST_DOCS).toArrow().sort_by("bucket")
    kept = counts.column("bucket").to_numpy()
    p, q = (counts.column(c).to_numpy() + SMOOTHING for c in ("n1", "n0"))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    fitted = minimise(_loss(texts, kept, ratio, sum(taken.values())), np.zeros(len(kept) + 1), TOLERANCE)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = fitted[:-1] * ratio
    return weights, float(fitted[-1]) + prior_shift(sizes, taken)


def _loss(texts: DataFrame, kept: np.ndarray, ratio: np.ndarray, size: int):
    """The ridge-penalised mean logistic loss over ``texts(y, text)`` and its gradient, as a function of the weights.

    The documents' kept features are written once, numbered by their place in ``kept``, several
    documents a row: labels, entries of each document, gaps between feature numbers, and counts, as raw
    numbers (see ``as_steps``); scaled by the ratios, weights times counts are weights times values.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((kept, ratio))  # once: what a step's function holds is sent with each step
    names = ["y", "lengths", "gaps", "counts"]
    kinds = [np.float32, np.int32, np.uint8, np.uint8]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS, -1, np.int64)
        kept, _ = shared.value
        number[kept] = np.arange(len(kept))

        def row(held: list[tuple]) -> pa.RecordBatch:
            y, gaps, counts = zip(*held)
            raw = y, [len(g) for g in gaps], np.concatenate(gaps), np.concatenate(counts)
            return pa.RecordBatch.from_arrays([pa.array([np.asarray(r, k).tobytes()], pa.binary()) for r, k in zip(raw, kinds)], names=names)

        held: list[tuple] = []
        for y, text in python_rows(batches):
            b, n = document_features(text)
            used = number[b] >= 0
            held.append((y, *as_steps(number[b[used]], n[used])))
            if sum(len(g) for _, g, _ in held) >= BLOCK_ENTRIES:
                yield row(held)
                held = []
        if held:
            yield row(held)

    stored = materialise(texts.mapInArrow(gather, ", ".join(f"{n} binary" for n in names)), "toxicity-rows")

    def local(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = 0.0, np.zeros(len(w))
        _, ratio = shared.value
        scaled = w[:-1] * ratio
        for raw in python_rows(batches, 4):
            y, lengths, gaps, counts = (np.frombuffer(r, k) for r, k in zip(raw, kinds))
            begins = np.cumsum(lengths) - lengths
            column = np.cumsum(gaps, dtype=np.int32)
            column -= np.repeat(column[begins], lengths)
            z = w[-1] + np.add.reduceat(scaled[column] * counts, begins)
            loss += float((np.logaddexp(0, z) - y * z).sum())
            error = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
            gradient[:-1] += np.bincount(column, np.repeat(error, lengths) * counts, minlength=len(scaled))
            gradient[-1] += error.sum()
        gradient[:-1] *= ratio
        return loss, gradient

    summed, steps = summed_gradient(stored, local, STEP_TASKS), itertools.count(1)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = summed(w)
        if next(steps) % STEPS_HELD == 0:
            release(spark)
        gradient /= size
        gradient[:-1] += RIDGE * w[:-1]
        return loss / size + RIDGE / 2 * float(w[:-1] @ w[:-1]), gradient

    return objective


# ------------------------------------------------------------------ score ---
class Scorer:
    """Scores texts with a model; remembers the words it has met."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.of_word: dict[bytes, float] = {}

    def __call__(self, texts: list[bytes | None]) -> list[float]:
        words = [distinct_words(t) for t in texts]
        self._learn(list(set().union(*words).difference(self.of_word)))
        # fsum: the sum does not depend on the order of a set
        z = np.array([self.intercept + math.fsum(map(self.of_word.__getitem__, own)) for own in words])
        if len(self.of_word) > WORD_CACHE:
            self.of_word.clear()
        return (1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist()

    def _learn(self, new: list[bytes]) -> None:
        for words in word_groups(new):
            row, bucket = word_ngrams(words)
            pairs = distinct(row * BUCKETS + bucket)  # a feature counts once in a word
            sums = np.bincount(pairs >> BUCKET_BITS, self.weights[pairs & (BUCKETS - 1)], minlength=len(words))
            self.of_word.update(zip(words, sums.tolist()))


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text`` in column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            scores: list[float] = []
            for at in range(0, len(texts), CHUNK_ROWS):
                scores += scorer(texts.slice(at, CHUNK_ROWS).to_pylist())
            yield pa.array(scores, pa.float64())

    return docs.withColumn(name, F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR_ITER)(text_bytes()))
