"""Quality: histogram gradient-boosted trees over document statistics.

Statistics of a text (shares of letters, capitals, digits, symbols and line ends, word and line
lengths, repeated words, lines and word triples) are cut into at most ``BINS`` bins at the training
sample's quantiles. Trees of fixed depth are grown level by level from gradient histograms. The model
is three flat arrays (feature, threshold, leaf value) in heap order, walked for all trees and rows of
a batch at once in numpy.

Scale. The fit reads a bounded sample (``ROWS_PER_CLASS`` of each class), whose statistics, a few
numbers a row, reach the driver. Scoring is one pass over the texts without a shuffle; the broadcast
model has a fixed size. A task holds one text's words at a time.

Defined results: a null or empty text has all statistics 0 and is scored like any other. Without
labelled rows of both classes every score is the share of ones (0 where there is no label). Repeated
rows each give a row. An empty table gives no rows. Only ``text`` is an input of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import CHUNK_ROWS, python_rows, text_bytes
from mentionkit.llm.labelled import ROWS_PER_CLASS, labelled_sample, prior_shift, share_of_ones

BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
#: Added to a leaf's curvature; a split needs this much of it on both sides.
RIDGE = 1.0
LEAST_CURVATURE = 2.0

STATISTICS = [
    "chars", "words", "word_chars", "longest_word", "upper", "digit", "punctuation", "symbol", "exclaim", "pipe",
    "non_ascii", "blank", "lines", "line_words", "short_lines", "line_end", "same_lines", "distinct_words",
    "commonest_word", "repeated_triples", "alnum_words", "capital_words", "symbol_words", "single_chars"]

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PUNCTUATION = b".,;:?'\"()-"
_SYMBOL = b"#*$%&|<>{}[]=_~^\\@+/"
_BLANK = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOL_WORD = re.compile(rb"[#*$%&|<>{}=~^\\]")


def statistics(text: bytes | None) -> list[float]:
    """The numbers named in ``STATISTICS``."""
    if not text:
        return [0.0] * len(STATISTICS)
    size = len(text)
    count = lambda these: size - len(text.translate(None, these))
    chars = size - count(_CONTINUATION)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    rows = max(1, len(lines))
    own = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:]))
    upper = count(_UPPER)
    return [
        np.log1p(chars), np.log1p(len(words)), (chars - count(_BLANK)) / n, max(map(len, words), default=0),
        upper / max(1, upper + count(_LOWER)), count(_DIGIT) / chars, count(_PUNCTUATION) / chars, count(_SYMBOL) / chars,
        count(b"!") / n, count(b"|") / n, (size - len(text.translate(None, bytes(range(0xC0, 256))))) / chars,
        count(_BLANK) / chars, np.log1p(len(lines)), len(words) / rows, sum(len(x) < 20 for x in lines) / rows,
        sum(x.rstrip(_BLANK).endswith((b".", b"!", b"?", b'"')) for x in lines) / rows, 1 - len(set(lines)) / rows,
        len(own) / n, max(own.values(), default=0) / n, sum(c for c in triples.values() if c > 1) / n,
        sum(map(bytes.isalpha, words)) / n, sum(map(bytes.istitle, words)) / n,
        sum(_SYMBOL_WORD.search(w) is not None for w in words) / n, sum(len(w) == 1 for w in words) / n]


# ------------------------------------------------------------------ trees ---
@dataclass
class Trees:
    """Trees in heap order: node i has children 2i + 1 and 2i + 2; a value above the threshold goes right."""

    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf):
            return np.full(len(x), self.start)
        trees = np.arange(len(self.leaf))
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -700, 700)))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the ascending cuts; a value's bin is the number of cuts below it."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for the logistic loss."""
    n, width = x.shape
    edges = bin_edges(x)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    offset = np.arange(width) * BINS
    inner = 2 ** depth - 1
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                  np.zeros((trees, inner + 1)), float(np.log(p / (1 - p))))
    margin = np.full(n, model.start)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, here = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * (width * BINS) + offset + binned).ravel()
            shape = (here, width, BINS)
            left_g = np.bincount(cell, np.repeat(g, width), minlength=here * width * BINS).reshape(shape).cumsum(axis=2)
            left_h = np.bincount(cell, np.repeat(h, width), minlength=here * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = (left_g ** 2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE)
                    - all_g ** 2 / (all_h + RIDGE))
            gain[(left_h < LEAST_CURVATURE) | (all_h - left_h < LEAST_CURVATURE)] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            for i in range(here):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, f, b] > 1e-9 and b < len(edges[f]):
                    model.feature[t, first + i], model.threshold[t, first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        model.leaf[t] = -rate * np.bincount(leaf, g, minlength=inner + 1) / (
            np.bincount(leaf, h, minlength=inner + 1) + RIDGE)
        margin += model.leaf[t][leaf]
    return model


# -------------------------------------------------------------- fit, score ---
def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality",
        per_class: int = ROWS_PER_CLASS) -> Trees:
    """Trees learnt from ``labels`` rows that ``training`` (over ``doc_id``) allows."""
    sample, sizes = labelled_sample(docs, labels, label, training, per_class)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, y, statistics(t)) for i, y, t in python_rows([batch])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (
                pa.int64(), pa.int32(), pa.list_(pa.float64())))], names=["doc_id", "y", "x"])

    got = sample.select(F.xxhash64("doc_id").alias("doc_id"), "y", text_bytes().alias("text")).mapInArrow(
        measure, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    y = got.y.to_numpy(float)
    if len(set(y)) < 2:
        p = min(max(share_of_ones(sizes), 1e-9), 1 - 1e-9)
        none = np.empty((0, 1))
        return Trees(none, none, none, float(np.log(p / (1 - p))))
    model = grow(np.array(got.x.tolist()), y)
    model.start += prior_shift(sizes, {k: int((y == k).sum()) for k in (0, 1)})
    return model


def with_score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text`` in column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.feature, model.threshold, model.leaf, model.start))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = Trees(*shared.value)
        for texts in batches:
            scores: list[float] = []
            for at in range(0, len(texts), CHUNK_ROWS):
                x = np.array([statistics(t) for t in texts.slice(at, CHUNK_ROWS).to_pylist()])
                scores += trees.score(x).tolist()
            yield pa.array(scores, pa.float64())

    return docs.withColumn(name, F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR_ITER)(text_bytes()))
