"""Bounded samples of labelled texts, for the classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import materialise

#: Labelled rows of each class that a classifier is fitted on, at most.
ROWS_PER_CLASS = 10_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column,
                    per_class: int = ROWS_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, y, text)`` of at most ``2 * per_class`` labelled rows, and the rows of each class there are.

    ``training`` (over ``doc_id``) names the rows that may be learnt from. Of each class the rows with
    the smallest hash of their id are taken, so the sample is the same in every run. Rows without id or
    label, or with a label other than 0 and 1, are no labelled rows; an id with two labels counts as 1;
    of texts under one id the smallest is taken.
    """
    own = (labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
           .groupBy("doc_id").agg(F.max("y").alias("y")).filter(training))
    sizes = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(
        F.min("text").alias("text"))
    return materialise(texts, "labelled"), sizes


def prior_shift(sizes: dict[int, int], taken: dict[int, int]) -> float:
    """What to add to a log-odds learnt from ``taken`` rows of each class for ``sizes`` rows of each."""
    if not all(sizes.get(y) and taken.get(y) for y in (0, 1)):
        return 0.0
    return math.log(sizes[1] / sizes[0]) - math.log(taken[1] / taken[0])


def share_of_ones(sizes: dict[int, int]) -> float:
    """The score where only one class, or none, is known."""
    total = sum(sizes.values())
    return sizes.get(1, 0) / total if total else 0.0
