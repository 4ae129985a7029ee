"""Vectorisation: vocabularies (H1-H5), counts (A8) and pair interactions (H6).

Long form is canonical: a bag becomes ``(id, role, family, feature, cnt)``,
zeros are implicit. A vocabulary is a small dimension table built from a rule
(tag list x positions / relations), lower-cased like a count vectoriser; the
semi join with it drops out-of-vocabulary terms (for instance positions beyond
the vocabulary's +/-5). Dense vectors exist only at the ML boundary.
"""

from __future__ import annotations

import itertools
import re

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit import schema as S

_WORD2 = re.compile(r"^\w\w+$")
_WORD_TAG = re.compile(r"^\w+$")


def tag_list(kind: str) -> list[str]:
    kind = kind.upper()
    if kind == "UPOS":
        return list(S.UPOS_TAGS)
    if kind == "XPOS":
        return list(dict.fromkeys(t.replace("$", "") for t in S.XPOS_TAGS))
    if kind == "DEPENDENCY":
        return list(S.DEPRELS)
    raise ValueError(kind)


def vocabulary(family: str, kind: str = "UPOS", window: int = S.DEFAULT_WINDOW) -> list[str]:
    """Sorted lower-case terms of a family: normal, ngram, position, dependency."""
    tags = [t for t in tag_list(kind) if _WORD_TAG.match(t)]
    padded = tags + [S.BOS, S.EOS]
    if family == "normal":
        terms = [t for t in padded if _WORD2.match(t)]
    elif family == "ngram":
        terms = ["_".join(p) for p in itertools.product(padded, repeat=S.DEFAULT_NGRAM)]
    elif family == "position":
        terms = [f"{t}_{k}" for t, k in itertools.product(padded, range(-window, window + 1))]
    elif family == "dependency":
        terms = [f"{t}_{r}" for t, r in itertools.product(tags + [S.NONE_TAG], S.DEPENDENCY_RELATIONS)]
    else:
        raise ValueError(family)
    return sorted({t.lower() for t in terms})


def vocabulary_table(spark: SparkSession, family: str, kind: str = "UPOS",
                     window: int = S.DEFAULT_WINDOW) -> DataFrame:
    """``(feature, fi)`` -- fi is the 0-based vector index (sorted order)."""
    terms = vocabulary(family, kind, window)
    return spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "feature string, fi int")


def count_features(bag: DataFrame, family: str, kind: str = "UPOS",
                   window: int = S.DEFAULT_WINDOW) -> DataFrame:
    """``(id, role, family, feature, cnt)`` from a bag ``(id, role, feature)``."""
    vocab = vocabulary_table(bag.sparkSession, family, kind, window).select("feature")
    terms = bag.select("id", "role", F.lower("feature").alias("feature"))
    return (terms.join(F.broadcast(vocab), "feature", "left_semi")      # fixed-size dimension
            .groupBy("id", "role", "feature").agg(F.count(F.lit(1)).alias("cnt"))
            .select("id", "role", F.lit(family).alias("family"), "feature", "cnt"))


def pair_interactions(counts: DataFrame) -> DataFrame:
    """H6: per (id, cand in A/B, family, feature): ``diff = P - C`` and ``prod = P * C``."""
    p = counts.where("role = 'P'").select("id", "family", "feature", F.col("cnt").alias("p_cnt"))
    c = counts.where("role <> 'P'").select("id", F.col("role").alias("cand"), "family", "feature",
                                           F.col("cnt").alias("c_cnt"))
    p2 = p.select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("cand"))
    j = p2.join(c, ["id", "cand", "family", "feature"], "full_outer")
    pc = F.coalesce("p_cnt", F.lit(0))
    cc = F.coalesce("c_cnt", F.lit(0))
    return j.select("id", "cand", "family", "feature", (pc - cc).cast("long").alias("diff"),
                    (pc * cc).cast("long").alias("prod"))


def bag_vectors(bag: DataFrame, family: str, kind: str = "UPOS",
                window: int = S.DEFAULT_WINDOW) -> DataFrame:
    """ML boundary: ``(id, role, vec)`` sparse count vectors over the family's sorted vocabulary.

    The per-target term list is bounded by the window / tree size; the count
    vectoriser runs JVM-side with the fixed vocabulary (no fitting pass).
    """
    terms = bag.groupBy("id", "role").agg(F.collect_list(F.lower("feature")).alias("terms"))
    cv = CountVectorizerModel.from_vocabulary(vocabulary(family, kind, window), inputCol="terms",
                                              outputCol="vec")
    return cv.transform(terms).select("id", "role", "vec")
