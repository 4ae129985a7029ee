"""J8 -- align character offsets of pronoun / A / B to words (the ``targets`` table).

The word that "covers" an offset is the one whose span ``[lo, o+len)`` (its
preceding blanks plus itself) contains it. A range match inside a passage is
made an equi-join by bucketing positions (``off div B``): each word is listed
under the buckets its span touches, so the join key is ``(doc_id, bucket)``
and only a handful of words are compared per target, however long the passage.

Repair, as in the task: when the covered word's text differs from the target's
first token, the first of ``wi-2 .. wi+2`` (in that order) whose text equals it
is taken instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit.functions import columns as C

BUCKET = 64
ROLES = [("P", "pronoun", "pronoun_offset"), ("A", "a", "a_offset"), ("B", "b", "b_offset")]


def mention_targets(mentions: DataFrame) -> DataFrame:
    """``(id, doc_id, role, off, target, target_len)`` -- P, A, B stacked (P11 on each span)."""
    stacked = mentions.select(
        "id", "doc_id",
        F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(s).alias("span"),
                                     F.col(o).alias("off")) for r, s, o in ROLES])).alias("t"))
    return stacked.select(
        "id", "doc_id", "t.role", F.col("t.off").cast("int").alias("off"),
        C.first_token("t.span").alias("target"), C.token_count("t.span").alias("target_len"))


def align_targets(targets: DataFrame, words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Add ``wi`` (NULL when the offset lies after the last word)."""
    cov = words.select(
        "doc_id", "wi", "word", "lo", (F.col("o") + F.length("word")).alias("hi"))
    cov = cov.select("*", F.explode(F.sequence(F.floor(F.col("lo") / bucket),
                                               F.floor((F.col("hi") - 1) / bucket))).alias("bk"))
    cov = cov.select("doc_id", "bk", "lo", "hi", F.col("wi").alias("base_wi"),
                     F.col("word").alias("base_word"))
    t = targets.withColumn("bk", F.floor(F.col("off") / bucket))
    base = (t.join(cov, (t.doc_id == cov.doc_id) & (t.bk == cov.bk)
                   & (cov.lo <= t.off) & (t.off < cov.hi), "left")
            .select(t["*"], "base_wi", "base_word").drop("bk"))

    # repair only the rows whose covered word differs from the target text
    bad = base.where(F.col("base_word") != F.col("target"))
    near = bad.select("id", "role", "doc_id", "target", "base_wi",
                      F.explode(F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)])).alias("k"))
    near = near.withColumn("wi", F.col("base_wi") + F.col("k"))
    w = words.select("doc_id", "wi", F.col("word").alias("near_word"))
    fixes = (near.join(w, ["doc_id", "wi"])
             .where(F.col("near_word") == F.col("target"))
             .groupBy("id", "role").agg(F.min("k").alias("fix_k")))
    out = base.join(fixes, ["id", "role"], "left")
    return out.select(
        "id", "doc_id", "role", "off", "target", "target_len",
        (F.col("base_wi") + F.coalesce(F.col("fix_k"), F.lit(0))).cast("int").alias("wi"))


def targets_of(mentions: DataFrame, words: DataFrame) -> DataFrame:
    return align_targets(mention_targets(mentions), words)


def words_for(words: DataFrame, targets: DataFrame) -> DataFrame:
    """Words of the passages that hold a target (semi join on the words' own partitioning)."""
    return words.join(targets.select("doc_id").distinct(), "doc_id", "left_semi")
