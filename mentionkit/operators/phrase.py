"""F4 -- lemma phrase search: every position where a phrase's lemma sequence occurs.

Long form: candidate starts come from an equi-join on ``(doc_id, lemma)`` with
the phrase's first lemma; the remaining k-1 lemmas are verified by k-1
equi-joins on ``(doc_id, wi = start + j)`` folded into one join of an exploded
offset column, then counted. No per-row scan of a passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit.operators.annotate import lemma_of_phrase


def phrase_lemmas(phrases: DataFrame, phrase_col: str = "phrase") -> DataFrame:
    """``(id, doc_id, lemmas)`` -- the built-in annotator's lemmas of the phrase's first sentence."""
    return phrases.select("id", "doc_id", lemma_of_phrase(F.col(phrase_col)).alias("lemmas"))


def phrase_hits(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``(id, start)`` for each occurrence of ``lemmas`` in the passage's words."""
    p = phrases.where(F.size("lemmas") > 0).select(
        "id", "doc_id", "lemmas", F.col("lemmas")[0].alias("lemma"), F.size("lemmas").alias("k"))
    starts = p.join(words.select("doc_id", "lemma", F.col("wi").alias("start")), ["doc_id", "lemma"])
    single = starts.where("k = 1").select("id", "start")
    rest = starts.where("k > 1").select(
        "id", "doc_id", "start", "k", "lemmas", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    rest = rest.select("id", "doc_id", "start", "k", (F.col("start") + F.col("j")).alias("wi"),
                       F.element_at("lemmas", F.col("j") + 1).alias("want"))
    ok = (rest.join(words.select("doc_id", "wi", "lemma"), ["doc_id", "wi"])
          .where(F.col("lemma") == F.col("want"))
          .groupBy("id", "start", "k").agg(F.count(F.lit(1)).alias("n"))
          .where(F.col("n") == F.col("k") - 1).select("id", "start"))
    return single.unionByName(ok)


def hit_summary(phrases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per phrase: number of hits and the first hit position (-1 when none)."""
    agg = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("start").alias("first_hit"))
    return phrases.select("id").join(agg, "id", "left").select(
        "id", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
        F.coalesce("first_hit", F.lit(-1)).cast("int").alias("first_hit"))
