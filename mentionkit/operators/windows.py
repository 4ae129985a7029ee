"""Sequence windows over word order: W1-W3 (tag windows), W6, W7 (text spans).

A window of +/-N words around a target is not a sort-based window: each target
explodes its 2N+1 relative positions and equi-joins ``words`` on
``(doc_id, wi)``; misses before the passage are BOS, after it EOS. The right
side starts after the target's last word, and (as a slice of an N-padded list)
positions beyond ``n_words + N - 1`` are absent rather than padded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.functions import columns as C
from mentionkit.operators.annotate import doc_sizes, sentence_bounds


def _tagged(words: DataFrame, kind: str) -> DataFrame:
    return words.select("doc_id", F.col("wi").alias("pos"), C.tag_of(kind).alias("wtag"), F.lit(True).alias("found"))


def _padded_tag() -> Column:
    """The tag at ``pos``, BOS / EOS outside the passage; a word of the passage that ``words`` lacks is an error."""
    missing = F.raise_error(F.concat(
        F.lit("the window reaches word "), F.col("pos").cast("string"),
        F.lit(" of a passage, which the given words lack: build the context with a larger radius")))
    return (F.when(F.col("pos").isNull(), F.lit(None).cast("string"))      # a target without a word
            .when(F.col("pos") < 0, S.BOS).when(F.col("pos") >= F.col("n_words"), S.EOS)
            .when(F.col("found"), F.col("wtag")).otherwise(missing))


def _with_sizes(targets: DataFrame, words: DataFrame) -> DataFrame:
    """Targets with ``n_words`` (carried by staged targets, else counted from ``words``)."""
    if "n_words" in targets.columns:
        return targets
    return targets.join(doc_sizes(words), "doc_id")


def tag_window(targets: DataFrame, words: DataFrame, n: int = S.DEFAULT_WINDOW, kind: str = "UPOS",
               use_target_len: bool = True) -> DataFrame:
    """``(id, role, k, tag)`` for k in -N..N."""
    t = _with_sizes(targets, words).select(
        "id", "role", "doc_id", "wi", "n_words",
        (F.col("target_len") if use_target_len else F.lit(1)).alias("tl"),
        F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("k"))
    t = t.withColumn("pos", F.when(F.col("k") <= 0, F.col("wi") + F.col("k"))
                     .otherwise(F.col("wi") + F.col("tl") - 1 + F.col("k")))
    t = t.where((F.col("k") <= 0) | (F.col("pos") < F.col("n_words") + n))
    j = t.join(_tagged(words, kind), ["doc_id", "pos"], "left")
    tag = _padded_tag()
    return j.select("id", "role", "k", tag.alias("tag"))


def positional_window(targets: DataFrame, words: DataFrame, n: int = S.DEFAULT_WINDOW,
                      kind: str = "UPOS", use_target_len: bool = True) -> DataFrame:
    """``(id, role, k, feature)`` with feature = tag + '_' + k; places without a tag have none."""
    w = tag_window(targets, words, n, kind, use_target_len).where(F.col("tag").isNotNull())
    return w.select("id", "role", "k", F.concat_ws("_", "tag", F.col("k").cast("string")).alias("feature"))


def tag_ngrams(targets: DataFrame, words: DataFrame, window: int = S.DEFAULT_NGRAM_WINDOW,
               n: int = S.DEFAULT_NGRAM, kind: str = "UPOS") -> DataFrame:
    """``(id, role, s, gram)``: the n tags starting at wi+s, s in -window..window, joined by '_'."""
    t = _with_sizes(targets, words).select(
        "id", "role", "doc_id", "wi", "n_words",
        F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("s"))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    t = t.withColumn("pos", F.col("wi") + F.col("s") + F.col("j"))
    j = t.join(_tagged(words, kind), ["doc_id", "pos"], "left")
    tag = _padded_tag()
    g = j.groupBy("id", "role", "s").agg(
        F.array_sort(F.collect_list(F.struct(F.col("j"), tag.alias("tag")))).alias("parts"))
    return g.select("id", "role", "s", F.array_join(F.transform("parts", lambda x: x["tag"]), "_").alias("gram"))


# ------------------------------------------------------------ text spans ---
def passage_words(passages: DataFrame) -> DataFrame:
    """Per passage, the array of its words in order (row-local, no grouping)."""
    toks = F.regexp_extract_all(F.col("text"), F.lit(S.TOKEN_PATTERN), 0)
    return passages.select("doc_id", F.filter(toks, lambda t: ~t.rlike(S.BLANK_START)).alias("warr"))


def _target_passages(passages: DataFrame, targets: DataFrame) -> DataFrame:
    """Only passages that hold a target are re-tokenised for text spans."""
    return passages.join(targets.select("doc_id").distinct(), "doc_id", "left_semi")


def _pivot_targets(targets: DataFrame, words: DataFrame) -> DataFrame:
    tw = targets.join(words.select("doc_id", "wi", "sent", "idx", "governor"), ["doc_id", "wi"])
    return tw.groupBy("id", "doc_id").agg(
        *[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r.lower()}_{c}")
          for r in ("P", "A", "B") for c in ("wi", "sent", "idx", "governor")])


def scope_text(targets: DataFrame, words: DataFrame, passages: DataFrame,
               from_scope_start: bool = True) -> DataFrame:
    """Words from the first sentence holding a target through the last one, detokenised."""
    piv = _pivot_targets(targets, words)
    lo_s = F.least("p_sent", "a_sent", "b_sent")
    hi_s = F.greatest("p_sent", "a_sent", "b_sent")
    b = sentence_bounds(words)
    first = b.select("doc_id", F.col("sent").alias("lo_sent"), F.col("s_first").alias("start"))
    last = b.select("doc_id", F.col("sent").alias("hi_sent"), F.col("s_last").alias("end"))
    x = (piv.select("id", "doc_id", lo_s.alias("lo_sent"), hi_s.alias("hi_sent"))
         .join(first, ["doc_id", "lo_sent"]).join(last, ["doc_id", "hi_sent"]))
    if not from_scope_start:
        x = x.withColumn("start", F.lit(0))
    x = x.join(passage_words(_target_passages(passages, targets)), "doc_id")
    return x.select("id", C.detokenize(F.slice("warr", F.col("start") + 1,
                                               F.col("end") - F.col("start") + 1)).alias("scope"))


def text_before_pronoun(targets: DataFrame, words: DataFrame, passages: DataFrame) -> DataFrame:
    """From the pronoun's governor (if it precedes the pronoun) or its sentence start, up to it."""
    piv = _pivot_targets(targets, words)
    sent_start = F.col("p_wi") - F.col("p_idx") + 1
    gov_wi = F.col("p_wi") + F.col("p_governor") - F.col("p_idx")
    start = F.when((F.col("p_governor") != 0) & (gov_wi < F.col("p_wi")), gov_wi).otherwise(sent_start)
    x = piv.select("id", "doc_id", "p_wi", start.alias("start")).join(
        passage_words(_target_passages(passages, targets)), "doc_id")
    return x.select("id", C.detokenize(F.slice("warr", F.col("start") + 1,
                                               F.col("p_wi") - F.col("start"))).alias("before"))
