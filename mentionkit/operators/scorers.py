"""Scorers R1-R8 and the scorer registry (G1).

Every scorer maps a DataFrame to ``(id, p_a, p_b, p_neither)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.functions import columns as C
from mentionkit.operators.plugins import worker_model
from mentionkit.operators.profile import gender_cohorts

PRED_COLUMNS = ["id", "p_a", "p_b", "p_neither"]


# R1 -------------------------------------------------------------------------
def constant_scores(mentions: DataFrame, p: float = S.UNIFORM_P) -> DataFrame:
    return mentions.select("id", F.lit(p).alias("p_a"), F.lit(p).alias("p_b"),
                           F.lit(p).alias("p_neither"))


# R2 -------------------------------------------------------------------------
def name_gender_scores(mentions: DataFrame, cohort_source: DataFrame,
                       she: list[str] = S.SCORER_SHE, he: list[str] = S.SCORER_HE,
                       lower: bool = False, keep: list | None = None) -> DataFrame:
    """A candidate seen as the true answer only with pronouns of this gender scores 1.0.

    The cohort is a dimension ``(name, gender)`` built from ``cohort_source`` (U1, U2);
    it grows with the distinct names, so the join is left to AQE's runtime size check.
    """
    cohort = gender_cohorts(cohort_source, she, he, lower)
    g = (F.when(C.pronoun_in(she, lower=lower), "F")
         .when(C.pronoun_in(he, lower=lower), "M"))
    extra = keep or []
    m = mentions.select("id", "a", "b", g.alias("g"), *extra)
    kept = [c for c in m.columns if c not in ("id", "a", "b", "g")]
    # a name has one gender at most, so it alone is the key; no aggregate, so that streams can be scored
    ca = cohort.select(F.col("name").alias("a"), F.col("gender").alias("a_gender"))
    cb = cohort.select(F.col("name").alias("b"), F.col("gender").alias("b_gender"))
    hit = lambda c: F.coalesce(F.col(c) == F.col("g"), F.lit(False)).alias(c[0] + "_hit")
    hits = m.join(ca, "a", "left").join(cb, "b", "left").select("id", *kept, hit("a_gender"), hit("b_gender"))
    any_hit = F.col("a_hit") | F.col("b_hit")
    u = F.lit(S.UNIFORM_P)
    return hits.select(
        "id", *kept,
        F.when(any_hit, F.col("a_hit").cast("double")).otherwise(u).alias("p_a"),
        F.when(any_hit, F.col("b_hit").cast("double")).otherwise(u).alias("p_b"),
        F.when(any_hit, F.lit(0.0)).otherwise(u).alias("p_neither"))


# R3 -------------------------------------------------------------------------
def syntax_points(targets: DataFrame, words: DataFrame, kind: str = "UPOS",
                  window: int = S.DEFAULT_WINDOW) -> DataFrame:
    """``(id, a_points, b_points)``: bag overlap (+/-window, target length 1), then
    +2 deprel match, +1 governor-deprel match, +2 governor-upos match -- A tested
    first, B only when A fails; governor matches need a non-empty value."""
    from mentionkit.operators.tree import bag_overlap, target_nodes
    from mentionkit.operators.windows import positional_window
    nd = target_nodes(targets, words).select(
        "id", "role", C.deprel_head("deprel").alias("dep"),
        F.coalesce(C.deprel_head("g_deprel"), F.lit("")).alias("gdep"),
        F.coalesce("g_upos", F.lit("")).alias("gupos"))
    piv = nd.groupBy("id").agg(*[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r.lower()}_{c}")
                                 for r in ("P", "A", "B") for c in ("dep", "gdep", "gupos")])
    ov = bag_overlap(positional_window(targets, words, window, kind, use_target_len=False))
    ovp = ov.groupBy("id").agg(
        F.max(F.when(F.col("cand") == "A", F.col("overlap"))).alias("ov_a"),
        F.max(F.when(F.col("cand") == "B", F.col("overlap"))).alias("ov_b"))
    # a mention none of whose targets has a word keeps its row, without points
    x = targets.select("id").distinct().join(piv, "id", "left").join(ovp, "id", "left")
    p, a, b = (lambda c: F.col("p_" + c)), (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))

    def either(cond_a, cond_b, pts):
        return (F.when(cond_a, F.lit(pts)).otherwise(0), F.when(~cond_a & cond_b, F.lit(pts)).otherwise(0))

    d_a, d_b = either(p("dep") == a("dep"), p("dep") == b("dep"), 2)
    g_a, g_b = either((p("gdep") == a("gdep")) & (p("gdep") != ""), (p("gdep") == b("gdep")) & (p("gdep") != ""), 1)
    u_a, u_b = either((p("gupos") == a("gupos")) & (p("gupos") != ""),
                      (p("gupos") == b("gupos")) & (p("gupos") != ""), 2)
    return x.select("id",
                    (F.coalesce("ov_a", F.lit(0)) + d_a + g_a + u_a).cast("long").alias("a_points"),
                    (F.coalesce("ov_b", F.lit(0)) + d_b + g_b + u_b).cast("long").alias("b_points"))


def points_to_scores(points: DataFrame, min_points: int = S.SYNTAX_MIN_POINTS) -> DataFrame:
    """R3 decision: both below the threshold -> undecided; else the winner takes 1; tie -> .5/.5."""
    a, b = F.col("a_points"), F.col("b_points")
    und, tie = S.UNDECIDED, S.TIE
    low = (a < min_points) & (b < min_points)

    def pick(i):
        return (F.when(low, F.lit(und[i])).when(a > b, F.lit([1.0, 0.0, 0.0][i]))
                .when(a < b, F.lit([0.0, 1.0, 0.0][i])).otherwise(F.lit(tie[i])))

    return points.select("id", pick(0).alias("p_a"), pick(1).alias("p_b"), pick(2).alias("p_neither"))


def syntax_scores(targets: DataFrame, words: DataFrame, kind: str = "UPOS") -> DataFrame:
    return points_to_scores(syntax_points(targets, words, kind))


# T2 / K6 ----------------------------------------------------------------------
def scope_name_counts(targets: DataFrame, words: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Built-in stand-in for the next-token model: name-shaped words of the scope
    sentences with their frequency as the logit, ``(id, token, logit)``.

    Names are pre-aggregated per (passage, sentence, token) and each mention's
    scope is expanded to its sentences, so the join key is (doc_id, sent) and
    many mentions on one passage still spread over many tasks. ``names``: a table of all names
    (``words`` then only needs to hold the targets); without it they come out of ``words``."""
    tw = targets.join(words.select("doc_id", "wi", "sent"), ["doc_id", "wi"])
    scope = tw.groupBy("id", "doc_id").agg(F.min("sent").alias("lo_sent"), F.max("sent").alias("hi_sent"))
    spans = scope.select("id", "doc_id", F.explode(F.sequence("lo_sent", "hi_sent")).alias("sent"))
    names = ((words if names is None else names).where(F.col("upos") == "PROPN")
             .groupBy("doc_id", "sent", F.col("word").alias("token")).agg(F.count(F.lit(1)).alias("c")))
    j = spans.join(names, ["doc_id", "sent"])
    return j.groupBy("id", "token").agg(F.sum("c").cast("double").alias("logit"))


def top_predictions(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Per mention the top-k ``(rank, token, prob)`` by logit, softmax over the k kept."""
    from pyspark.sql import Window
    w = Window.partitionBy("id").orderBy(F.desc("logit"), F.asc("token"))
    top = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    wid = Window.partitionBy("id")
    e = F.exp(F.col("logit") - F.max("logit").over(wid))
    top = top.withColumn("e", e)
    return top.select("id", F.col("rank").cast("int").alias("rank"), "token",
                      (F.col("e") / F.sum("e").over(wid)).alias("prob"))


#: Prompts that a plug-in model gets at a time.
PROMPTS = 64


def predict_with_plugin(prompts: DataFrame, factory, key: str = "lm") -> DataFrame:
    """K6: score ``(id, prompt)`` with a plug-in model loaded once per Python worker.

    ``factory()`` returns ``predict(list[str]) -> list[list[(token, logit)]]``;
    it is called for at most ``PROMPTS`` prompts at a time, whose candidates are handed on before the
    next call. Output ``(id, token, logit)`` holds every candidate the model gives, in any order; ranking
    and cutting is T2's.
    """
    import pandas as pd

    get = worker_model(factory, key)

    def run(batches):
        fn = get()
        for pdf in batches:
            for at in range(0, len(pdf), PROMPTS):
                part = pdf.iloc[at:at + PROMPTS]
                rows = [(i, t, float(l)) for i, cands in zip(part["id"], fn(list(part["prompt"]))) for t, l in cands]
                yield pd.DataFrame(rows, columns=["id", "token", "logit"])

    id_type = dict(prompts.dtypes)["id"]
    return prompts.select("id", "prompt").mapInPandas(run, f"id {id_type}, token string, logit double")


# R4 -------------------------------------------------------------------------
def prefix_rates(targets: DataFrame, words: DataFrame, predictions: DataFrame,
                 min_prob: float = S.MIN_PREDICTION_PROB) -> DataFrame:
    """``(id, ra, rb)``: for A and B the probability of the best-ranked predicted token that prefixes the
    candidate word, with prob >= min_prob (empty tokens never match); 0 where there is none."""
    tw = (targets.where(F.col("role") != "P")
          .join(words.select("doc_id", "wi", F.col("word").alias("cand_word")), ["doc_id", "wi"])
          .select("id", "role", "cand_word"))
    preds = predictions.where((F.col("prob") >= min_prob) & (F.length("token") > 0))
    m = tw.join(preds, "id").where(F.col("cand_word").startswith(F.col("token")))
    best = m.groupBy("id", "role").agg(F.min_by("prob", "rank").alias("rate"))
    rates = best.groupBy("id").agg(
        F.max(F.when(F.col("role") == "A", F.col("rate"))).alias("ra"),
        F.max(F.when(F.col("role") == "B", F.col("rate"))).alias("rb"))
    ids = targets.select("id").distinct()
    return ids.join(rates, "id", "left").select("id", F.coalesce("ra", F.lit(0.0)).alias("ra"),
                                                F.coalesce("rb", F.lit(0.0)).alias("rb"))


def prefix_features(targets: DataFrame, words: DataFrame, first: DataFrame, second: DataFrame,
                    min_prob: float = S.MIN_PREDICTION_PROB) -> DataFrame:
    """The four-feature variant: R4's rates under the predictions of two prompts, ``(id, a1, b1, a2, b2)``."""
    x = prefix_rates(targets, words, first, min_prob).toDF("id", "a1", "b1")
    return x.join(prefix_rates(targets, words, second, min_prob).toDF("id", "a2", "b2"), "id")


def prefix_scores(targets: DataFrame, words: DataFrame, predictions: DataFrame,
                  min_prob: float = S.MIN_PREDICTION_PROB) -> DataFrame:
    """The rates normalised; no match for both -> undecided."""
    x = prefix_rates(targets, words, predictions, min_prob)
    none = (F.col("ra") == 0) & (F.col("rb") == 0)
    tot = F.col("ra") + F.col("rb")
    und = S.UNDECIDED
    return x.select("id",
                    F.when(none, F.lit(und[0])).otherwise(F.col("ra") / tot).alias("p_a"),
                    F.when(none, F.lit(und[1])).otherwise(F.col("rb") / tot).alias("p_b"),
                    F.when(none, F.lit(und[2])).otherwise(F.lit(0.0)).alias("p_neither"))


# R5 -------------------------------------------------------------------------
def cascade(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """``first``, replaced by ``fallback`` where ``first``'s argmax is NEITHER."""
    f = fallback.select("id", *[F.col(c).alias("f_" + c) for c in ("p_a", "p_b", "p_neither")])
    j = first.join(f, "id", "left")
    use_f = C.argmax3() == 2
    return j.select("id", *[F.when(use_f, F.col("f_" + c)).otherwise(F.col(c)).alias(c)
                            for c in ("p_a", "p_b", "p_neither")])


# R6 -------------------------------------------------------------------------
def pair_rates(pair_probs: DataFrame) -> DataFrame:
    """``(id, cand, p)`` -> ``(pA, pB, (1-pA)(1-pB))`` renormalised."""
    piv = pair_probs.groupBy("id").agg(
        F.max(F.when(F.col("cand") == "A", F.col("p"))).alias("pa"),
        F.max(F.when(F.col("cand") == "B", F.col("p"))).alias("pb"))
    raw = piv.select("id", F.col("pa").alias("p_a"), F.col("pb").alias("p_b"),
                     ((1 - F.col("pa")) * (1 - F.col("pb"))).alias("p_neither"))
    return raw.select("id", *C.normalise3())


# R7 -------------------------------------------------------------------------
def softmax_pair(scores: DataFrame, a: str = "s_a", b: str = "s_b") -> DataFrame:
    """softmax([sA, sB, 0]): NEITHER is the zero logit."""
    sa, sb = F.col(a).cast("double"), F.col(b).cast("double")
    m = F.greatest(sa, sb, F.lit(0.0))
    ea, eb, en = F.exp(sa - m), F.exp(sb - m), F.exp(-m)
    tot = ea + eb + en
    return scores.select("id", (ea / tot).alias("p_a"), (eb / tot).alias("p_b"), (en / tot).alias("p_neither"))


# G1 -------------------------------------------------------------------------
def _name_gender(mentions: DataFrame) -> DataFrame:
    return name_gender_scores(mentions, mentions)


def context_scorer(kind: str, words: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A ``targets -> predictions`` scorer over a words table (syntax, prefix or cascade)."""
    def syntax(targets):
        return syntax_scores(targets, words)

    def prefix(targets):
        return prefix_scores(targets, words, top_predictions(scope_name_counts(targets, words)))

    def both(targets):
        return cascade(prefix(targets), syntax(targets))

    return {"syntax": syntax, "prefix": prefix, "cascade": both}[kind]


SCORERS: dict[str, Callable[..., DataFrame]] = {
    "constant": constant_scores,
    "name_gender": _name_gender,
}

#: Scorers by name over a corpus context (``corpus``, ``targets``, ``near_words``), rules and plug-ins alike.
CONTEXT_SCORERS: dict[str, Callable[..., DataFrame]] = {
    "syntax": lambda cx: context_scorer("syntax", cx.near_words)(cx.targets),
    "prefix": lambda cx: context_scorer("prefix", cx.corpus.words)(cx.targets),
    "cascade": lambda cx: context_scorer("cascade", cx.corpus.words)(cx.targets),
}


def register_scorer(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Plug-in scorer: ``fn(df) -> DataFrame[id, p_a, p_b, p_neither]`` used with ``df.transform``."""
    SCORERS[name] = fn


def register_context_scorer(name: str, fn: Callable[..., DataFrame]) -> None:
    """Plug-in scorer over a whole context: ``fn(cx) -> DataFrame[id, p_a, p_b, p_neither]``."""
    CONTEXT_SCORERS[name] = fn


def get_scorer(name: str) -> Callable[..., DataFrame]:
    return SCORERS[name]


def scorer_names() -> list[str]:
    return sorted({*SCORERS, *CONTEXT_SCORERS})


def score_context(cx, name: str) -> DataFrame:
    """Predictions of a context's mentions by any registered scorer."""
    if name in CONTEXT_SCORERS:
        return CONTEXT_SCORERS[name](cx)
    if name in SCORERS:
        return cx.corpus.mentions.transform(SCORERS[name])
    raise ValueError(f"no scorer {name!r}; there are {', '.join(scorer_names())}")
