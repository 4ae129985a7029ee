"""Registered queries: Spark plans over the driver tables and their DuckDB twins.

Every query derives its inputs from the driver's tables (``documents``,
``embeddings``) with Spark, over the whole tables; nothing is sampled or capped
except where a top-k / first-n is the operator itself (T1, T2, T3).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.functions import columns as C
from mentionkit.operators import evaluate as E
from mentionkit.operators import profile as PR
from mentionkit.operators import scorers as R
from mentionkit.plans.fixture import load_corpus
from mentionkit.plans.oracle import _list, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

F_LIST = _list(S.ANCHORS_F)
M_LIST = _list(S.ANCHORS_M)


ROUND_DIGITS = 9


def register(name: str, sql: str | None = None, doubles: list[str] | None = None):
    """Register a Spark plan and its DuckDB twin.

    ``doubles`` names computed floating-point columns: both sides round them to
    ``ROUND_DIGITS`` places so summation order cannot change the value hash.
    """
    def deco(fn: Query) -> Query:
        if doubles:
            def wrapped(spark, sf_dir, _fn=fn):
                df = _fn(spark, sf_dir)
                return df.select(*[F.round(c, ROUND_DIGITS).alias(c) if c in doubles else F.col(c)
                                   for c in df.columns])
            wrapped.__doc__ = fn.__doc__
            QUERIES[name] = wrapped
        else:
            QUERIES[name] = fn
        if sql is not None:
            text = sql
            if doubles:
                repl = ", ".join(f"round({c}, {ROUND_DIGITS}) AS {c}" for c in doubles)
                text = f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"
            SQL[name] = text
        return fn
    return deco


def _mentions(spark, sf_dir):
    """Without the text."""
    return load_corpus(spark, sf_dir).spans


# ---------------------------------------------------------------- fixture ---
@register("fixture_mentions", with_ctes("""
SELECT id, pronoun, pronoun_offset, a, a_offset, a_coref, b, b_offset, b_coref,
  CAST(length(text) AS INTEGER) AS text_len FROM mentions"""))
def q_fixture_mentions(spark, sf_dir):
    return load_corpus(spark, sf_dir).mentions.select(
        "id", "pronoun", "pronoun_offset", "a", "a_offset", "a_coref", "b", "b_offset", "b_coref",
        F.length("text").cast("int").alias("text_len"))


@register("k5_words_per_sentence", with_ctes("""
SELECT doc_id, sent, CAST(count(*) AS BIGINT) AS n_words, CAST(min(o) AS INTEGER) AS first_o,
  CAST(sum(idx) AS BIGINT) AS sum_idx, CAST(sum(governor) AS BIGINT) AS sum_governor,
  CAST(count(*) FILTER (WHERE upos = 'PROPN') AS BIGINT) AS n_propn,
  CAST(count(*) FILTER (WHERE xpos = 'PRP$') AS BIGINT) AS n_possessive,
  CAST(count(*) FILTER (WHERE deprel = 'nmod:poss') AS BIGINT) AS n_poss_rel,
  CAST(sum(length(lemma)) AS BIGINT) AS lemma_chars, CAST(max(nb) AS INTEGER) AS max_nb,
  CAST(max(lo) AS INTEGER) AS max_lo
FROM words GROUP BY doc_id, sent"""))
def q_words_per_sentence(spark, sf_dir):
    w = load_corpus(spark, sf_dir).words
    return w.groupBy("doc_id", "sent").agg(
        F.count(F.lit(1)).alias("n_words"), F.min("o").alias("first_o"),
        F.sum("idx").cast("long").alias("sum_idx"), F.sum("governor").cast("long").alias("sum_governor"),
        F.sum((F.col("upos") == "PROPN").cast("long")).alias("n_propn"),
        F.sum((F.col("xpos") == "PRP$").cast("long")).alias("n_possessive"),
        F.sum((F.col("deprel") == "nmod:poss").cast("long")).alias("n_poss_rel"),
        F.sum(F.length("lemma")).cast("long").alias("lemma_chars"),
        F.max("nb").alias("max_nb"), F.max("lo").alias("max_lo"))


# ---------------------------------------------------------------- profile ---
_A1_SQL_AGGS = """
  count(*) AS mentions,
  CAST(count(*) FILTER (WHERE a_offset > pronoun_offset) AS BIGINT) AS a_after_pronoun,
  CAST(count(*) FILTER (WHERE b_offset > pronoun_offset) AS BIGINT) AS b_after_pronoun,
  CAST(count(*) FILTER (WHERE a_coref) AS BIGINT) AS a_true,
  CAST(count(*) FILTER (WHERE b_coref) AS BIGINT) AS b_true,
  CAST(count(*) FILTER (WHERE NOT (a_coref OR b_coref)) AS BIGINT) AS neither,
  CAST(count(*) FILTER (WHERE a_coref AND a_offset > pronoun_offset) AS BIGINT) AS a_true_after_pronoun,
  CAST(count(*) FILTER (WHERE b_coref AND b_offset > pronoun_offset) AS BIGINT) AS b_true_after_pronoun,
  CAST(count(*) FILTER (WHERE abs(pronoun_offset - a_offset) < abs(pronoun_offset - b_offset) AND a_coref) AS BIGINT) AS a_nearer_a_true,
  CAST(count(*) FILTER (WHERE abs(pronoun_offset - a_offset) < abs(pronoun_offset - b_offset) AND b_coref) AS BIGINT) AS a_nearer_b_true,
  CAST(count(*) FILTER (WHERE abs(pronoun_offset - a_offset) < abs(pronoun_offset - b_offset)) AS BIGINT) AS a_nearer"""


@register("a1_mention_profile", with_ctes(f"""
SELECT CASE WHEN lower(pronoun) IN ({F_LIST}) THEN 'F' ELSE 'M' END AS cohort, {_A1_SQL_AGGS}
FROM mentions GROUP BY 1"""))
def q_a1(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    cohort = F.when(C.pronoun_in(S.ANCHORS_F, lower=True), "F").otherwise("M").alias("cohort")
    return PR.mention_profile(m, [cohort])


@register("a2_distinct_values", with_ctes("""
SELECT DISTINCT 'pronoun' AS column_name, pronoun AS value FROM mentions
UNION ALL SELECT DISTINCT 'a', a FROM mentions
UNION ALL SELECT DISTINCT 'b', b FROM mentions"""))
def q_a2(spark, sf_dir):
    return PR.distinct_values(_mentions(spark, sf_dir))


_COHORT_SQL = [
    ("she_names", f"""SELECT a AS name FROM mentions WHERE lower(pronoun) IN ({F_LIST}) AND a_coref
UNION ALL SELECT b FROM mentions WHERE lower(pronoun) IN ({F_LIST}) AND b_coref"""),
    ("he_names", f"""SELECT a AS name FROM mentions WHERE lower(pronoun) IN ({M_LIST}) AND a_coref
UNION ALL SELECT b FROM mentions WHERE lower(pronoun) IN ({M_LIST}) AND b_coref"""),
    ("cohort", """SELECT name, 'F' AS gender FROM (SELECT name FROM she_names EXCEPT SELECT name FROM he_names)
UNION ALL SELECT name, 'M' AS gender FROM (SELECT name FROM he_names EXCEPT SELECT name FROM she_names)"""),
]


@register("u1_true_names_union", with_ctes("""
SELECT 'F' AS gender, name FROM she_names UNION ALL SELECT 'M', name FROM he_names""", _COHORT_SQL))
def q_u1(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return (PR.true_names(m, S.ANCHORS_F, lower=True).select(F.lit("F").alias("gender"), "name")
            .unionByName(PR.true_names(m, S.ANCHORS_M, lower=True).select(F.lit("M").alias("gender"), "name")))


@register("u2_gender_exclusive_names", with_ctes("SELECT name, gender FROM cohort", _COHORT_SQL))
def q_u2(spark, sf_dir):
    return PR.gender_cohorts(_mentions(spark, sf_dir), S.ANCHORS_F, S.ANCHORS_M, lower=True)


@register("a3_cohort_counts", with_ctes("""
SELECT CAST((SELECT count(DISTINCT name) FROM she_names) AS BIGINT) AS she_names,
  CAST((SELECT count(DISTINCT name) FROM he_names) AS BIGINT) AS he_names,
  CAST((SELECT count(*) FROM cohort WHERE gender = 'F') AS BIGINT) AS she_only,
  CAST((SELECT count(*) FROM cohort WHERE gender = 'M') AS BIGINT) AS he_only""", _COHORT_SQL))
def q_a3(spark, sf_dir):
    return PR.cohort_counts(_mentions(spark, sf_dir), S.ANCHORS_F, S.ANCHORS_M, lower=True)


# ------------------------------------------------------------- projections ---
@register("p_mention_columns", with_ctes(f"""
SELECT id,
  a_offset > pronoun_offset AS a_after_pronoun, b_offset > pronoun_offset AS b_after_pronoun,
  pronoun_offset - a_offset AS a_dist, pronoun_offset - b_offset AS b_dist,
  abs(pronoun_offset - a_offset) < abs(pronoun_offset - b_offset) AS a_nearer,
  NOT (a_coref OR b_coref) AS neither,
  lower(pronoun) IN ({F_LIST}) AS cohort_f,
  CAST(CASE WHEN b_coref THEN 1 WHEN a_coref THEN 0 ELSE 2 END AS INTEGER) AS label,
  CAST(CASE WHEN lower(pronoun) IN ('she', 'her') THEN 0 ELSE 1 END AS INTEGER) AS gender_flag,
  CAST(a_coref AS DOUBLE) AS y_a, CAST(b_coref AS DOUBLE) AS y_b,
  CAST(NOT (a_coref OR b_coref) AS DOUBLE) AS y_n,
  string_split(a, ' ')[1] AS a_first, CAST(len(string_split(a, ' ')) AS INTEGER) AS a_len,
  CASE WHEN lower(pronoun) IN ('she', 'her') THEN 'her' ELSE 'his' END AS prompt_pronoun,
  replace(b, '`', '') AS b_clean
FROM mentions"""))
def q_p_columns(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return m.select(
        "id",
        C.after_pronoun("a_offset").alias("a_after_pronoun"),
        C.after_pronoun("b_offset").alias("b_after_pronoun"),
        C.signed_distance("a_offset").alias("a_dist"),
        C.signed_distance("b_offset").alias("b_dist"),
        C.a_nearer().alias("a_nearer"),
        C.neither().alias("neither"),
        C.pronoun_in(S.ANCHORS_F, lower=True).alias("cohort_f"),
        C.class_label().alias("label"),
        C.gender_flag().alias("gender_flag"),
        *C.truth_onehot(),
        C.first_token("a").alias("a_first"),
        C.token_count("a").alias("a_len"),
        C.prompt_pronoun().alias("prompt_pronoun"),
        C.strip_backticks("b").alias("b_clean"))


@register("p9_pair_labels", with_ctes("""
SELECT id, 'A' AS cand, a AS cand_text, CAST(a_coref AS INTEGER) AS label FROM mentions
UNION ALL SELECT id, 'B', b, CAST(b_coref AS INTEGER) FROM mentions"""))
def q_p9(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return m.selectExpr("id", C.pair_labels_expr()).select("id", "cand", "cand_text", "label")


# ----------------------------------------------------------------- scorers ---
_U = f"CAST({S.UNIFORM_P} AS DOUBLE)"
_UNIFORM_SQL = f"SELECT id, {_U} AS p_a, {_U} AS p_b, {_U} AS p_neither FROM mentions"


@register("r1_constant_scores", with_ctes(_UNIFORM_SQL))
def q_r1(spark, sf_dir):
    return R.constant_scores(_mentions(spark, sf_dir))


_R2_SQL = _COHORT_SQL + [
    ("r2", f"""
SELECT m.id,
  (ca.name IS NOT NULL) AS a_hit, (cb.name IS NOT NULL) AS b_hit
FROM (SELECT id, a, b, CASE WHEN lower(pronoun) IN ({F_LIST}) THEN 'F'
                            WHEN lower(pronoun) IN ({M_LIST}) THEN 'M' END AS g FROM mentions) m
LEFT JOIN cohort ca ON ca.name = m.a AND ca.gender = m.g
LEFT JOIN cohort cb ON cb.name = m.b AND cb.gender = m.g"""),
    ("r2_scores", f"""
SELECT id,
  CASE WHEN a_hit OR b_hit THEN CAST(a_hit AS DOUBLE) ELSE {_U} END AS p_a,
  CASE WHEN a_hit OR b_hit THEN CAST(b_hit AS DOUBLE) ELSE {_U} END AS p_b,
  CASE WHEN a_hit OR b_hit THEN CAST(0.0 AS DOUBLE) ELSE {_U} END AS p_neither
FROM r2"""),
]


def _r2(m):
    return R.name_gender_scores(m, m, S.ANCHORS_F, S.ANCHORS_M, lower=True)


@register("r2_name_gender_scores", with_ctes("SELECT * FROM r2_scores", _R2_SQL))
def q_r2(spark, sf_dir):
    return _r2(_mentions(spark, sf_dir))


# -------------------------------------------------------------- evaluation ---
_TRUTH_SQL = ("truth", """
SELECT id, CAST(CASE WHEN b_coref THEN 1 WHEN a_coref THEN 0 ELSE 2 END AS INTEGER) AS label,
  CAST(a_coref AS DOUBLE) AS y_a, CAST(b_coref AS DOUBLE) AS y_b,
  CAST(NOT (a_coref OR b_coref) AS DOUBLE) AS y_n FROM mentions""")


def _eval_sql(pred_cte: str) -> list[tuple[str, str]]:
    eps = S.LOGLOSS_EPS
    return [_TRUTH_SQL, ("ev0", f"""
SELECT t.*, p.p_a, p.p_b, p.p_neither,
  least(greatest(p.p_a, {eps}), 1 - {eps}) AS ca,
  least(greatest(p.p_b, {eps}), 1 - {eps}) AS cb,
  least(greatest(p.p_neither, {eps}), 1 - {eps}) AS cn,
  CAST(CASE WHEN p.p_a >= p.p_b AND p.p_a >= p.p_neither THEN 0
            WHEN p.p_b >= p.p_neither THEN 1 ELSE 2 END AS INTEGER) AS pred
FROM truth t JOIN {pred_cte} p ON p.id = t.id"""),
        ("ev", """
SELECT *, -(y_a * ln(ca / (ca + cb + cn)) + y_b * ln(cb / (ca + cb + cn))
            + y_n * ln(cn / (ca + cb + cn))) AS loss FROM ev0""")]


_REPORT_SQL = """
SELECT count(*) AS n, avg(loss) AS log_loss,
  avg(CASE WHEN label = pred THEN loss END) AS correct_log_loss,
  avg(CAST(label = pred AS DOUBLE)) AS accuracy,
  CAST(count(*) FILTER (WHERE label <> 2 AND pred <> 2) AS BIGINT) AS non_neither_n,
  avg(CASE WHEN label <> 2 AND pred <> 2 THEN CAST(label = pred AS DOUBLE) END) AS non_neither_accuracy,
  CAST(count(*) FILTER (WHERE pred = 0) AS BIGINT) AS pred_a,
  CAST(count(*) FILTER (WHERE pred = 1) AS BIGINT) AS pred_b,
  CAST(count(*) FILTER (WHERE pred = 2) AS BIGINT) AS pred_neither
FROM ev"""


@register("a9_log_loss_uniform", with_ctes(
    "SELECT count(*) AS n, avg(loss) AS log_loss FROM ev",
    [("uniform", _UNIFORM_SQL)] + _eval_sql("uniform")), doubles=["log_loss"])
def q_a9(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return E.log_loss(E.truth_table(m), R.constant_scores(m))


REPORT_DOUBLES = ["log_loss", "correct_log_loss", "accuracy", "non_neither_accuracy"]


@register("k7_report_name_gender", with_ctes(_REPORT_SQL, _R2_SQL + _eval_sql("r2_scores")),
          doubles=REPORT_DOUBLES)
def q_k7_r2(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return E.evaluation_report(E.truth_table(m), _r2(m))


@register("a12_confusion_name_gender", with_ctes("""
SELECT l.c AS label, p.c AS pred, CAST(count(ev.id) AS BIGINT) AS n
FROM (SELECT unnest([0, 1, 2]) AS c) l CROSS JOIN (SELECT unnest([0, 1, 2]) AS c) p
LEFT JOIN ev ON ev.label = l.c AND ev.pred = p.c GROUP BY l.c, p.c""", _R2_SQL + _eval_sql("r2_scores")))
def q_a12(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return E.confusion_matrix(E.truth_table(m), _r2(m))


@register("a14_predicted_counts_name_gender", with_ctes(f"""
SELECT c.cls AS pred, c.cls_name, CAST(count(ev.id) AS BIGINT) AS n
FROM (SELECT unnest([0, 1, 2]) AS cls, unnest({['A', 'B', 'NEITHER']}) AS cls_name) c
LEFT JOIN ev ON ev.pred = c.cls GROUP BY c.cls, c.cls_name""", _R2_SQL + _eval_sql("r2_scores")))
def q_a14(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return E.predicted_counts(E.truth_table(m), _r2(m))


@register("a15_errors_per_class_name_gender", with_ctes("""
SELECT label, count(*) AS total, CAST(count(*) FILTER (WHERE pred <> label) AS BIGINT) AS wrong
FROM ev GROUP BY label""", _R2_SQL + _eval_sql("r2_scores")))
def q_a15(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return E.errors_per_class(E.truth_table(m), _r2(m))


@register("t3_first_errors_name_gender", with_ctes("""
SELECT id, label, pred, p_a, p_b, p_neither FROM ev WHERE pred <> label ORDER BY id LIMIT 20""",
                                                   _R2_SQL + _eval_sql("r2_scores")))
def q_t3(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return E.first_errors(E.truth_table(m), _r2(m))


# the other query families register into QUERIES / SQL on import
from mentionkit.plans import catalog_features  # noqa: E402,F401
from mentionkit.plans import catalog_scorers  # noqa: E402,F401
from mentionkit.plans import catalog_embed  # noqa: E402,F401
from mentionkit.plans import catalog_ml  # noqa: E402,F401
from mentionkit.plans import catalog_io  # noqa: E402,F401
