"""Registered queries: rule scorers R3-R7, T2 and their evaluation (K7 on the cascade)."""

from __future__ import annotations

from mentionkit import schema as S
from mentionkit.operators import evaluate as E
from mentionkit.operators import scorers as R
from mentionkit.operators import tree as TR
from mentionkit.plans.catalog import REPORT_DOUBLES, _eval_sql, _REPORT_SQL, register
from mentionkit.plans.catalog_features import F2_SQL_CTES, position_sql
from mentionkit.plans.fixture import load_context
from mentionkit.plans.oracle import with_ctes

P3 = ["p_a", "p_b", "p_neither"]
U = S.UNDECIDED
T = S.TIE
TN = F2_SQL_CTES[0]

R3_SQL = [TN, ("w3t1", position_sql(use_target_len=False)), ("ov1", """
SELECT c.id, c.role AS cand, CAST(count(p.feature) AS BIGINT) AS overlap
FROM (SELECT DISTINCT id, role, feature FROM w3t1 WHERE role <> 'P') c
LEFT JOIN (SELECT DISTINCT id, feature FROM w3t1 WHERE role = 'P') p ON p.id = c.id AND p.feature = c.feature
GROUP BY c.id, c.role"""), ("pts", """
SELECT p.id,
  CAST(coalesce(oa.overlap, 0)
    + CASE WHEN p.dep = a.dep THEN 2 ELSE 0 END
    + CASE WHEN p.gdep = a.gdep AND p.gdep <> '' THEN 1 ELSE 0 END
    + CASE WHEN p.gupos = a.gupos AND p.gupos <> '' THEN 2 ELSE 0 END AS BIGINT) AS a_points,
  CAST(coalesce(ob.overlap, 0)
    + CASE WHEN NOT (p.dep = a.dep) AND p.dep = b.dep THEN 2 ELSE 0 END
    + CASE WHEN NOT (p.gdep = a.gdep AND p.gdep <> '') AND p.gdep = b.gdep AND p.gdep <> '' THEN 1 ELSE 0 END
    + CASE WHEN NOT (p.gupos = a.gupos AND p.gupos <> '') AND p.gupos = b.gupos AND p.gupos <> ''
           THEN 2 ELSE 0 END AS BIGINT) AS b_points
FROM tn p JOIN tn a ON a.id = p.id AND a.role = 'A' JOIN tn b ON b.id = p.id AND b.role = 'B'
LEFT JOIN ov1 oa ON oa.id = p.id AND oa.cand = 'A' LEFT JOIN ov1 ob ON ob.id = p.id AND ob.cand = 'B'
WHERE p.role = 'P'"""), ("r3_scores", f"""
SELECT id,
  CAST(CASE WHEN a_points < 4 AND b_points < 4 THEN {U[0]} WHEN a_points > b_points THEN 1.0
       WHEN a_points < b_points THEN 0.0 ELSE {T[0]} END AS DOUBLE) AS p_a,
  CAST(CASE WHEN a_points < 4 AND b_points < 4 THEN {U[1]} WHEN a_points > b_points THEN 0.0
       WHEN a_points < b_points THEN 1.0 ELSE {T[1]} END AS DOUBLE) AS p_b,
  CAST(CASE WHEN a_points < 4 AND b_points < 4 THEN {U[2]} WHEN a_points > b_points THEN 0.0
       WHEN a_points < b_points THEN 0.0 ELSE {T[2]} END AS DOUBLE) AS p_neither
FROM pts""")]

T2_SQL = [("sc", """SELECT id, doc_id, min(sent) AS lo_sent, max(sent) AS hi_sent FROM tw GROUP BY id, doc_id"""),
          ("nm", """SELECT doc_id, sent, word AS token, count(*) AS c FROM words WHERE upos = 'PROPN'
GROUP BY doc_id, sent, word"""),
          ("cand", """SELECT sc.id, nm.token, CAST(sum(nm.c) AS DOUBLE) AS logit FROM sc
JOIN nm ON nm.doc_id = sc.doc_id AND nm.sent BETWEEN sc.lo_sent AND sc.hi_sent GROUP BY sc.id, nm.token"""),
          ("t2", """SELECT id, CAST(rank AS INTEGER) AS rank, token,
  exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY id) AS prob
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logit DESC, token ASC) AS rank,
             max(logit) OVER (PARTITION BY id) AS mx FROM cand) WHERE rank <= 5""")]

R4_SQL = T2_SQL + [("r4m", f"""
SELECT c.id, c.role, arg_min(p.prob, p.rank) AS rate
FROM (SELECT t.id, t.role, w.word AS cand_word FROM targets t
      JOIN words w ON w.doc_id = t.doc_id AND w.wi = t.wi WHERE t.role <> 'P') c
JOIN t2 p ON p.id = c.id
WHERE p.prob >= {S.MIN_PREDICTION_PROB} AND length(p.token) > 0 AND starts_with(c.cand_word, p.token)
GROUP BY c.id, c.role"""), ("r4", """
SELECT i.id, coalesce(a.rate, 0.0) AS ra, coalesce(b.rate, 0.0) AS rb
FROM (SELECT DISTINCT id FROM targets) i
LEFT JOIN r4m a ON a.id = i.id AND a.role = 'A' LEFT JOIN r4m b ON b.id = i.id AND b.role = 'B'"""),
    ("r4_scores", f"""
SELECT id, CAST(CASE WHEN ra = 0 AND rb = 0 THEN {U[0]} ELSE ra / (ra + rb) END AS DOUBLE) AS p_a,
  CAST(CASE WHEN ra = 0 AND rb = 0 THEN {U[1]} ELSE rb / (ra + rb) END AS DOUBLE) AS p_b,
  CAST(CASE WHEN ra = 0 AND rb = 0 THEN {U[2]} ELSE 0.0 END AS DOUBLE) AS p_neither FROM r4""")]

R5_SQL = R3_SQL + R4_SQL + [("r5_scores", """
SELECT f.id,
  CASE WHEN NOT (f.p_a >= f.p_b AND f.p_a >= f.p_neither) AND NOT (f.p_b >= f.p_neither) THEN s.p_a ELSE f.p_a END AS p_a,
  CASE WHEN NOT (f.p_a >= f.p_b AND f.p_a >= f.p_neither) AND NOT (f.p_b >= f.p_neither) THEN s.p_b ELSE f.p_b END AS p_b,
  CASE WHEN NOT (f.p_a >= f.p_b AND f.p_a >= f.p_neither) AND NOT (f.p_b >= f.p_neither)
       THEN s.p_neither ELSE f.p_neither END AS p_neither
FROM r4_scores f LEFT JOIN r3_scores s ON s.id = f.id""")]


def _r3(cx):
    return R.syntax_scores(cx.targets, cx.near_words)


def _t2(cx):
    # the scope spans whole sentence ranges: it reads all names, not the neighbourhood's
    return R.top_predictions(R.scope_name_counts(cx.targets, cx.near_words, cx.corpus.names()))


def _r4(cx):
    return R.prefix_scores(cx.targets, cx.near_words, _t2(cx))


def _r5(cx):
    return R.cascade(_r4(cx), _r3(cx))


@register("r3_syntax_points", with_ctes("SELECT * FROM pts", R3_SQL))
def q_r3_points(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return R.syntax_points(cx.targets, cx.near_words)


@register("r3_syntax_scores", with_ctes("SELECT * FROM r3_scores", R3_SQL))
def q_r3(spark, sf_dir):
    return _r3(load_context(spark, sf_dir))


@register("t2_top_predictions", with_ctes("SELECT * FROM t2", T2_SQL), doubles=["prob"])
def q_t2(spark, sf_dir):
    return _t2(load_context(spark, sf_dir))


@register("r4_prefix_scores", with_ctes("SELECT * FROM r4_scores", R4_SQL), doubles=P3)
def q_r4(spark, sf_dir):
    return _r4(load_context(spark, sf_dir))


@register("r5_cascade_scores", with_ctes("SELECT * FROM r5_scores", R5_SQL), doubles=P3)
def q_r5(spark, sf_dir):
    return _r5(load_context(spark, sf_dir))


@register("k7_report_cascade", with_ctes(_REPORT_SQL, R5_SQL + _eval_sql("r5_scores")),
          doubles=REPORT_DOUBLES)
def q_k7_cascade(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return E.evaluation_report(E.truth_table(cx.corpus.spans), _r5(cx))


@register("a12_confusion_cascade", with_ctes("""
SELECT l.c AS label, p.c AS pred, CAST(count(ev.id) AS BIGINT) AS n
FROM (SELECT unnest([0, 1, 2]) AS c) l CROSS JOIN (SELECT unnest([0, 1, 2]) AS c) p
LEFT JOIN ev ON ev.label = l.c AND ev.pred = p.c GROUP BY l.c, p.c""", R5_SQL + _eval_sql("r5_scores")))
def q_a12_cascade(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return E.confusion_matrix(E.truth_table(cx.corpus.spans), _r5(cx))


@register("r6_pair_rates_overlap", with_ctes(f"""
SELECT id, pa / (pa + pb + (1 - pa) * (1 - pb)) AS p_a, pb / (pa + pb + (1 - pa) * (1 - pb)) AS p_b,
  (1 - pa) * (1 - pb) / (pa + pb + (1 - pa) * (1 - pb)) AS p_neither
FROM (SELECT id, overlap_a / {2 * S.DEFAULT_WINDOW + 1}.0 AS pa, overlap_b / {2 * S.DEFAULT_WINDOW + 1}.0 AS pb
      FROM f2)""", F2_SQL_CTES), doubles=P3)
def q_r6(spark, sf_dir):
    """Pair probabilities = positional-window overlap / (2N+1), combined by R6."""
    from pyspark.sql import functions as F
    cx = load_context(spark, sf_dir)
    f2 = TR.relational_features(cx.targets, cx.near_words)
    width = float(2 * S.DEFAULT_WINDOW + 1)
    pairs = f2.selectExpr("id", f"stack(2, 'A', overlap_a / double({width}), 'B', overlap_b / double({width}))"
                                " as (cand, p)")
    return R.pair_rates(pairs.select("id", "cand", F.col("p").cast("double").alias("p")))


@register("r7_softmax_syntax_points", with_ctes("""
SELECT id, exp(a_points - m) / (exp(a_points - m) + exp(b_points - m) + exp(-m)) AS p_a,
  exp(b_points - m) / (exp(a_points - m) + exp(b_points - m) + exp(-m)) AS p_b,
  exp(-m) / (exp(a_points - m) + exp(b_points - m) + exp(-m)) AS p_neither
FROM (SELECT id, CAST(a_points AS DOUBLE) AS a_points, CAST(b_points AS DOUBLE) AS b_points,
             greatest(CAST(a_points AS DOUBLE), CAST(b_points AS DOUBLE), 0.0) AS m FROM pts)""", R3_SQL),
          doubles=P3)
def q_r7(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    pts = R.syntax_points(cx.targets, cx.near_words)
    return R.softmax_pair(pts, "a_points", "b_points")


@register("k7_report_syntax", with_ctes(_REPORT_SQL, R3_SQL + _eval_sql("r3_scores")), doubles=REPORT_DOUBLES)
def q_k7_syntax(spark, sf_dir):
    """K7 over the syntax-points scorer alone."""
    cx = load_context(spark, sf_dir)
    return E.evaluation_report(E.truth_table(cx.corpus.spans), _r3(cx))
