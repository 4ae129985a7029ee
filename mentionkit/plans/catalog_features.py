"""Registered queries: alignment, windows, tree, vectorisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.operators import tree as TR
from mentionkit.operators import vectorize as V
from mentionkit.operators import windows as W
from mentionkit.plans.catalog import register
from mentionkit.plans.fixture import load_context
from mentionkit.plans.oracle import _list, add_cte, with_ctes

B = 64
N = S.DEFAULT_WINDOW
BLANK = S.BLANK_START

# ------------------------------------------------------------ shared CTEs ---
add_cte("targets1", r"""
SELECT id, doc_id, role, CAST(off AS INTEGER) AS off,
  regexp_split_to_array(regexp_replace(span, '^\s+|\s+$', '', 'g'), '\s+')[1] AS target,
  CAST(CASE WHEN regexp_replace(span, '^\s+|\s+$', '', 'g') = '' THEN 0
            ELSE len(regexp_split_to_array(regexp_replace(span, '^\s+|\s+$', '', 'g'), '\s+')) END
       AS INTEGER) AS target_len
FROM (SELECT id, doc_id, 'P' AS role, pronoun_offset AS off, pronoun AS span FROM mentions
      UNION ALL SELECT id, doc_id, 'A', a_offset, a FROM mentions
      UNION ALL SELECT id, doc_id, 'B', b_offset, b FROM mentions)""")
add_cte("cov", f"""
SELECT doc_id, wi AS base_wi, word AS base_word, lo, o + length(word) AS hi,
  unnest(range(lo // {B}, (o + length(word) - 1) // {B} + 1)) AS bk
FROM words""")
add_cte("tbase", f"""
SELECT t.*, c.base_wi, c.base_word FROM targets1 t
LEFT JOIN cov c ON c.doc_id = t.doc_id AND c.bk = t.off // {B} AND c.lo <= t.off AND t.off < c.hi""")
add_cte("tfix", """
SELECT b.id, b.role, min(k.k) AS fix_k
FROM tbase b CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS k) k
JOIN words w ON w.doc_id = b.doc_id AND w.wi = b.base_wi + k.k
WHERE b.base_word <> b.target AND w.word = b.target GROUP BY b.id, b.role""")
add_cte("targets", """
SELECT b.id, b.doc_id, b.role, b.off, b.target, b.target_len,
  CAST(b.base_wi + coalesce(f.fix_k, 0) AS INTEGER) AS wi
FROM tbase b LEFT JOIN tfix f ON f.id = b.id AND f.role = b.role""")
add_cte("nw", "SELECT doc_id, CAST(count(*) AS INTEGER) AS n_words FROM words GROUP BY doc_id")
add_cte("pw", f"""
SELECT doc_id, list_filter(regexp_extract_all(text, '{S.TOKEN_PATTERN}'),
                           lambda x: NOT regexp_matches(x, '{BLANK}')) AS warr FROM documents""")
add_cte("sb", "SELECT doc_id, sent, min(wi) AS s_first, max(wi) AS s_last FROM words GROUP BY doc_id, sent")
add_cte("tw", """
SELECT t.id, t.doc_id, t.role, t.wi, w.sent, w.idx, w.governor, w.xpos, w.upos, w.deprel
FROM targets t JOIN words w ON w.doc_id = t.doc_id AND w.wi = t.wi""")


def _tag_sql(kind: str, alias: str = "w") -> str:
    if kind == "XPOS":
        return f"replace({alias}.xpos, '$', '')"
    if kind == "DEPENDENCY":
        return f"split_part({alias}.deprel, ':', 1)"
    return f"{alias}.upos"


def window_sql(n: int = N, kind: str = "UPOS", use_target_len: bool = True) -> str:
    """W1 rows ``(id, role, k, tag)``."""
    tl = "t.target_len" if use_target_len else "1"
    return f"""
SELECT x.id, x.role, x.k,
  CASE WHEN x.pos < 0 THEN 'BOS' WHEN x.pos >= x.n_words THEN 'EOS' ELSE {_tag_sql(kind)} END AS tag
FROM (SELECT t.id, t.role, t.doc_id, CAST(ks.k AS INTEGER) AS k, n.n_words,
        CASE WHEN ks.k <= 0 THEN t.wi + ks.k ELSE t.wi + {tl} - 1 + ks.k END AS pos
      FROM targets t JOIN nw n ON n.doc_id = t.doc_id
      CROSS JOIN (SELECT unnest(range({-n}, {n + 1})) AS k) ks) x
LEFT JOIN words w ON w.doc_id = x.doc_id AND w.wi = x.pos
WHERE x.k <= 0 OR x.pos < x.n_words + {n}"""


def position_sql(n: int = N, kind: str = "UPOS", use_target_len: bool = True) -> str:
    return f"SELECT id, role, k, tag || '_' || CAST(k AS VARCHAR) AS feature FROM ({window_sql(n, kind, use_target_len)})"


def ngram_sql(window: int = S.DEFAULT_NGRAM_WINDOW, n: int = S.DEFAULT_NGRAM, kind: str = "UPOS") -> str:
    return f"""
SELECT id, role, s, string_agg(tag, '_' ORDER BY j) AS gram FROM (
  SELECT x.id, x.role, x.s, x.j,
    CASE WHEN x.pos < 0 THEN 'BOS' WHEN x.pos >= x.n_words THEN 'EOS' ELSE {_tag_sql(kind)} END AS tag
  FROM (SELECT t.id, t.role, t.doc_id, CAST(ss.s AS INTEGER) AS s, js.j, n.n_words, t.wi + ss.s + js.j AS pos
        FROM targets t JOIN nw n ON n.doc_id = t.doc_id
        CROSS JOIN (SELECT unnest(range({-window}, {window + 1})) AS s) ss
        CROSS JOIN (SELECT unnest(range(0, {n})) AS j) js) x
  LEFT JOIN words w ON w.doc_id = x.doc_id AND w.wi = x.pos)
GROUP BY id, role, s"""


def dependency_sql(kind: str = "UPOS") -> str:
    nodes = f"(SELECT doc_id, wi, sent, idx, governor, {_tag_sql(kind)} AS tag FROM words w)"
    return f"""
SELECT id, role, relation, tag FROM (
WITH nodes AS {nodes},
tt AS (SELECT t.id, t.role, t.doc_id, t.wi, n.sent AS t_sent, n.idx AS t_idx, n.governor AS t_gov
       FROM targets t JOIN nodes n ON n.doc_id = t.doc_id AND n.wi = t.wi),
par AS (SELECT tt.*, p.wi AS p_wi, p.sent AS p_sent, p.idx AS p_idx, p.governor AS p_gov, p.tag AS p_tag
        FROM tt JOIN nodes p ON p.doc_id = tt.doc_id AND p.wi = tt.wi + tt.t_gov - tt.t_idx
        WHERE tt.t_gov <> 0),
sib AS (SELECT par.id, par.role, par.doc_id, s.sent AS s_sent, s.idx AS s_idx, s.tag
        FROM par JOIN nodes s ON s.doc_id = par.doc_id AND s.sent = par.p_sent AND s.governor = par.p_idx
        WHERE s.wi <> par.wi),
ch AS (SELECT tt.id, tt.role, tt.doc_id, c.sent AS c_sent, c.idx AS c_idx, c.tag
       FROM tt JOIN nodes c ON c.doc_id = tt.doc_id AND c.sent = tt.t_sent AND c.governor = tt.t_idx)
SELECT id, role, 'governor' AS relation, p_tag AS tag FROM par
UNION ALL SELECT par.id, par.role, 'ancestor', coalesce(a.tag, 'NONE') FROM par
  LEFT JOIN nodes a ON a.doc_id = par.doc_id AND a.wi = par.p_wi + par.p_gov - par.p_idx
  WHERE par.p_gov <> 0
UNION ALL SELECT id, role, 'sibling', tag FROM sib
UNION ALL SELECT sib.id, sib.role, 'sibling_child', x.tag FROM sib
  JOIN nodes x ON x.doc_id = sib.doc_id AND x.sent = sib.s_sent AND x.governor = sib.s_idx
UNION ALL SELECT id, role, 'child', tag FROM ch
UNION ALL SELECT ch.id, ch.role, 'grandchild', g.tag FROM ch
  JOIN nodes g ON g.doc_id = ch.doc_id AND g.sent = ch.c_sent AND g.governor = ch.c_idx)"""


def counts_sql(bag_sql: str, family: str, kind: str = "UPOS") -> str:
    vocab = _list(V.vocabulary(family, kind))
    return f"""
SELECT id, role, '{family}' AS family, lower(feature) AS feature, count(*) AS cnt
FROM ({bag_sql}) WHERE lower(feature) IN ({vocab}) GROUP BY id, role, lower(feature)"""


def detok_sql(arr: str) -> str:
    return (f"regexp_replace(regexp_replace(array_to_string({arr}, ' '), ' ([^\\p{{L}}\\p{{N}}_])', '\\1', 'g'),"
            f" ' n''t', 'n''t', 'g')")


# ------------------------------------------------------------------ queries ---
@register("j8_targets", with_ctes("SELECT id, role, off, target, target_len, wi FROM targets"))
def q_j8(spark, sf_dir):
    return load_context(spark, sf_dir).targets.select("id", "role", "off", "target", "target_len", "wi")


@register("w1_tag_window", with_ctes(window_sql()))
def q_w1(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return W.tag_window(cx.targets, cx.near_words)


@register("w1_tag_window_n20", with_ctes(window_sql(n=20)))
def q_w1_n20(spark, sf_dir):
    """A window wider than the default neighbourhood: the context is built for it."""
    cx = load_context(spark, sf_dir, radius=20)
    return W.tag_window(cx.targets, cx.near_words, n=20)


@register("w1_tag_window_xpos", with_ctes(window_sql(kind="XPOS")))
def q_w1_xpos(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return W.tag_window(cx.targets, cx.near_words, kind="XPOS")


@register("w2_tag_ngrams", with_ctes(ngram_sql()))
def q_w2(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return W.tag_ngrams(cx.targets, cx.near_words)


@register("w3_positional_window", with_ctes(position_sql()))
def q_w3(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return W.positional_window(cx.targets, cx.near_words)


@register("h1_tag_counts", with_ctes(counts_sql("SELECT id, role, tag AS feature FROM (" + window_sql() + ")",
                                                "normal")))
def q_h1(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    bag = W.tag_window(cx.targets, cx.near_words).select("id", "role", F.col("tag").alias("feature"))
    return V.count_features(bag, "normal")


@register("h2_ngram_counts", with_ctes(counts_sql("SELECT id, role, gram AS feature FROM (" + ngram_sql() + ")",
                                                  "ngram")))
def q_h2(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    bag = W.tag_ngrams(cx.targets, cx.near_words).select("id", "role", F.col("gram").alias("feature"))
    return V.count_features(bag, "ngram")


@register("h3_position_counts", with_ctes(counts_sql(position_sql(), "position")))
def q_h3(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return V.count_features(W.positional_window(cx.targets, cx.near_words), "position")


@register("h3_position_counts_n10", with_ctes(counts_sql(position_sql(n=10), "position")))
def q_h3_n10(spark, sf_dir):
    """N=10 window against the +/-5 vocabulary: positions 6..10 drop out (OOV)."""
    cx = load_context(spark, sf_dir)
    return V.count_features(W.positional_window(cx.targets, cx.near_words, n=10), "position")


@register("f1_dependency_bag", with_ctes(dependency_sql()))
def q_f1(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return TR.dependency_bag(cx.targets, cx.near_words)


@register("f1_dependency_bag_xpos", with_ctes(dependency_sql("XPOS")))
def q_f1_xpos(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return TR.dependency_bag(cx.targets, cx.near_words, kind="XPOS")


_DEP_BAG_SQL = "SELECT id, role, tag || '_' || relation AS feature FROM (" + dependency_sql() + ")"


@register("h5_dependency_counts", with_ctes(counts_sql(_DEP_BAG_SQL, "dependency")))
def q_h5(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    bag = TR.dependency_bag(cx.targets, cx.near_words).select(
        "id", "role", F.concat_ws("_", "tag", "relation").alias("feature"))
    return V.count_features(bag, "dependency")


_H3_SQL = counts_sql(position_sql(), "position")
_H5_SQL = counts_sql(_DEP_BAG_SQL, "dependency")
H6_SQL = f"""
SELECT coalesce(pc.id, cc.id) AS id, coalesce(pc.cand, cc.cand) AS cand,
  coalesce(pc.family, cc.family) AS family, coalesce(pc.feature, cc.feature) AS feature,
  CAST(coalesce(pc.cnt, 0) - coalesce(cc.cnt, 0) AS BIGINT) AS diff,
  CAST(coalesce(pc.cnt, 0) * coalesce(cc.cnt, 0) AS BIGINT) AS prod
FROM (SELECT c.id, cd.cand, c.family, c.feature, c.cnt FROM cnt c
      CROSS JOIN (SELECT unnest(['A', 'B']) AS cand) cd WHERE c.role = 'P') pc
FULL OUTER JOIN (SELECT id, role AS cand, family, feature, cnt FROM cnt WHERE role <> 'P') cc
  ON pc.id = cc.id AND pc.cand = cc.cand AND pc.family = cc.family AND pc.feature = cc.feature"""


def feature_counts(cx):
    """H3 positional and H5 dependency counts of all targets: the staged ``features`` table."""
    from mentionkit.plans.ml import staged_counts
    return staged_counts(cx)


@register("h6_pair_interactions", with_ctes(H6_SQL, [("cnt", f"{_H3_SQL} UNION ALL {_H5_SQL}")]))
def q_h6(spark, sf_dir):
    return V.pair_interactions(feature_counts(load_context(spark, sf_dir)))


F2_SQL_CTES = [
    ("tn", """
SELECT tw.id, tw.role, tw.wi, tw.xpos, split_part(tw.deprel, ':', 1) AS dep,
  coalesce(split_part(g.deprel, ':', 1), '') AS gdep, coalesce(g.upos, '') AS gupos
FROM tw LEFT JOIN words g ON g.doc_id = tw.doc_id AND tw.governor <> 0
  AND g.wi = tw.wi + tw.governor - tw.idx"""),
    ("w3b", position_sql()),
    ("ov", """
SELECT c.id, c.role AS cand, CAST(count(p.feature) AS BIGINT) AS overlap
FROM (SELECT DISTINCT id, role, feature FROM w3b WHERE role <> 'P') c
LEFT JOIN (SELECT DISTINCT id, feature FROM w3b WHERE role = 'P') p ON p.id = c.id AND p.feature = c.feature
GROUP BY c.id, c.role"""),
    ("f2", """
SELECT p.id, p.dep = a.dep AS dep_eq_a, p.dep = b.dep AS dep_eq_b,
  p.gdep = a.gdep AS gov_dep_eq_a, p.gdep = b.gdep AS gov_dep_eq_b,
  p.gupos = a.gupos AS gov_upos_eq_a, p.gupos = b.gupos AS gov_upos_eq_b,
  coalesce(oa.overlap, 0) AS overlap_a, coalesce(ob.overlap, 0) AS overlap_b,
  CAST(abs(p.wi - a.wi) AS INTEGER) AS dist_a, CAST(abs(p.wi - b.wi) AS INTEGER) AS dist_b,
  CAST(coalesce(p.xpos = 'PRP$', false) AS INTEGER) AS possessive
FROM tn p JOIN tn a ON a.id = p.id AND a.role = 'A' JOIN tn b ON b.id = p.id AND b.role = 'B'
LEFT JOIN ov oa ON oa.id = p.id AND oa.cand = 'A' LEFT JOIN ov ob ON ob.id = p.id AND ob.cand = 'B'
WHERE p.role = 'P'"""),
]


@register("f2_relational_features", with_ctes("SELECT * FROM f2", F2_SQL_CTES))
def q_f2(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return TR.relational_features(cx.targets, cx.near_words)


@register("f3_same_sentence", with_ctes("""
SELECT p.id, p.sent = a.sent AS same_pa, p.sent = b.sent AS same_pb, a.sent = b.sent AS same_ab
FROM tw p JOIN tw a ON a.id = p.id AND a.role = 'A' JOIN tw b ON b.id = p.id AND b.role = 'B'
WHERE p.role = 'P'"""))
def q_f3(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return TR.same_sentence(cx.targets, cx.near_words)


W6_SQL = f"""
SELECT x.id, {detok_sql("list_slice(pw.warr, s1.s_first + 1, s2.s_last + 1)")} AS scope
FROM (SELECT id, doc_id, min(sent) AS lo_sent, max(sent) AS hi_sent FROM tw GROUP BY id, doc_id) x
JOIN sb s1 ON s1.doc_id = x.doc_id AND s1.sent = x.lo_sent
JOIN sb s2 ON s2.doc_id = x.doc_id AND s2.sent = x.hi_sent
JOIN pw ON pw.doc_id = x.doc_id"""


@register("w6_scope_text", with_ctes(W6_SQL))
def q_w6(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return W.scope_text(cx.targets, cx.near_words, cx.corpus.passages)


W7_SQL = f"""
SELECT x.id, {detok_sql("list_slice(pw.warr, x.st + 1, x.wi)")} AS before
FROM (SELECT id, doc_id, wi,
        CASE WHEN governor <> 0 AND wi + governor - idx < wi THEN wi + governor - idx
             ELSE wi - idx + 1 END AS st FROM tw WHERE role = 'P') x
JOIN pw ON pw.doc_id = x.doc_id"""


@register("w7_text_before_pronoun", with_ctes(W7_SQL))
def q_w7(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    return W.text_before_pronoun(cx.targets, cx.near_words, cx.corpus.passages)


# ----------------------------------------------------- contrast statistics ---
from mentionkit.operators import profile as PR  # noqa: E402

PAIRS_SQL = ("pairs", """
SELECT id, 'A' AS cand, true AS is_true, 0 AS block FROM mentions WHERE a_coref
UNION ALL SELECT id, 'B', true, 1 FROM mentions WHERE b_coref
UNION ALL SELECT id, 'A', false, 0 FROM mentions WHERE b_coref
UNION ALL SELECT id, 'B', false, 1 FROM mentions WHERE a_coref
UNION ALL SELECT id, 'A', false, 2 FROM mentions WHERE NOT (a_coref OR b_coref)
UNION ALL SELECT id, 'B', false, 3 FROM mentions WHERE NOT (a_coref OR b_coref)""")
CONTRAST_SQL = [
    ("cnt", _H3_SQL), ("h6", H6_SQL), PAIRS_SQL,
    ("pstats", """
SELECT p.id, p.cand, p.is_true, p.block, CAST(coalesce(s.l1, 0) AS BIGINT) AS l1,
  CAST(coalesce(s.same, 0) AS BIGINT) AS same
FROM pairs p LEFT JOIN (SELECT id, cand, sum(abs(diff)) AS l1, sum(prod) AS same FROM h6
                        WHERE family = 'position' GROUP BY id, cand) s
  ON s.id = p.id AND s.cand = p.cand"""),
]


def _position_interactions(cx):
    return V.pair_interactions(feature_counts(cx).where(F.col("family") == "position"))


def _pair_stats(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    pairs = PR.pair_blocks(cx.corpus.spans)
    return pairs, _position_interactions(cx)


@register("u5_pair_blocks", with_ctes("SELECT id, cand, is_true, block FROM pairs", [PAIRS_SQL]))
def q_u5(spark, sf_dir):
    from mentionkit.plans.fixture import load_corpus
    return PR.pair_blocks(load_corpus(spark, sf_dir).spans)


@register("a4_a5_pair_class_statistics", with_ctes("""
SELECT is_true, count(*) AS pairs, avg(l1) AS l1_mean, var_pop(l1) AS l1_var,
  avg(same) AS same_mean, var_pop(same) AS same_var FROM pstats GROUP BY is_true""", CONTRAST_SQL),
          doubles=["l1_mean", "l1_var", "same_mean", "same_var"])
def q_a4_a5(spark, sf_dir):
    pairs, inter = _pair_stats(spark, sf_dir)
    return PR.class_statistics(PR.pair_statistics(pairs, inter))


@register("j4_a6_true_vs_false_zip", with_ctes("""
SELECT count(*) AS pairs_compared,
  CAST(count(*) FILTER (WHERE t.l1 > f.l1) AS BIGINT) AS true_diff_larger,
  CAST(count(*) FILTER (WHERE t.same > f.same) AS BIGINT) AS true_same_larger
FROM (SELECT row_number() OVER (ORDER BY block, id) - 1 AS ord, l1, same FROM pstats WHERE is_true) t
JOIN (SELECT row_number() OVER (ORDER BY block, id) - 1 AS ord, l1, same FROM pstats WHERE NOT is_true) f
  ON t.ord = f.ord""", CONTRAST_SQL))
def q_j4(spark, sf_dir):
    pairs, inter = _pair_stats(spark, sf_dir)
    return PR.zip_true_false(PR.pair_statistics(pairs, inter))


def _dependency_stats(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    inter = V.pair_interactions(feature_counts(cx).where(F.col("family") == "dependency"))
    return PR.pair_statistics(PR.pair_blocks(cx.corpus.spans), inter, "dependency")


DEPENDENCY_CONTRAST_SQL = [("cnt", _H5_SQL), *CONTRAST_SQL[1:3],
                           ("pstats", CONTRAST_SQL[3][1].replace("'position'", "'dependency'"))]


@register("a4_a5_dependency_statistics", with_ctes("""
SELECT is_true, count(*) AS pairs, avg(l1) AS l1_mean, var_pop(l1) AS l1_var,
  avg(same) AS same_mean, var_pop(same) AS same_var FROM pstats GROUP BY is_true""", DEPENDENCY_CONTRAST_SQL),
          doubles=["l1_mean", "l1_var", "same_mean", "same_var"])
def q_a4_a5_dependency(spark, sf_dir):
    """A4 and A5 on the dependency family."""
    return PR.class_statistics(_dependency_stats(spark, sf_dir))


@register("j4_a6_dependency_zip", with_ctes("""
SELECT count(*) AS pairs_compared,
  CAST(count(*) FILTER (WHERE t.l1 > f.l1) AS BIGINT) AS true_diff_larger,
  CAST(count(*) FILTER (WHERE t.same > f.same) AS BIGINT) AS true_same_larger
FROM (SELECT row_number() OVER (ORDER BY block, id) - 1 AS ord, l1, same FROM pstats WHERE is_true) t
JOIN (SELECT row_number() OVER (ORDER BY block, id) - 1 AS ord, l1, same FROM pstats WHERE NOT is_true) f
  ON t.ord = f.ord""", DEPENDENCY_CONTRAST_SQL))
def q_j4_dependency(spark, sf_dir):
    """J4 and A6 on the dependency family."""
    return PR.zip_true_false(_dependency_stats(spark, sf_dir))


_VOCAB_POS = ", ".join(f"('{t}')" for t in V.vocabulary("position"))
A7_SQL = CONTRAST_SQL + [("a7", f"""
SELECT v.is_true, v.feature, CAST(coalesce(s.abs_diff, 0) AS BIGINT) AS abs_diff,
  CAST(coalesce(s.pos_diff, 0) AS BIGINT) AS pos_diff, CAST(coalesce(s.neg_diff, 0) AS BIGINT) AS neg_diff,
  CAST(coalesce(s.same, 0) AS BIGINT) AS same
FROM (SELECT feature, is_true FROM (VALUES {_VOCAB_POS}) vv(feature)
      CROSS JOIN (SELECT unnest([true, false]) AS is_true)) v
LEFT JOIN (SELECT p.is_true, h.feature, sum(abs(h.diff)) AS abs_diff, sum(greatest(h.diff, 0)) AS pos_diff,
                  sum(greatest(-h.diff, 0)) AS neg_diff, sum(h.prod) AS same
           FROM h6 h JOIN pairs p ON p.id = h.id AND p.cand = h.cand
           WHERE h.family = 'position' GROUP BY p.is_true, h.feature) s
  ON s.is_true = v.is_true AND s.feature = v.feature""")]


def _contrast(spark, sf_dir):
    pairs, inter = _pair_stats(spark, sf_dir)
    return PR.feature_contrast(pairs, inter, V.vocabulary_table(spark, "position"))


@register("a7_feature_contrast", with_ctes("SELECT * FROM a7", A7_SQL))
def q_a7(spark, sf_dir):
    return _contrast(spark, sf_dir)


@register("t1_top_features", with_ctes("""
SELECT is_true, score_kind, CAST(rank AS INTEGER) AS rank, feature, score FROM (
  SELECT *, row_number() OVER (PARTITION BY is_true, score_kind ORDER BY score DESC, feature ASC) AS rank
  FROM (SELECT is_true, feature, 'abs_diff' AS score_kind, abs_diff AS score FROM a7
        UNION ALL SELECT is_true, feature, 'pos_diff', pos_diff FROM a7
        UNION ALL SELECT is_true, feature, 'neg_diff', neg_diff FROM a7
        UNION ALL SELECT is_true, feature, 'same', same FROM a7)) WHERE rank <= 10""", A7_SQL))
def q_t1(spark, sf_dir):
    return PR.top_features(_contrast(spark, sf_dir))


@register("a17_bag_overlap", with_ctes("SELECT id, cand, overlap FROM ov", F2_SQL_CTES[:3]))
def q_a17(spark, sf_dir):
    """Set overlap of the pronoun's and each candidate's positional bags."""
    cx = load_context(spark, sf_dir)
    return TR.bag_overlap(W.positional_window(cx.targets, cx.near_words))


@register("h4_upos_position_counts", with_ctes(counts_sql(position_sql(kind="UPOS"), "position", "UPOS")))
def q_h4(spark, sf_dir):
    """H4: the UPOS positional vocabulary, whatever tag kind the other families use."""
    cx = load_context(spark, sf_dir)
    return V.count_features(W.positional_window(cx.targets, cx.near_words, kind="UPOS"), "position", "UPOS")


@register("w3_positional_window_deprel", with_ctes(position_sql(kind="DEPENDENCY")))
def q_w3_dep(spark, sf_dir):
    """P12's third selector: the relation before ':' as the tag."""
    cx = load_context(spark, sf_dir)
    return W.positional_window(cx.targets, cx.near_words, kind="DEPENDENCY")


@register("h1_tag_counts_xpos", with_ctes(counts_sql(
    "SELECT id, role, tag AS feature FROM (" + window_sql(kind="XPOS") + ")", "normal", "XPOS")))
def q_h1_xpos(spark, sf_dir):
    """H1 under the XPOS tag set (36-term vocabulary)."""
    cx = load_context(spark, sf_dir)
    bag = W.tag_window(cx.targets, cx.near_words, kind="XPOS").select("id", "role", F.col("tag").alias("feature"))
    return V.count_features(bag, "normal", "XPOS")


@register("h5_dependency_counts_xpos", with_ctes(counts_sql(
    "SELECT id, role, tag || '_' || relation AS feature FROM (" + dependency_sql("XPOS") + ")",
    "dependency", "XPOS")))
def q_h5_xpos(spark, sf_dir):
    """H5 under the XPOS tag set."""
    cx = load_context(spark, sf_dir)
    bag = TR.dependency_bag(cx.targets, cx.near_words, kind="XPOS").select(
        "id", "role", F.concat_ws("_", "tag", "relation").alias("feature"))
    return V.count_features(bag, "dependency", "XPOS")


@register("h2_ngram_counts_xpos", with_ctes(counts_sql(
    "SELECT id, role, gram AS feature FROM (" + ngram_sql(kind="XPOS") + ")", "ngram", "XPOS")))
def q_h2_xpos(spark, sf_dir):
    """H2 under the XPOS tag set (explicit product vocabulary of word-only tags)."""
    cx = load_context(spark, sf_dir)
    bag = W.tag_ngrams(cx.targets, cx.near_words, kind="XPOS").select("id", "role", F.col("gram").alias("feature"))
    return V.count_features(bag, "ngram", "XPOS")
