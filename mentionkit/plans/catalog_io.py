"""Registered queries: phrase search (F4), TSV / CSV sources and sinks (S1-S3),
prompts (P15), the plug-in batch scorer (K6) and the error listing (K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.functions import columns as C
from mentionkit.operators import evaluate as E
from mentionkit.operators import phrase as PH
from mentionkit.operators import scorers as R
from mentionkit.operators import windows as W
from mentionkit.plans import ml as M
from mentionkit.plans.catalog import _eval_sql, register
from mentionkit.plans.catalog_features import W6_SQL, W7_SQL, _H3_SQL, _H5_SQL
from mentionkit.plans.catalog_scorers import R5_SQL, _r5
from mentionkit.plans.fixture import load_context, load_corpus
from mentionkit.plans.oracle import with_ctes
from mentionkit.session import scratch_path
from mentionkit.sources import tsv

ENDS = ", ".join(f"'{e}'" for e in S.SENTENCE_END)


def _lemmas_sql(col: str) -> str:
    toks = (f"list_filter(regexp_extract_all({col}, '{S.TOKEN_PATTERN}'), "
            f"lambda x: NOT regexp_matches(x, '{S.BLANK_START}'))")
    first_end = f"coalesce(list_position(list_transform({toks}, lambda x: x IN ({ENDS})), true), len({toks}))"
    return f"list_transform(list_slice({toks}, 1, {first_end}), lambda x: lower(x))"


def _f4_sql(phrase_sql: str) -> str:
    return with_ctes("""
SELECT p.id, CAST(count(h.start) AS BIGINT) AS n_hits, CAST(coalesce(min(h.start), -1) AS INTEGER) AS first_hit
FROM ph p LEFT JOIN hits h ON h.id = p.id GROUP BY p.id""", [
        ("ph", f"SELECT id, doc_id, {_lemmas_sql('phrase')} AS lemmas FROM ({phrase_sql})"),
        ("st", """SELECT p.id, p.doc_id, p.lemmas, w.wi AS start FROM ph p
JOIN words w ON w.doc_id = p.doc_id AND w.lemma = p.lemmas[1] WHERE len(p.lemmas) > 0"""),
        ("rest", """SELECT x.id, x.start, count(*) AS n FROM (
  SELECT id, doc_id, start, lemmas, unnest(range(1, len(lemmas))) AS j FROM st WHERE len(lemmas) > 1) x
JOIN words w ON w.doc_id = x.doc_id AND w.wi = x.start + x.j AND w.lemma = x.lemmas[x.j + 1]
GROUP BY x.id, x.start"""),
        ("hits", """SELECT st.id, st.start FROM st LEFT JOIN rest r ON r.id = st.id AND r.start = st.start
WHERE len(st.lemmas) = 1 OR r.n = len(st.lemmas) - 1""")])


@register("f4_phrase_hits_name", _f4_sql("SELECT id, doc_id, a AS phrase FROM mentions"))
def q_f4_name(spark, sf_dir):
    c = load_corpus(spark, sf_dir)
    ph = PH.phrase_lemmas(c.spans.select("id", "doc_id", F.col("a").alias("phrase")))
    return PH.hit_summary(ph, PH.phrase_hits(ph, c.words_like(ph)))


@register("f4_phrase_hits_two_words", _f4_sql("""
SELECT t.id, t.doc_id, CASE WHEN w.word IS NULL THEN m.a ELSE m.a || ' ' || w.word END AS phrase
FROM targets t JOIN mentions m ON m.id = t.id
LEFT JOIN words w ON w.doc_id = t.doc_id AND w.wi = t.wi + 1 WHERE t.role = 'A'"""))
def q_f4_two(spark, sf_dir):
    """Phrase = candidate A and the word after it: exercises the multi-word verification."""
    cx = load_context(spark, sf_dir)
    nxt = cx.near_words.select("doc_id", (F.col("wi") - 1).alias("wi"), F.col("word").alias("next_word"))
    t = (cx.targets.where("role = 'A'").join(nxt, ["doc_id", "wi"], "left")
         .join(cx.corpus.spans.select("id", "a"), "id"))
    phrase = F.when(F.col("next_word").isNull(), F.col("a")).otherwise(F.concat_ws(" ", "a", "next_word"))
    ph = PH.phrase_lemmas(t.select("id", "doc_id", phrase.alias("phrase")))
    return PH.hit_summary(ph, PH.phrase_hits(ph, cx.corpus.words_like(ph)))


@register("s1_mention_tsv_roundtrip", with_ctes("""
SELECT id, pronoun, pronoun_offset, a, a_offset, a_coref, b, b_offset, b_coref,
  CAST(length(text) AS INTEGER) AS text_len FROM mentions"""))
def q_s1(spark, sf_dir):
    """Write the mention table as TSV (pandas dialect: quotes, tabs, newlines in text), scan it back."""
    path = scratch_path(spark, "mentions-tsv")
    tsv.write_mentions(load_corpus(spark, sf_dir).mentions, path)
    back = tsv.read_mentions(spark, path, with_url=False)
    return back.select(F.col("id").cast("long").alias("id"), "pronoun", "pronoun_offset", "a", "a_offset",
                       "a_coref", "b", "b_offset", "b_coref", F.length("text").cast("int").alias("text_len"))


@register("s3_s2_prediction_csv_score", with_ctes(
    "SELECT count(*) AS n, avg(loss) AS log_loss FROM ev", R5_SQL + _eval_sql("r5_scores")),
    doubles=["log_loss"])
def q_s3_s2(spark, sf_dir):
    """Write cascade predictions as ID,A,B,NEITHER CSV (S3), read them back (S2) and score."""
    cx = load_context(spark, sf_dir)
    path = scratch_path(spark, "predictions-csv")
    tsv.write_predictions(_r5(cx), path)
    pred = tsv.read_predictions(spark, path).withColumn("id", F.col("id").cast("long"))
    return E.log_loss(E.truth_table(cx.corpus.spans), pred)


@register("p15_name_prompts", with_ctes("""
SELECT s.id, s.scope || chr(10) || 'Q: What''s '
  || CASE WHEN lower(m.pronoun) IN ('she', 'her') THEN 'her' ELSE 'his' END || ' name?' || chr(10) || 'A:' AS prompt
FROM w6 s JOIN mentions m ON m.id = s.id""", [("w6", W6_SQL)]))
def q_p15(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    sc = W.scope_text(cx.targets, cx.near_words, cx.corpus.passages)
    return sc.join(cx.corpus.spans.select("id", "pronoun"), "id").select(
        "id", C.name_prompt("scope", "pronoun").alias("prompt"))


def _stand_in_model():
    """A stand-in for a next-word model, to run the plug-in path: name-shaped words of the prompt by frequency."""
    import collections
    import re
    word = re.compile(r"\w+")

    def predict(prompts):
        out = []
        for p in prompts:
            names = (w for w in word.findall(p) if len(w) > 2 and w[0].isupper() and w[1:].islower() and w.isalpha())
            out.append([(t, float(c)) for t, c in collections.Counter(names).items()])
        return out
    return predict


def _plugin_sql(prompts: str, n: int) -> list[tuple[str, str]]:
    """What the stand-in model makes of the prompts of a table, and R4's rates under it (``rates<n>``)."""
    return [
        (f"said{n}", f"""SELECT id, token, CAST(count(*) AS DOUBLE) AS logit
FROM (SELECT id, unnest(regexp_extract_all(prompt, '[\\p{{L}}\\p{{N}}_]+')) AS token FROM {prompts})
WHERE regexp_full_match(token, '\\p{{Lu}}\\p{{Ll}}{{2,}}') GROUP BY id, token"""),
        (f"top{n}", f"""SELECT id, rank, token, exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY id) AS prob
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logit DESC, token ASC) AS rank,
             max(logit) OVER (PARTITION BY id) AS mx FROM said{n}) WHERE rank <= 5"""),
        (f"match{n}", f"""SELECT t.id, t.role, arg_min(p.prob, p.rank) AS rate
FROM targets t JOIN words w ON w.doc_id = t.doc_id AND w.wi = t.wi JOIN top{n} p ON p.id = t.id
WHERE t.role <> 'P' AND p.prob >= {S.MIN_PREDICTION_PROB} AND starts_with(w.word, p.token) GROUP BY t.id, t.role"""),
        (f"rates{n}", f"""SELECT i.id, coalesce(a.rate, 0.0) AS ra, coalesce(b.rate, 0.0) AS rb
FROM (SELECT DISTINCT id FROM targets) i
LEFT JOIN match{n} a ON a.id = i.id AND a.role = 'A' LEFT JOIN match{n} b ON b.id = i.id AND b.role = 'B'""")]


_QUESTION_SQL = [("w6", W6_SQL), ("asked", """
SELECT s.id, s.scope || chr(10) || 'Q: What''s '
  || CASE WHEN lower(m.pronoun) IN ('she', 'her') THEN 'her' ELSE 'his' END || ' name?' || chr(10) || 'A:' AS prompt
FROM w6 s JOIN mentions m ON m.id = s.id""")] + _plugin_sql("asked", 1)
_BEFORE_SQL = [("w7", W7_SQL), ("continued", """
SELECT s.id, s.scope || chr(10) || b.before AS prompt FROM w6 s JOIN w7 b ON b.id = s.id""")] + _plugin_sql("continued", 2)


def _plugin_predictions(cx, second: bool = False):
    """T2 over the plug-in's candidates after the scope and the question, or the text before the pronoun."""
    sc = W.scope_text(cx.targets, cx.near_words, cx.corpus.passages)
    if second:
        before = W.text_before_pronoun(cx.targets, cx.near_words, cx.corpus.passages)
        prompts = sc.join(before, "id").select("id", F.concat_ws("\n", "scope", "before").alias("prompt"))
    else:
        prompts = sc.join(cx.corpus.spans.select("id", "pronoun"), "id").select(
            "id", C.name_prompt("scope", "pronoun").alias("prompt"))
    return R.top_predictions(R.predict_with_plugin(prompts, _stand_in_model))


@register("k6_plugin_prefix_scores", with_ctes(f"""
SELECT id, CAST(CASE WHEN ra = 0 AND rb = 0 THEN {S.UNDECIDED[0]} ELSE ra / (ra + rb) END AS DOUBLE) AS p_a,
  CAST(CASE WHEN ra = 0 AND rb = 0 THEN {S.UNDECIDED[1]} ELSE rb / (ra + rb) END AS DOUBLE) AS p_b,
  CAST(CASE WHEN ra = 0 AND rb = 0 THEN {S.UNDECIDED[2]} ELSE 0.0 END AS DOUBLE) AS p_neither
FROM rates1""", _QUESTION_SQL), doubles=["p_a", "p_b", "p_neither"])
def q_k6(spark, sf_dir):
    """K6 plug-in: prompts scored in Arrow batches by a model made once in a worker, then T2 + R4."""
    cx = load_context(spark, sf_dir)
    return R.prefix_scores(cx.targets, cx.near_words, _plugin_predictions(cx))


@register("r4_prefix_features_two_prompts", with_ctes("""
SELECT a.id, CAST(a.ra AS DOUBLE) AS a1, CAST(a.rb AS DOUBLE) AS b1, CAST(b.ra AS DOUBLE) AS a2, CAST(b.rb AS DOUBLE) AS b2
FROM rates1 a JOIN rates2 b ON b.id = a.id""", _QUESTION_SQL + _BEFORE_SQL), doubles=["a1", "b1", "a2", "b2"])
def q_r4_features(spark, sf_dir):
    """R4's four features: scope and question, scope and the text before the pronoun."""
    cx = load_context(spark, sf_dir)
    return R.prefix_features(cx.targets, cx.near_words, _plugin_predictions(cx), _plugin_predictions(cx, second=True))


_COUNTS_SQL = ("cnt", f"{_H3_SQL} UNION ALL {_H5_SQL}")


@register("k8_error_listing_cascade", with_ctes("""
SELECT e.id, e.label, e.pred, c.role, c.family,
  array_to_string(list_sort(list(c.feature || ':' || CAST(c.cnt AS VARCHAR))), ' ') AS bag
FROM (SELECT id, label, pred FROM ev WHERE pred <> label ORDER BY id LIMIT 20) e
JOIN cnt c ON c.id = e.id GROUP BY e.id, e.label, e.pred, c.role, c.family""",
                                                   R5_SQL + _eval_sql("r5_scores") + [_COUNTS_SQL]))
def q_k8(spark, sf_dir):
    cx = load_context(spark, sf_dir)
    lst = E.error_listing(E.truth_table(cx.corpus.spans), _r5(cx), M.staged_counts(cx))
    return lst.select("id", "label", "pred", "role", "family", F.array_join("bag", " ").alias("bag"))
