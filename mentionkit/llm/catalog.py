"""Registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit.llm import decontaminate as dec
from mentionkit.llm import centroids, chat, lm, negatives, packing, quality, repetition, secrets, simhash, tokens, toxicity, weighted
from mentionkit.llm.common import crc_fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return put


def _lower_sql(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP6_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower_sql('text')}, '{_ALNUM}') AS w FROM documents),
b AS MATERIALIZED (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_lower_sql('text')}, '{_ALNUM}') AS w FROM benchmark),
item_windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least({dec.WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({dec.WINDOW}, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({dec.WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS MATERIALIZED (
  SELECT rid, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
words_hit AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid),
items_hit AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rid, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (rid) LEFT JOIN items_hit USING (rid)"""


@query("op6_decontaminate", OP6_SQL)
def op6(spark, sf_dir):
    """Benchmark decontamination: hit words and items of every document."""
    found = dec.overlaps(read(spark, sf_dir, "documents", "doc_id", "text"),
                         read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_simhash_near_duplicates")
def op4(spark, sf_dir):
    """SimHash near-duplicates: every document's fingerprint and group."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_secret_scan")
def op8(spark, sf_dir):
    """Secret scan: base spans of every document and the spans that ownership counts add (owner: source)."""
    found = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "source", "text"), repo=secrets.distinct_text())
    n = {k: F.size(secrets.of_kind("spans", k)).cast("long").alias(f"n_{k}") for k in [*secrets.KINDS, secrets.OWNED]}
    return found.select(
        "doc_id", *(n[k] for k in secrets.KINDS),
        F.sha2(secrets.joined(secrets.of_kind("spans", *secrets.KINDS)).cast("binary"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"), n[secrets.OWNED],
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"))


def _scored(docs: DataFrame, model, kind, folds: int, held: int) -> DataFrame:
    out = kind.with_score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_quality")
def op5(spark, sf_dir):
    """Quality score of every document; folds 0 and 2 of 3 are learnt from."""
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality")
    return _scored(docs, quality.fit(docs, labels, crc_fold("doc_id", 3) != 1), quality, 3, 1)


@query("op7_toxicity")
def op7(spark, sf_dir):
    """Toxicity score of every document; folds 1 to 4 of 5 are learnt from."""
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic")
    return _scored(docs, toxicity.fit(docs, labels, crc_fold("doc_id", 5) != 0), toxicity, 5, 0)


@query("op1_token_counts")
def op1(spark, sf_dir):
    """Tokens of every document by field (source, lang) and line of its text; crossing tokens go to the larger part."""
    docs = tokens.with_fields_and_lines(read(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"),
                                        ["source", "lang"])
    return tokens.token_counts(docs, tokens.broadcast_vocabulary(spark)).withColumn(
        "tokens", F.col("tokens").cast("long"))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    """Every document's tokens, with one end-of-document token each, packed into training sequences."""
    docs = tokens.lengths(read(spark, sf_dir, "documents", "doc_id", "text"), tokens.broadcast_vocabulary(spark))
    return packing.pack_documents(docs.select("doc_id", (F.col("length") + 1).alias("length")))


def _safe_sql(column: str) -> str:
    return f"replace({column}, '<|', '< |')"


OP3_SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '{chat.UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations),
logged AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM turns GROUP BY conv_id),
alone AS MATERIALIZED (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM logged GROUP BY turns)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies,
  array_to_string(list_transform(turns, lambda t: '{chat.START}' || {_safe_sql('t.role')} || chr(10) || {_safe_sql('t.text')}
    || '{chat.END.strip()}' || chr(10)), '') AS rendered
FROM alone AS a
WHERE NOT EXISTS (SELECT 1 FROM alone AS b WHERE len(b.turns) > len(a.turns) AND b.turns[1 : len(a.turns)] = a.turns)"""


@query("op3_chat_format", OP3_SQL)
def op3(spark, sf_dir):
    """Maximal conversations, rendered."""
    return chat.render(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


_WORD = r"[^\x20\x09-\x0D]+"


def _repeated_sql(n: int, of: str = "d") -> str:
    """Places of the n-word windows that stand twice or more in their text."""
    return f"""SELECT rid, unnest(places) AS i FROM (
    SELECT rid, list(i) AS places FROM (SELECT rid, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {of} WHERE len(w) >= {n})
    GROUP BY rid, array_to_string(w[i : i + {n} - 1], ' ')) WHERE len(places) > 1"""


def _covered_sql(n: int, of: str = "d") -> str:
    return (f"SELECT rid, count(DISTINCT j) AS words FROM (SELECT rid, unnest(range(i, i + {n})) AS j "
            f"FROM ({_repeated_sql(n, of)})) GROUP BY rid")


#: A repeat of n words or more covers what the repeated n-word windows cover.
OP10_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
five AS MATERIALIZED ({_covered_sql(repetition.REPEAT_WINDOW)}),
again AS MATERIALIZED (SELECT rid, w FROM d WHERE rid IN (SELECT rid FROM five)),
spans AS ({_covered_sql(repetition.LEAST_REPEAT, "again")}),
long AS (SELECT DISTINCT rid, true AS too_long FROM ({_repeated_sql(repetition.MAX_REPEAT + 1, "again")})),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(five.words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(spans.words, 0) AS BIGINT) AS n_covered_words,
    coalesce(too_long, false) AS too_long
  FROM d LEFT JOIN five USING (rid) LEFT JOIN spans USING (rid) LEFT JOIN long USING (rid)),
ruled AS (
  SELECT *, n_words < {repetition.MIN_WORDS}
    OR 100 * n_repeat_words > {repetition.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR too_long OR 100 * n_covered_words > {repetition.MAX_COVERED_PERCENT} * n_words) AS kept, n_covered_words
FROM ruled"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark, sf_dir):
    """Quality rules of every document: simple counts and the suffix array's verdict."""
    return repetition.repetition(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_covered_words")


@query("op9_language_model")
def op9(spark, sf_dir):
    """Suffix-tree language model: every text's unigram and model log10 probability; fold 0 of 10 is held out."""
    return lm.score(read(spark, sf_dir, "documents", "doc_id", "text"), crc_fold("doc_id", 10) != 0)


@query("op11_fingerprints")
def op11(spark, sf_dir):
    """Consistent weighted sampling: every document's fingerprint, its edited text's, and how alike they are."""
    return weighted.edited_fingerprints(read(spark, sf_dir, "documents", "doc_id", "text"))


def _op12_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Rounds as a chain of tables. ``m`` holds a centroid a row, ``a{i}`` the nearest centroid of every vector."""
    def nearest(of: str) -> str:
        return f"""SELECT rid, vec_id, x, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT v.rid, v.vec_id, v.x, m.c, list_sum(list_transform(range(1, {dims + 1}), lambda j: (v.x[j] - m.x[j]) * (v.x[j] - m.x[j]))) AS d
    FROM v, {of} AS m) GROUP BY rid, vec_id, x"""

    steps = [f"""WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id, x) AS rid, * FROM kept),
m0 AS MATERIALIZED (SELECT rid - 1 AS c, x FROM v WHERE rid <= {k})"""]
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({nearest(f"m{i}")}),
s{i} AS (SELECT cluster AS c, list(t ORDER BY j) AS x FROM (
    SELECT cluster, j, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS t
    FROM (SELECT cluster, unnest(x) AS e, unnest(range({dims})) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster),
m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(s.x, m.x) AS x FROM m{i} AS m LEFT JOIN s{i} AS s USING (c))""")
    return ",\n".join(steps) + f""",
done AS MATERIALIZED ({nearest(f"m{rounds}")})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM done JOIN m{rounds} AS m ON m.c = done.cluster"""


@query("op12_centroids", _op12_sql())
def op12(spark, sf_dir):
    """Integer k-means of the embeddings, centroids filtered by their places over a simplex of pivots."""
    assigned, found = centroids.cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return centroids.with_inertia(assigned, found)


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda j: a.x[j] * b.x[j])) AS score
  FROM v AS a, v AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id,
  CAST(positive_score AS BIGINT) AS positive_score, CAST(score AS BIGINT) AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    """Hard negatives of every hundredth embedding; every seventh row's label moves on by one first."""
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved))
