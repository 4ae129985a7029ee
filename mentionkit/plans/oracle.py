"""DuckDB SQL twins of the Spark plans (the correctness oracle).

Each registered query's SQL is ``WITH <shared CTEs> SELECT ...``; the shared
CTEs derive tokens, words, mentions and targets from the ``documents`` view
with the same integer rules as the Spark plans.
"""

from __future__ import annotations

import re

from mentionkit import schema as S


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _arr(values) -> str:
    return "[" + _list(values) + "]"


ANCHORS = _list(S.ANCHORS_F + S.ANCHORS_M)
ENDS = _list(S.SENTENCE_END)
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

_XPOS_CASE = "CASE upos " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in S.XPOS_BY_UPOS.items()) + " END"

CTES: list[tuple[str, str]] = [
    ("tok", f"""
SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos
FROM (SELECT doc_id, regexp_extract_all(text, '{S.TOKEN_PATTERN}') AS toks FROM documents)"""),
    ("tok2", f"""
SELECT doc_id, pos, tok AS word, NOT regexp_matches(tok, '{S.BLANK_START}') AS is_word,
  CAST(coalesce(sum(length(tok)) OVER wb, 0) AS INTEGER) AS o,
  CAST(coalesce(sum(length(tok)) OVER wb, 0)
       - coalesce(lag(CASE WHEN regexp_matches(tok, '{S.BLANK_START}') THEN length(tok) END) OVER w, 0)
       AS INTEGER) AS lo,
  CAST(coalesce(sum(CASE WHEN NOT regexp_matches(tok, '{S.BLANK_START}') THEN length(tok) END) OVER wb, 0)
       AS INTEGER) AS nb,
  CAST(coalesce(sum(CASE WHEN NOT regexp_matches(tok, '{S.BLANK_START}') THEN 1 ELSE 0 END) OVER wb, 0)
       AS INTEGER) AS wi,
  CAST(coalesce(sum(CASE WHEN tok IN ({ENDS}) THEN 1 ELSE 0 END) OVER wb, 0) AS INTEGER) AS sent
FROM tok
WINDOW w AS (PARTITION BY doc_id ORDER BY pos), wb AS (PARTITION BY doc_id ORDER BY pos {BEFORE})"""),
    ("words0", f"""
SELECT doc_id, wi, sent,
  CAST(wi - coalesce(max(CASE WHEN word IN ({ENDS}) THEN wi END)
       OVER (PARTITION BY doc_id ORDER BY pos {BEFORE}), -1) AS INTEGER) AS idx,
  o, lo, nb, word
FROM tok2 WHERE is_word"""),
    ("words1", f"""
SELECT doc_id, wi, sent, idx, o, lo, nb, word, lower(word) AS lemma,
  CASE WHEN lower(word) IN ({ANCHORS}) THEN 'PRON'
       WHEN regexp_matches(word, '{S.NUM_PATTERN}') THEN 'NUM'
       WHEN length(word) = 1 AND regexp_matches(word, '{S.PUNCT_PATTERN}') THEN 'PUNCT'
       WHEN regexp_matches(word, '{S.NAME_PATTERN}') THEN 'PROPN'
       ELSE ['NOUN', 'VERB', 'ADJ'][length(word) % 3 + 1] END AS upos,
  CAST(idx // 2 AS INTEGER) AS governor
FROM words0"""),
    ("words", f"""
SELECT doc_id, wi, sent, idx, o, lo, nb, word, lemma, upos,
  CASE WHEN lemma IN ({_list(S.POSSESSIVE)}) THEN 'PRP$' ELSE {_XPOS_CASE} END AS xpos,
  governor,
  CASE WHEN governor = 0 THEN 'root' ELSE {_arr(S.DEPREL_BY_IDX_MOD5)}[idx % 5 + 1] END AS deprel
FROM words1"""),
    ("anchors", f"""
SELECT doc_id, o, word, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS k,
  count(*) OVER (PARTITION BY doc_id) AS m
FROM words WHERE lemma IN ({ANCHORS})"""),
    ("names", f"""
SELECT * FROM (
  SELECT doc_id, word, first_o, row_number() OVER (PARTITION BY doc_id ORDER BY first_o) - 1 AS k,
    count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, word, min(o) AS first_o FROM words
        WHERE regexp_matches(word, '{S.NAME_PATTERN}') GROUP BY doc_id, word)) WHERE n >= 2"""),
    ("mentions", """
SELECT p.doc_id AS id, p.doc_id, d.text, p.word AS pronoun, CAST(p.o AS INTEGER) AS pronoun_offset,
  a.word AS a, CAST(a.first_o AS INTEGER) AS a_offset, (7 * p.doc_id + 3) % 5 < 2 AS a_coref,
  b.word AS b, CAST(b.first_o AS INTEGER) AS b_offset, (7 * p.doc_id + 3) % 5 IN (2, 3) AS b_coref
FROM anchors p
JOIN names a ON a.doc_id = p.doc_id AND a.k = p.doc_id % a.n
JOIN names b ON b.doc_id = p.doc_id AND b.k = (p.doc_id + 1 + p.doc_id % (b.n - 1)) % b.n
JOIN documents d ON d.doc_id = p.doc_id
WHERE p.k = p.doc_id % p.m"""),
]

_registry: dict[str, str] = dict(CTES)
_order: list[str] = [n for n, _ in CTES]


def add_cte(name: str, sql: str) -> None:
    """Register a further shared CTE (kept in definition order)."""
    if name in _registry:
        _registry[name] = sql
        return
    _registry[name] = sql
    _order.append(name)


def with_ctes(final_select: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``final_select`` behind the shared and ``extra`` tables that it needs, each computed once."""
    tables = [(n, _registry[n].strip()) for n in _order] + [(n, sql.strip()) for n, sql in (extra or [])]
    needed, text = [], final_select
    for name, sql in reversed(tables):
        if re.search(rf"\b{name}\b", text):
            needed.append(f"{name} AS MATERIALIZED ({sql})")
            text += "\n" + sql
    return "WITH " + ",\n".join(reversed(needed)) + "\n" + final_select.strip()
