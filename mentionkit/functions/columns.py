"""Scalar column functions (P1-P20): pure JVM expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mentionkit import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# P1 -------------------------------------------------------------------------
def after_pronoun(cand_offset="a_offset", pronoun_offset="pronoun_offset") -> Column:
    """Candidate after the pronoun: ``cand_offset > pronoun_offset``."""
    return _c(cand_offset) > _c(pronoun_offset)


# P2 -------------------------------------------------------------------------
def signed_distance(cand_offset="a_offset", pronoun_offset="pronoun_offset") -> Column:
    """``pronoun_offset - cand_offset``."""
    return _c(pronoun_offset) - _c(cand_offset)


# P3 -------------------------------------------------------------------------
def a_nearer() -> Column:
    return F.abs(signed_distance("a_offset")) < F.abs(signed_distance("b_offset"))


# P4 -------------------------------------------------------------------------
def neither(a="a_coref", b="b_coref") -> Column:
    return ~(_c(a) | _c(b))


# P6 -------------------------------------------------------------------------
def pronoun_in(values: list[str], col="pronoun", lower: bool = False) -> Column:
    c = F.lower(_c(col)) if lower else _c(col)
    return c.isin(*values)


# P7 -------------------------------------------------------------------------
def class_label(a="a_coref", b="b_coref") -> Column:
    """0 = A, 1 = B, 2 = NEITHER; B wins when both are true."""
    return F.when(_c(b), 1).when(_c(a), 0).otherwise(2).cast("int")


# P8 -------------------------------------------------------------------------
def gender_flag(col="pronoun", feminine: list[str] = S.GENDER_FEMININE) -> Column:
    """0 when the lower-cased pronoun is feminine, else 1."""
    return F.when(F.lower(_c(col)).isin(*feminine), 0).otherwise(1).cast("int")


# P9 -------------------------------------------------------------------------
def pair_labels_expr() -> str:
    """Unpivot (A first, then B) of the per-candidate binary labels."""
    return "stack(2, 'A', a, a_offset, cast(a_coref as int), 'B', b, b_offset, cast(b_coref as int)) " \
           "as (cand, cand_text, cand_offset, label)"


# P10 ------------------------------------------------------------------------
def truth_onehot(a="a_coref", b="b_coref") -> list[Column]:
    return [_c(a).cast("double").alias("y_a"), _c(b).cast("double").alias("y_b"),
            neither(a, b).cast("double").alias("y_n")]


# P11 ------------------------------------------------------------------------
def _strip(x) -> Column:
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def first_token(x) -> Column:
    """First whitespace-separated token of a span."""
    return F.split(_strip(x), r"\s+").getItem(0)


def token_count(x) -> Column:
    """Number of whitespace-separated tokens of a span (0 for a blank span)."""
    s = _strip(x)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+"))).cast("int")


# P12 ------------------------------------------------------------------------
def tag_of(kind: str = "UPOS", prefix: str = "") -> Column:
    """Tag selector: XPOS without ``$``, UPOS, or the deprel before ``:``."""
    kind = kind.upper()
    if kind == "XPOS":
        return F.replace(F.col(prefix + "xpos"), F.lit("$"), F.lit(""))
    if kind == "UPOS":
        return F.col(prefix + "upos")
    if kind == "DEPENDENCY":
        return F.split(F.col(prefix + "deprel"), ":").getItem(0)
    raise ValueError(kind)


def deprel_head(col="deprel") -> Column:
    return F.split(_c(col), ":").getItem(0)


# P13 ------------------------------------------------------------------------
def strip_backticks(x) -> Column:
    return F.replace(_c(x), F.lit("`"), F.lit(""))


# P14 ------------------------------------------------------------------------
def is_possessive(xpos="xpos") -> Column:
    return F.coalesce(_c(xpos) == "PRP$", F.lit(False))


# P15 ------------------------------------------------------------------------
def prompt_pronoun(pronoun_word="pronoun") -> Column:
    return F.when(F.lower(_c(pronoun_word)).isin(*S.GENDER_FEMININE), "her").otherwise("his")


def name_prompt(scope_text, pronoun_word="pronoun") -> Column:
    return F.concat(_c(scope_text), F.lit("\nQ: What's "), prompt_pronoun(pronoun_word),
                    F.lit(" name?\nA:"))


# P16 ------------------------------------------------------------------------
def detokenize(words_array) -> Column:
    """Join words by a space, drop the space before a non-word char, re-join n't."""
    s = F.array_join(_c(words_array), " ")
    s = F.regexp_replace(s, r" ([^\p{L}\p{N}_])", "$1")
    return F.regexp_replace(s, " n't", "n't")


# P17 ------------------------------------------------------------------------
BLANK_CLASS = r"[ \t\r\n]"


def nonblank_before(text="text", offset="a_offset", blank: str = BLANK_CLASS) -> Column:
    """Characters before ``offset`` that are not blank."""
    return F.length(F.regexp_replace(F.substr(_c(text), F.lit(1), _c(offset)), blank, "")).cast("int")


def nonblank_length(x, blank: str = BLANK_CLASS) -> Column:
    return F.length(F.regexp_replace(_c(x), blank, "")).cast("int")


def piece_length(piece) -> Column:
    """Length of a word piece without its continuation prefix ``##``."""
    return F.length(F.regexp_replace(_c(piece), "^##", "")).cast("int")


# P18 ------------------------------------------------------------------------
def positive_part(x) -> Column:
    return F.greatest(_c(x), F.lit(0))


def negative_part(x) -> Column:
    return F.greatest(-_c(x), F.lit(0))


# P19 ------------------------------------------------------------------------
def argmax3(a="p_a", b="p_b", n="p_neither") -> Column:
    """Index of the largest of three; the first maximum wins."""
    a, b, n = _c(a), _c(b), _c(n)
    return F.when((a >= b) & (a >= n), 0).when(b >= n, 1).otherwise(2).cast("int")


# P20 ------------------------------------------------------------------------
def normalise3(a="p_a", b="p_b", n="p_neither") -> list[Column]:
    a, b, n = _c(a), _c(b), _c(n)
    total = a + b + n
    return [F.try_divide(a, total).alias("p_a"), F.try_divide(b, total).alias("p_b"),
            F.try_divide(n, total).alias("p_neither")]
