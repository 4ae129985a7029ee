"""Document fingerprints by consistent weighted sampling.

A document is a bag of weighted terms (its words and how often they stand in it). For every sample and
term three numbers are drawn from the term's hash alone: r and c from a Gamma(2, 1) distribution and b
from a uniform one. With weight S, ``t = floor(ln S / r + b)``, ``ln y = r (t - b)``, ``a = c / (y e^r)``; the
sample of a bag is the (term, t) with the smallest ``a``. Two bags have the same sample with a probability
of their generalised Jaccard similarity, sum of the smaller by sum of the larger weights. The
fingerprint is the samples in order, ``DIGITS`` hexadecimal digits of each; the share of equal ones
estimates the similarity (standard error sqrt(J (1 - J) / SAMPLES)).

The draws are arranged so that weight 1, which most terms have, costs one hash and no logarithm. Let p, q
be independent Exp(1) (minus the logarithms of two uniforms ``v`` and ``v2``) and ``u`` another uniform. Then
``c = p + q`` is Gamma(2, 1) and ``s = p / c`` is uniform and independent of it; ``r = -ln u - ln s`` is
Gamma(2, 1) and ``b = ln u / ln(u s)`` uniform and independent of it. It follows that ``a = p (u s)^t``, and that
t is 0 where ``S s < 1``, so always for S = 1, where ``a = -ln v``. What is kept is therefore the largest
``e^-a``, which is ``v`` itself for t = 0.

Everything is DataFrame functions: words are hashed, sorted and counted within their row, so memory is
bounded by one document; the exploded terms go at once into one aggregate of ``SAMPLES`` maxima a document.

Defined results: a null text is empty; a text without words has the empty fingerprint, which is alike
(1) to itself and not (0) to any other. Words are cut at blanks and compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import materialise
from mentionkit.operators.profile import global_ordinal

SAMPLES = 32
DIGITS = 5
ID_BITS, VALUE_BITS = 4 * DIGITS, 63 - 4 * DIGITS
#: Fixed by the contract's words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Odd numbers that keep the draws apart.
_STEP, _LEVEL = 0x9E3779B97F4A7C15 - (1 << 64), 0x5BD1E995


# ------------------------------------------------------------------ terms ---
def words(text: str | Column) -> Column:
    """The words of a text, in order; none for a null or blank one."""
    text = F.col(text) if isinstance(text, str) else text
    own = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, "[ \\t\\n\\x0B\\f\\r]+"))


def word_terms(rows: DataFrame, text: str = "text") -> DataFrame:
    """Every other column of ``rows`` with ``term`` (hash of a word) and ``weight`` (its count), a row a distinct word.

    A text without words gives one row with neither. (The outer explode matters: for a plain one Spark
    infers that the array is not empty and works out the words once more, within the comparison.)
    """
    keys = [c for c in rows.columns if c != text]
    runs = rows.select(*keys, F.sort_array(F.transform(words(text), lambda w: F.xxhash64(w))).alias("__w"))
    first = F.filter(F.sequence(F.lit(0), F.size("__w") - 1),
                     lambda i: (i == 0) | (F.get("__w", i) != F.get("__w", i - 1)))
    runs = runs.withColumn("__s", F.when(F.size("__w") > 0, first))
    each = runs.select(*keys, "__w", "__s", F.posexplode_outer("__s").alias("__j", "__at"))
    ends = F.coalesce(F.get("__s", F.col("__j") + 1), F.size("__w"))
    return each.select(*keys, F.get("__w", F.col("__at")).alias("term"), (ends - F.col("__at")).alias("weight"))


# ------------------------------------------------------------- signatures ---
def _draw(term: Column, number: int) -> Column:
    """The number-th hash of a term."""
    return F.xxhash64(term.bitwiseXOR(F.lit(((number + 1) * _STEP + (1 << 63)) % (1 << 64) - (1 << 63))))


def _uniform(bits: Column) -> Column:
    """Between 0 and 1, ends excluded, from the upper bits of a hash."""
    return (F.shiftrightunsigned(bits, 64 - VALUE_BITS).cast("double") + 0.5) * F.lit(2.0 ** -VALUE_BITS)


def sample(number: int, term: Column, weight: Column) -> Column:
    """A term's rank in a sample and, in the lower bits, who it is; the bag's sample is the largest."""
    def packed(rank: Column, level: Column) -> Column:
        who = term.bitwiseAND(mask) + level.bitwiseAND(mask) * F.lit(_LEVEL)
        return F.shiftleft(rank, ID_BITS).bitwiseOR(who.bitwiseAND(mask))

    mask = F.lit((1 << ID_BITS) - 1)
    bits = _draw(term, 3 * number)
    p, q = -F.ln(_uniform(bits)), -F.ln(_uniform(_draw(term, 3 * number + 1)))
    s = p / (p + q)
    ln_u, r = F.ln(_uniform(_draw(term, 3 * number + 2))), -F.ln(_uniform(_draw(term, 3 * number + 2)) * s)
    t = F.floor((F.ln(weight) - ln_u) / r)
    above = F.floor(F.exp(-p * F.exp(-r * t)) * F.lit(2.0 ** VALUE_BITS))
    plain = packed(F.shiftrightunsigned(bits, 64 - VALUE_BITS), F.lit(0).cast("long"))
    # for weights below 1 the level is negative: the general form
    return F.when((weight == 1) | ((weight > 1) & (weight * s < 1)), plain).otherwise(
        packed(F.least(above, F.lit((1 << VALUE_BITS) - 1)), t))


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fingerprint`` of every bag of ``terms`` (``keys``, ``term`` long, ``weight`` above 0).

    Rows without term add nothing; a bag of nothing else has the empty fingerprint.
    """
    best = terms.groupBy(*keys).agg(*(F.max(sample(k, F.col("term"), F.col("weight"))).alias(f"__{k}") for k in range(samples)))
    digits = [F.lpad(F.lower(F.hex(F.col(f"__{k}").bitwiseAND(F.lit((1 << ID_BITS) - 1)))), DIGITS, "0") for k in range(samples)]
    return best.select(*keys, F.coalesce(F.concat(*digits), F.lit("")).alias("fingerprint"))


def likeness(a: str | Column, b: str | Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    equal = sum(((F.substring(a, DIGITS * k + 1, DIGITS) == F.substring(b, DIGITS * k + 1, DIGITS)).cast("int")
                 for k in range(samples)), F.lit(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(equal / F.lit(float(samples)))


# -------------------------------------------------------- edited documents ---
def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document.

    A document's edit: its last third is replaced by the beginning of the next document, in descending
    order of ``doc_id`` (those without id at the end, texts of one id by their hash; after the last the
    first). The order is found on keys alone. A text is shuffled once, to its own key, and the part that
    its predecessor takes of it once more.

    Defined results: rows that repeat id and text are one document, whose row is repeated as often;
    the only document is its own next one; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").isNull().alias("z"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("g"),
                      F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n"), text.alias("text"))
    key, after = ["z", "g", "h", "n"], ["az", "ag", "ah", "an"]
    order = materialise(global_ordinal(own.groupBy(*key).agg(F.count("*").alias("copies")), [F.col("z"), F.col("g").desc(), F.col("h"), F.col("n")]), "order")
    total = order.count()
    following = order.select(*(F.col(k).alias(a) for k, a in zip(key, after)), F.pmod(F.col("ord") - 1, F.lit(max(1, total))).alias("ord"))
    pairs = materialise(order.join(following, "ord").drop("ord"), "next")  # copies: of the document, not of the next

    texts = own.groupBy(*key).agg(F.max("text").alias("text"))  # the same columns wherever it is read: one exchange
    gifts = texts.select(*(F.col(k).alias(a) for k, a in zip(key, after)), "text").join(pairs, after).select(
        *key, F.substring(F.col("text"), F.lit(1), F.floor(F.col("n") / 3).cast("int")).alias("gift"))
    both = texts.join(gifts, key).withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int")), F.col("gift")))
    sides = both.select(*key, F.posexplode(F.array("text", "edited")).alias("side", "text"))
    prints = signatures(word_terms(sides), [*key, "side"], samples).groupBy(*key).agg(
        *(F.max(F.when(F.col("side") == i, F.col("fingerprint"))).alias(c) for i, c in enumerate(("own", "other"))))
    found = materialise(both.select(*key, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")).join(
        prints, key).select(*key, "edited_sha256", F.col("own").alias("fingerprint"),
                            F.col("other").alias("edited_fingerprint")), "fingerprints")
    beside = found.select(*(F.col(k).alias(a) for k, a in zip(key, after)), F.col("fingerprint").alias("next_fingerprint")).join(
        pairs, after).select(*key, "copies", "next_fingerprint")
    return found.join(beside, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.when(~F.col("z"), F.col("g")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint",
        "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", samples).alias("near_next"))
