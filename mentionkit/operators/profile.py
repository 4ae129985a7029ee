"""Profiling a mention table: A1-A3, U1, U2 (counts and name cohorts).

A1 is one aggregate (ten conditional counts in one scan, partial aggregation
map-side), not ten passes. Cohorts are ``unionByName`` + ``subtract``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.functions import columns as C


def _count_if(cond: Column, name: str) -> Column:
    return F.sum(cond.cast("long")).alias(name)


def mention_profile(mentions: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """A1: conditional counts over a mention table (optionally per group)."""
    a_after = C.after_pronoun("a_offset")
    b_after = C.after_pronoun("b_offset")
    a, b = F.col("a_coref"), F.col("b_coref")
    nearer = C.a_nearer()
    aggs = [
        F.count(F.lit(1)).alias("mentions"),
        _count_if(a_after, "a_after_pronoun"),
        _count_if(b_after, "b_after_pronoun"),
        _count_if(a, "a_true"),
        _count_if(b, "b_true"),
        _count_if(C.neither(), "neither"),
        _count_if(a & a_after, "a_true_after_pronoun"),
        _count_if(b & b_after, "b_true_after_pronoun"),
        _count_if(nearer & a, "a_nearer_a_true"),
        _count_if(nearer & b, "a_nearer_b_true"),
        _count_if(nearer, "a_nearer"),
    ]
    return mentions.groupBy(*(by or [])).agg(*aggs)


def distinct_values(mentions: DataFrame, columns: list[str] = ("pronoun", "a", "b")) -> DataFrame:
    """A2: distinct values of each listed column as ``(column_name, value)``."""
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return mentions.select(F.explode(values).alias("v")).select("v.column_name", "v.value").distinct()


def true_names(mentions: DataFrame, pronouns: list[str], lower: bool = False) -> DataFrame:
    """Names that are the true answer for the given pronouns (union all of A and B)."""
    m = mentions.where(C.pronoun_in(pronouns, lower=lower))
    return (m.where("a_coref").select(F.col("a").alias("name"))
            .unionByName(m.where("b_coref").select(F.col("b").alias("name"))))


def gender_cohorts(mentions: DataFrame, she: list[str] = S.PROFILE_SHE, he: list[str] = S.PROFILE_HE,
                   lower: bool = False) -> DataFrame:
    """Names seen only with one gender: ``(name, gender)``, gender 'F' or 'M'."""
    per_name = _names_by_gender(mentions, she, he, lower)
    return per_name.where("f <> m").select("name", F.when(F.col("f"), "F").otherwise("M").alias("gender"))


def _names_by_gender(mentions: DataFrame, she: list[str], he: list[str], lower: bool) -> DataFrame:
    """``(name, f, m)``: whether a name is the true answer for a pronoun of the one and of the other gender."""
    f, m = C.pronoun_in(she, lower=lower), C.pronoun_in(he, lower=lower)
    names = mentions.select(f.alias("f"), m.alias("m"), F.explode(F.array(
        F.when(F.col("a_coref"), F.struct(F.col("a").alias("name"))),
        F.when(F.col("b_coref"), F.struct(F.col("b").alias("name"))))).alias("n"))
    return names.where("n is not null and (f or m)").groupBy(F.col("n.name").alias("name")).agg(
        F.max("f").alias("f"), F.max("m").alias("m"))


def cohort_counts(mentions: DataFrame, she: list[str] = S.PROFILE_SHE, he: list[str] = S.PROFILE_HE,
                  lower: bool = False) -> DataFrame:
    """A3: distinct-name counts per cohort and of the gender-exclusive names."""
    per_name = _names_by_gender(mentions, she, he, lower)
    count = lambda condition: F.coalesce(F.sum(F.expr(condition).cast("long")), F.lit(0)).cast("long")
    return per_name.agg(count("f").alias("she_names"), count("m").alias("he_names"),
                        count("f and not m").alias("she_only"), count("m and not f").alias("he_only"))


# ------------------------------------------------------ contrast statistics ---
def pair_blocks(mentions: DataFrame) -> DataFrame:
    """``(id, cand, is_true, block)`` -- true pairs: A-true (vs A), B-true (vs B);
    false pairs: B-true (vs A), A-true (vs B), NEITHER (vs A), NEITHER (vs B)."""
    a, b = F.col("a_coref"), F.col("b_coref")
    nei = C.neither()

    def blk(cond, is_true, block, cand):
        return F.when(cond, F.struct(F.lit(is_true).alias("is_true"), F.lit(block).alias("block"),
                                     F.lit(cand).alias("cand")))

    p = mentions.select("id", F.explode(F.array(
        blk(a, True, 0, "A"), blk(b, True, 1, "B"),
        blk(b, False, 0, "A"), blk(a, False, 1, "B"),
        blk(nei, False, 2, "A"), blk(nei, False, 3, "B"))).alias("p"))
    return p.where(F.col("p").isNotNull()).select("id", "p.cand", "p.is_true", "p.block")


def pair_statistics(pairs: DataFrame, interactions: DataFrame, family: str = "position") -> DataFrame:
    """Per pair ``(id, cand, is_true, block, l1, same)``: L1 of P-C and overlap sum(P*C).

    Starts from the pair list, so a pair whose difference is all zero still counts (0).
    """
    sums = (interactions.where(F.col("family") == family)
            .groupBy("id", "cand").agg(F.sum(F.abs("diff")).alias("l1"), F.sum("prod").alias("same")))
    return pairs.join(sums, ["id", "cand"], "left").select(
        "id", "cand", "is_true", "block",
        F.coalesce("l1", F.lit(0)).cast("long").alias("l1"),
        F.coalesce("same", F.lit(0)).cast("long").alias("same"))


def class_statistics(stats: DataFrame) -> DataFrame:
    """A4 + A5: mean and population variance of L1 and overlap per true / false class."""
    return stats.groupBy("is_true").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("l1").alias("l1_mean"), F.var_pop("l1").alias("l1_var"),
        F.avg("same").alias("same_mean"), F.var_pop("same").alias("same_var"))


def global_ordinal(df: DataFrame, order_cols: list[str], name: str = "ord") -> DataFrame:
    """0-based position of each row in the total order ``order_cols`` without a one-task window.

    Range partitioning sorts the rows across tasks; a row's position is the
    sizes of the earlier partitions plus its index inside its partition. The
    sorted rows are checkpointed to the shared folder so both passes see the
    same partitions. Only the per-partition counts (one row per partition)
    meet in one place.
    """
    from mentionkit.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
         .withColumn("_mid", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    s = s.select("*", F.shiftright("_mid", 33).alias("_pid"),
                 F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_loc"))
    from pyspark.sql import Window
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")      # one row per partition: bounded
            .withColumn(name, (F.col("_off") + F.col("_loc")).cast("long"))
            .drop("_mid", "_pid", "_loc", "_off"))


def zip_true_false(stats: DataFrame) -> DataFrame:
    """J4 + A6: the i-th true pair against the i-th false pair (block order, then id)."""
    t = global_ordinal(stats.where("is_true"), ["block", "id"]).select(
        "ord", F.col("l1").alias("t_l1"), F.col("same").alias("t_same"))
    f = global_ordinal(stats.where("NOT is_true"), ["block", "id"]).select(
        "ord", F.col("l1").alias("f_l1"), F.col("same").alias("f_same"))
    z = t.join(f, "ord")
    return z.agg(F.count(F.lit(1)).alias("pairs_compared"),
                 F.sum((F.col("t_l1") > F.col("f_l1")).cast("long")).alias("true_diff_larger"),
                 F.sum((F.col("t_same") > F.col("f_same")).cast("long")).alias("true_same_larger"))


def feature_contrast(pairs: DataFrame, interactions: DataFrame, vocab: DataFrame,
                     family: str = "position") -> DataFrame:
    """Per class and vocabulary feature: sum |P-C|, sum (P-C)+, sum (P-C)-, sum P*C."""
    x = interactions.where(F.col("family") == family).join(pairs.select("id", "cand", "is_true"),
                                                           ["id", "cand"])
    sums = x.groupBy("is_true", "feature").agg(
        F.sum(F.abs("diff")).alias("abs_diff"), F.sum(C.positive_part("diff")).alias("pos_diff"),
        F.sum(C.negative_part("diff")).alias("neg_diff"), F.sum("prod").alias("same"))
    full = (vocab.select("feature", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_true"))
            .join(sums, ["is_true", "feature"], "left"))
    return full.select("is_true", "feature",
                       *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                         for c in ("abs_diff", "pos_diff", "neg_diff", "same")])


def top_features(contrast: DataFrame, k: int = 10) -> DataFrame:
    """Top-k features per (class, score) by score desc, ties by feature name (the limit is the feature)."""
    from pyspark.sql import Window
    long = contrast.selectExpr(
        "is_true", "feature",
        "stack(4, 'abs_diff', abs_diff, 'pos_diff', pos_diff, 'neg_diff', neg_diff, 'same', same) "
        "as (score_kind, score)")
    w = Window.partitionBy("is_true", "score_kind").orderBy(F.desc("score"), F.asc("feature"))
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("is_true", "score_kind", "rank", "feature", "score"))
