"""Spark ML jobs: feature assembly (H7, H8), K1-K4, S5, U3 and the split rule.

Features are assembled from the long-form counts: each (row, block)
entry gets a fixed vector index (vocabulary index + block offset), the entries
of a row are gathered (bounded: one window / tree bag per target), laid out by
numpy and turned into a vector with ``array_to_vector``. Models are Spark ML estimators;
fitting runs as Spark jobs and the driver holds only parameters and metrics.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.functions import columns as C
from mentionkit.operators import boosting as BO
from mentionkit.operators import evaluate as E
from mentionkit.operators import ranker as RK
from mentionkit.operators import scorers as R
from mentionkit.operators import search as SE
from mentionkit.operators import tree as TR
from mentionkit.operators import vectorize as V
from mentionkit.operators import windows as W

FAMILIES = ["position", "dependency"]


def split_of(id_col="id") -> F.Column:
    """Deterministic split: train / validation / test by ``id mod 5`` (3 / 1 / 1); other ids by their hash."""
    own = F.col(id_col).cast("string")
    r = F.pmod(F.coalesce(own.try_cast("bigint"), F.xxhash64(own)), F.lit(5))
    return F.when(r < 3, "train").when(r == 3, "validation").otherwise("test")


def long_counts(targets: DataFrame, words: DataFrame, window: int = S.DEFAULT_WINDOW) -> DataFrame:
    """H3 positional + H5 dependency counts ``(id, role, family, feature, cnt)``."""
    pos = V.count_features(W.positional_window(targets, words, window), "position")
    dep = TR.dependency_bag(targets, words).select(
        "id", "role", F.concat_ws("_", "tag", "relation").alias("feature"))
    return pos.unionByName(V.count_features(dep, "dependency"))


def staged_counts(cx) -> DataFrame:
    """The canonical long ``features`` table of a corpus context, staged once."""
    from mentionkit.sources.staging import staged
    return staged(cx.targets.sparkSession, "features", cx.key, lambda: long_counts(cx.targets, cx.near_words),
                  sort_by=["id", "role"])


def _vocab_index(spark) -> tuple[DataFrame, dict[str, int]]:
    rows, sizes = [], {}
    for fam in FAMILIES:
        terms = V.vocabulary(fam)
        sizes[fam] = len(terms)
        rows += [(fam, t, i) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "family string, feature string, fi int"), sizes


#: Gathered rows that a task hands on at a time.
GATHERED = 1024


def _gathered(entries: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Gather ``(keys..., idx, val)`` entries into an array ``values`` of ``size`` numbers.

    The gather is bounded per row (one window / tree bag per target). Where a row has several entries of
    one place they stand one after the other, by their values, and what comes after moves on.
    """
    g = entries.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("idx").cast("int").alias("i"), F.col("val").cast("double").alias("v"))).alias("e"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, GATHERED):
                batch = whole.slice(begin, GATHERED)
                row = np.repeat(np.arange(batch.num_rows), batch["e"].value_lengths().to_numpy())
                e = batch["e"].flatten()
                i, null = e.field("i").to_numpy(), e.field("v").is_null().to_numpy(zero_copy_only=False)
                v = np.where(null, -np.inf, e.field("v").to_numpy(zero_copy_only=False))
                order = np.lexsort((v, i, row))
                row, i, v, null = row[order], i[order].astype(np.int64), v[order], null[order]
                again = np.zeros(len(row), np.int64)
                again[1:] = (row[1:] == row[:-1]) & (i[1:] == i[:-1])
                longer = np.bincount(row, again, minlength=batch.num_rows).astype(np.int64)
                ends = (size + longer).cumsum()
                at = row * size + i + again.cumsum()        # all that earlier rows have more is before it, too
                values, none = np.zeros(ends[-1]), np.zeros(ends[-1], bool)
                values[at], none[at] = np.where(null, 0.0, v), null
                yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.ListArray.from_arrays(
                    pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values, mask=none if none.any() else None))], names=[*keys, "values"])

    kinds = ", ".join(f"`{k}` {g.schema[k].dataType.simpleString()}" for k in keys)
    return g.mapInArrow(place, f"{kinds}, values array<double>")


def _dense(entries: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The gathered entries as an ML vector ``features``."""
    return _gathered(entries, keys, size).select(*keys, array_to_vector("values").alias("features"))


def vector_width(pooled: DataFrame) -> int:
    """Dimensions of the pooled vectors (one number)."""
    return pooled.agg(F.max(F.size("vec"))).first()[0] or 0


def role_vectors(pooled: DataFrame, width: int) -> DataFrame:
    """``(id, p, a, b)``: the pooled vector (A16) of each role; zeros for a role without pieces."""
    by = pooled.groupBy("id").agg(*(F.max(F.when(F.col("role") == r, F.col("vec"))).alias(r.lower()) for r in "PAB"))
    return by.select("id", *(F.coalesce(r, F.array_repeat(F.lit(0.0), width)).alias(r) for r in "pab"))


def pair_vector_block(pooled: DataFrame, width: int) -> DataFrame:
    """``(id, cand, block)``: the dense block p, c, p * c of each candidate, as one array."""
    own = role_vectors(pooled, width)
    block = lambda c: F.concat("p", c, F.zip_with("p", c, lambda x, y: x * y))
    return own.select("id", F.explode(F.array(*(F.struct(F.lit(r).alias("cand"), block(r.lower()).alias("block"))
                                                for r in "AB"))).alias("e")).select("id", "e.cand", "e.block")


def mention_vector_block(pooled: DataFrame, cosines: DataFrame, width: int) -> DataFrame:
    """``(id, block)``: the dense block P, A, B and the two cosines (R8; 0 where there is none), as one array."""
    both = role_vectors(pooled, width).join(cosines, "id", "full_outer")
    zeros = F.array_repeat(F.lit(0.0), width)
    return both.select("id", F.concat(*(F.coalesce(r, zeros) for r in "pab"), F.array(
        *(F.coalesce(c, F.lit(0.0)) for c in ("cos_pa", "cos_pb")))).alias("block"))


def _with_block(gathered: DataFrame, block: DataFrame | None, keys: list[str], size: int) -> DataFrame:
    """The count values and, after them, the dense block of the same row (zeros where it has none)."""
    if block is None:
        return gathered.select(*keys, array_to_vector("values").alias("features"))
    whole = F.concat("values", F.coalesce("block", F.array_repeat(F.lit(0.0), size)))
    return gathered.join(block, keys, "left").select(*keys, array_to_vector(whole).alias("features"))


@dataclass
class Layout:
    offsets: dict[tuple[str, str], int]
    size: int


def _layout(sizes: dict[str, int], blocks: list[str], scalars: int) -> Layout:
    off, o = {}, 0
    for blk in blocks:
        for fam in FAMILIES:
            off[(fam, blk)] = o
            o += sizes[fam]
    return Layout(off, o + scalars)


PAIR_BLOCKS, MENTION_BLOCKS = ["p", "c", "diff", "prod"], ["diff_a", "diff_b", "prod_a", "prod_b"]
#: Scalars after the count blocks of the two tables.
PAIR_SCALARS, MENTION_SCALARS = 2, 13


def count_layout(blocks: list[str], scalars: int) -> Layout:
    """Where the count blocks of H8 (``PAIR_BLOCKS``) or H7 (``MENTION_BLOCKS``) lie."""
    return _layout({fam: len(V.vocabulary(fam)) for fam in FAMILIES}, blocks, scalars)


def pair_features(mentions: DataFrame, counts: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """H8 / pairwise table ``(id, cand, label, split, features)``: P block, candidate
    block, P-C and P*C per family, gender flag and signed offset distance; with ``pooled``
    (A16: ``id, role, vec``) then the dense block p, c, p * c, which is never exploded."""
    spark = mentions.sparkSession
    vocab, _ = _vocab_index(spark)
    lay = count_layout(PAIR_BLOCKS, PAIR_SCALARS)
    off = spark.createDataFrame([(f, b, o) for (f, b), o in lay.offsets.items()], "family string, blk string, base int")
    cv = counts.join(F.broadcast(vocab), ["family", "feature"])          # fixed-size dimension
    cands = F.explode(F.array(F.lit("A"), F.lit("B")))
    p_ent = cv.where("role = 'P'").select("id", cands.alias("cand"), "family", "fi",
                                          F.lit("p").alias("blk"), F.col("cnt").alias("val"))
    c_ent = cv.where("role <> 'P'").select("id", F.col("role").alias("cand"), "family", "fi",
                                           F.lit("c").alias("blk"), F.col("cnt").alias("val"))
    inter = V.pair_interactions(counts).join(F.broadcast(vocab), ["family", "feature"])
    d_ent = inter.where("diff <> 0").select("id", "cand", "family", "fi", F.lit("diff").alias("blk"),
                                            F.col("diff").alias("val"))
    x_ent = inter.where("prod <> 0").select("id", "cand", "family", "fi", F.lit("prod").alias("blk"),
                                            F.col("prod").alias("val"))
    ent = (p_ent.unionByName(c_ent).unionByName(d_ent).unionByName(x_ent)
           .join(F.broadcast(off), ["family", "blk"])
           .select("id", "cand", (F.col("base") + F.col("fi")).alias("idx"), "val"))
    pairs = mentions.selectExpr("id", "pronoun", "pronoun_offset", C.pair_labels_expr())
    scal = pairs.select("id", "cand", F.explode(F.array(
        F.struct(F.lit(lay.size - 2).alias("idx"), C.gender_flag().cast("double").alias("val")),
        F.struct(F.lit(lay.size - 1).alias("idx"),
                 (F.col("pronoun_offset") - F.col("cand_offset")).cast("double").alias("val")))).alias("e")
    ).select("id", "cand", "e.idx", "e.val")
    width = vector_width(pooled) if pooled is not None else 0
    vec = _with_block(_gathered(ent.unionByName(scal), ["id", "cand"], lay.size),
                      None if pooled is None else pair_vector_block(pooled, width), ["id", "cand"], 3 * width)
    return (pairs.select("id", "cand", F.col("label").cast("double").alias("label"), split_of().alias("split"))
            .join(vec, ["id", "cand"]))


def mention_features(mentions: DataFrame, counts: DataFrame, relational: DataFrame, pooled: DataFrame | None = None,
                     cosines: DataFrame | None = None) -> DataFrame:
    """H7 / 3-class table ``(id, label, split, features)``: P-A, P-B, P*A, P*B per family,
    the eleven relational features and the two signed offset distances; with ``pooled`` and
    ``cosines`` (A16, R8) then the dense block P, A, B and the two cosines."""
    spark = mentions.sparkSession
    vocab, _ = _vocab_index(spark)
    lay = count_layout(MENTION_BLOCKS, MENTION_SCALARS)
    off = spark.createDataFrame([(f, b, o) for (f, b), o in lay.offsets.items()], "family string, blk string, base int")
    inter = V.pair_interactions(counts).join(F.broadcast(vocab), ["family", "feature"])
    d = inter.where("diff <> 0").select("id", "family", "fi", F.concat(F.lit("diff_"), F.lower("cand")).alias("blk"),
                                        F.col("diff").alias("val"))
    p = inter.where("prod <> 0").select("id", "family", "fi", F.concat(F.lit("prod_"), F.lower("cand")).alias("blk"),
                                        F.col("prod").alias("val"))
    ent = d.unionByName(p).join(F.broadcast(off), ["family", "blk"]).select(
        "id", (F.col("base") + F.col("fi")).alias("idx"), "val")
    rel_cols = ["dep_eq_a", "dep_eq_b", "gov_dep_eq_a", "gov_dep_eq_b", "gov_upos_eq_a", "gov_upos_eq_b",
                "overlap_a", "overlap_b", "dist_a", "dist_b", "possessive"]
    base = lay.size - MENTION_SCALARS
    rel = relational.join(mentions.select("id", "pronoun_offset", "a_offset", "b_offset"), "id")
    scal = rel.select("id", F.explode(F.array(
        *[F.struct(F.lit(base + i).alias("idx"), F.col(c).cast("double").alias("val")) for i, c in enumerate(rel_cols)],
        F.struct(F.lit(base + 11).alias("idx"), C.signed_distance("a_offset").cast("double").alias("val")),
        F.struct(F.lit(base + 12).alias("idx"), C.signed_distance("b_offset").cast("double").alias("val")))).alias("e")
    ).select("id", "e.idx", "e.val")
    width = vector_width(pooled) if pooled is not None else 0
    vec = _with_block(_gathered(ent.unionByName(scal), ["id"], lay.size),
                      None if pooled is None else mention_vector_block(pooled, cosines, width), ["id"], 3 * width + 2)
    return (mentions.select("id", C.class_label().cast("double").alias("label"), split_of().alias("split"))
            .join(vec, "id"))


# ------------------------------------------------------------------ models ---
def gbt(**params) -> GBTClassifier:
    base = dict(maxIter=20, maxDepth=5, stepSize=0.1, subsamplingRate=1.0, seed=0)
    base.update(params)
    return GBTClassifier(labelCol="label", featuresCol="features", **base)


def pair_probabilities(model, pairs: DataFrame) -> DataFrame:
    """``(id, cand, p)`` = probability of the positive class."""
    return model.transform(pairs).select("id", "cand", vector_to_array("probability")[1].alias("p"))


def pairwise_predictions(model, pairs: DataFrame) -> DataFrame:
    """K2 + R6: pair probabilities combined into (A, B, NEITHER)."""
    return R.pair_rates(pair_probabilities(model, pairs))


def forest(**params) -> RandomForestClassifier:
    base = dict(numTrees=50, maxDepth=8, seed=0)
    base.update(params)
    return RandomForestClassifier(labelCol="label", featuresCol="features", **base)


def three_class_predictions(model, rows: DataFrame) -> DataFrame:
    """K1: ``predict_proba`` as ``(id, p_a, p_b, p_neither)``."""
    a = vector_to_array("probability")
    return model.transform(rows).select("id", a[0].alias("p_a"), a[1].alias("p_b"), a[2].alias("p_neither"))


def ranker(**params) -> LogisticRegression:
    base = dict(maxIter=50, regParam=0.01, elasticNetParam=0.5)
    base.update(params)
    return LogisticRegression(labelCol="label", featuresCol="features", **base)


def ranker_predictions(model, pairs: DataFrame) -> DataFrame:
    """K4 + R7: the shared linear pair model's margins as logits, NEITHER the zero logit."""
    m = model.transform(pairs).select("id", "cand", vector_to_array("rawPrediction")[1].alias("s"))
    piv = m.groupBy("id").agg(F.max(F.when(F.col("cand") == "A", F.col("s"))).alias("s_a"),
                              F.max(F.when(F.col("cand") == "B", F.col("s"))).alias("s_b"))
    return R.softmax_pair(piv)


def boosted_rows(rows: DataFrame) -> DataFrame:
    """K1's input ``(id, split, label, x)`` from an H7 table."""
    from pyspark.ml.functions import vector_to_array
    return rows.select("id", "split", F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))


#: Units of the shared ranker's layers: of the embedding block and of each count block.
RANKER_UNITS = {"vectors": 150, "counts": 30}


def ranker_blocks(size: int) -> list[tuple[list[int], int]]:
    """K4's blocks over H8 features of ``size`` places: [p, c, p * c] of each family and of the embedding block."""
    lay = count_layout(PAIR_BLOCKS, PAIR_SCALARS)
    out = []
    for fam in FAMILIES:
        width = len(V.vocabulary(fam))
        out.append(([lay.offsets[(fam, b)] + i for b in ("p", "c", "prod") for i in range(width)], RANKER_UNITS["counts"]))
    return out + ([(list(range(lay.size, size)), RANKER_UNITS["vectors"])] if size > lay.size else [])


def shared_ranker(pairs: DataFrame, **params):
    """K4: the shared network fitted on the train split of an H8 table, stopped by its validation split; and the rows of all mentions."""
    rows = RK.mention_rows(pairs)
    first = rows.select(F.size("a")).first()
    part = lambda s: rows.where(F.col("split") == s)
    network, losses = RK.train(part("train"), part("validation"), ranker_blocks(first[0] if first else 0), **params)
    return network, losses, rows


# ------------------------------------------------------------------ search ---
GBT_SPACE = {
    "stepSize": ("loguniform", 0.001, 0.1),
    "maxDepth": ("int", 3, 25),
    "minInfoGain": ("loguniform", 0.0005, 0.01),
    "minInstancesPerNode": ("int", 1, 7),
    "subsamplingRate": ("choice", [0.6, 0.7, 0.8, 0.9, 1.0]),
    "featureSubsetStrategy": ("choice", ["0.6", "0.7", "0.8", "0.9", "1.0"]),
}


def sample_params(space: dict, n: int, seed: int = 0) -> list[dict]:
    """Seeded random sample of parameter maps (the driver holds only these)."""
    import math
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for k, spec in space.items():
            kind = spec[0]
            if kind == "loguniform":
                p[k] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            elif kind == "int":
                p[k] = rng.randint(spec[1], spec[2])
            else:
                p[k] = rng.choice(spec[1])
        out.append(p)
    return out


def search_pairwise(train: DataFrame, validation: DataFrame, truth_validation: DataFrame,
                    trials: int = 100, seed: int = 0, parallel: int = 2, max_iter: int = 100):
    """K3: fit each sampled parameter map on train, score log loss (A9 over R6) on the
    given validation split; trials run as concurrent Spark jobs from a small thread pool.

    ``trials`` maps of ``max_iter`` boosting rounds each; the best map, its loss and all results."""
    grid = sample_params(GBT_SPACE, trials, seed)

    def run(params):
        model = gbt(maxIter=max_iter, **params).fit(train)
        ll = E.log_loss(truth_validation, pairwise_predictions(model, validation)).first()["log_loss"]
        return ll, params

    with ThreadPoolExecutor(max_workers=parallel) as ex:
        results = list(ex.map(run, grid))
    best_ll, best = min(results, key=lambda r: r[0])
    return best, best_ll, results


def search_and_refit(pairs: DataFrame, mentions: DataFrame, trials: int = 100, seed: int = 0, max_iter: int = 100):
    """K3 to the end: search on train / validation, refit the best map on both (U3); the model and the trials."""
    part = lambda name: pairs.where(F.col("split") == name)
    truth = E.truth_table(mentions.where(split_of() == "validation"))
    best, _, results = search_pairwise(part("train"), part("validation"), truth, trials, seed, max_iter=max_iter)
    return gbt(maxIter=max_iter, **best).fit(pairs.where(F.col("split") != "test")), results


#: Of the pairwise booster, as the task's search has it; but for the depth, as trees are complete.
BOOSTING_SPACE = {
    "eta": SE.Range(0.001, 0.1, log=True), "depth": SE.Range(3, 6, step=1), "gamma": SE.Range(0.05, 1.0, log=True),
    "min_child_weight": SE.Range(1, 7, step=1), "subsample": SE.Range(0.6, 1.0, step=0.1), "colsample": SE.Range(0.6, 1.0, step=0.1)}


def boosted_pairs(pairs: DataFrame) -> DataFrame:
    """The booster's input ``(id, cand, split, label, x)`` from an H8 table."""
    return pairs.select("id", "cand", "split", F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))


def boosted_pair_predictions(model: BO.SoftmaxTrees, rows: DataFrame | BO.Binned) -> DataFrame:
    """K2 + R6 by the own booster."""
    return R.pair_rates(BO.probability(model, rows, ["id", "cand"]))


def search_boosting(rows: DataFrame, truth: DataFrame, trials: int = 100, rounds: int = 100, every: int = 5,
                    parallel: int = 4, seed: int = 0, startup: int = SE.STARTUP) -> tuple[SE.Trial, list[SE.Trial]]:
    """K3 on ``boosted_pairs``: fits on the train split that report the log loss (A9 over R6) of the validation split.

    A trial reports after each ``every`` rounds and is pruned or grown to ``rounds``. ``truth``: of the validation split.
    """
    train, held = (rows.where(F.col("split") == s) for s in ("train", "validation"))
    edges = BO.quantile_edges(train, "x", BO.Settings.bins)
    # cut and stored once for all trials
    train, held = BO.binned(train.where("label is not null"), edges), BO.binned(held.drop("label"), edges, ["id", "cand"])

    def run(params: dict, report) -> None:
        def after_round(number: int, model: BO.SoftmaxTrees) -> bool:
            grown = number + 1
            if grown % every and grown != rounds:
                return False
            return report(grown, E.log_loss(truth, boosted_pair_predictions(model, held)).first()["log_loss"])
        BO.fit(train, BO.Settings(rounds=rounds, seed=seed, **params), 2, after_round)

    return SE.search(BOOSTING_SPACE, run, trials, parallel, seed, startup)


TRIALS_SCHEMA = "trial int, rounds int, reason string, log_loss double, best boolean, params string, losses map<int,double>"


def trial_table(spark, best: SE.Trial, trials: list[SE.Trial]) -> DataFrame:
    """A row a trial: rounds run, why it ended, its loss, and whether it is the best; parameters as JSON."""
    return spark.createDataFrame([
        (t.number, t.rounds, "pruned" if t.pruned else "finished", float(t.loss), t is best,
         json.dumps(t.params, sort_keys=True), t.losses) for t in trials], TRIALS_SCHEMA)


def staged_trials(cx, **settings) -> DataFrame:
    """The trials of a search over a context's pair table, staged (S4) under its inputs and settings."""
    from mentionkit.sources.staging import staged
    spark = cx.targets.sparkSession
    name = "trials-" + "-".join(f"{k}{v}" for k, v in sorted(settings.items()))

    def compute() -> DataFrame:
        truth = E.truth_table(cx.corpus.spans.where(split_of() == "validation"))
        return trial_table(spark, *search_boosting(boosted_pairs(staged_pairs(cx)), truth, **settings))

    return staged(spark, name, cx.key, compute)


def refit_best(rows: DataFrame, trials: DataFrame, seed: int = 0) -> BO.SoftmaxTrees:
    """The best trial's parameters and rounds, fitted on train and validation."""
    best = trials.where("best").first()
    settings = BO.Settings(rounds=best.rounds, seed=seed, **json.loads(best.params))
    return BO.fit(rows.where(F.col("split") != "test"), settings, 2)


def staged_pairs(cx) -> DataFrame:
    """The assembled pairwise table of a corpus context, staged once (S4) for fits and predictions."""
    from mentionkit.sources.staging import staged
    return staged(cx.targets.sparkSession, "pair_features", cx.key,
                  lambda: pair_features(cx.corpus.spans, staged_counts(cx)))


def staged_mentions(cx) -> DataFrame:
    """The assembled 3-class table (H7, counts only) of a corpus context, staged once (S4) for fits and predictions."""
    from mentionkit.sources.staging import staged
    return staged(cx.targets.sparkSession, "mention_features", cx.key, lambda: mention_features(
        cx.corpus.spans, staged_counts(cx), TR.relational_features(cx.targets, cx.near_words)))
