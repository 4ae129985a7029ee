"""S5 + G1 -- trained scorers kept by path and chosen by name, like any rule.

A saved scorer is one JSON document in a folder: what it is, its parameters, the layout of the features
it was trained on, how it was trained, and the code it was trained with. Loading checks layout and code, so
a model never reads features that mean something else. ``trained:<folder>`` is its name among the scorers:
a mention table is annotated, its features assembled and scored by the one saved document.

Kinds: ``ranker`` (K4, on the pair table H8) and ``boosting`` (K1, on the mention table H7).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit.operators import boosting as BO
from mentionkit.operators import ranker as RK
from mentionkit.operators import scorers as R
from mentionkit.operators import tree as TR
from mentionkit.plans import ml as M
from mentionkit.sources.staging import STAGING_VERSION

PREFIX = "trained:"


@dataclass
class Saved:
    """``kind``; the model; ``width`` of the vectors it was trained with (0: counts only); how it was trained; the code."""

    kind: str
    model: RK.PairNetwork | BO.SoftmaxTrees
    width: int
    trained: dict
    code: str = STAGING_VERSION


def layout(kind: str) -> dict:
    """Where each block of counts lies in the features of a kind."""
    lay = M.count_layout(M.PAIR_BLOCKS, M.PAIR_SCALARS) if kind == "ranker" else M.count_layout(M.MENTION_BLOCKS, M.MENTION_SCALARS)
    return {"size": lay.size, "offsets": {f"{fam}/{blk}": o for (fam, blk), o in lay.offsets.items()}}


def save(spark: SparkSession, saved: Saved, path: str) -> None:
    """Write the document below ``path``, which must not exist yet."""
    text = json.dumps({"kind": saved.kind, "model": saved.model.to_json(), "width": saved.width, "trained": saved.trained,
                       "code": saved.code, "layout": layout(saved.kind)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str, any_code: bool = False) -> Saved:
    """Read a document; fails where its layout, or (but for ``any_code``) its code, is not this package's."""
    rows = spark.read.text(path, wholetext=True).filter("trim(value) <> ''").take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} holds no saved scorer")
    d = json.loads(rows[0].value)
    if d["kind"] not in ("ranker", "boosting"):
        raise ValueError(f"{path} holds an unknown kind of scorer: {d['kind']!r}")
    if d["layout"] != layout(d["kind"]):
        raise ValueError(f"{path} was trained on other features than this package makes")
    if d["code"] != STAGING_VERSION and not any_code:
        raise ValueError(f"{path} was trained with code {d['code']}, this is {STAGING_VERSION}; "
                         "train again, or say that any code will do")
    kind = RK.PairNetwork if d["kind"] == "ranker" else BO.SoftmaxTrees
    return Saved(d["kind"], kind.from_json(d["model"]), d["width"], d["trained"], d["code"])


def features(cx, kind: str, pooled: DataFrame | None = None, cosines: DataFrame | None = None) -> DataFrame:
    """The rows of a context's mentions that a kind reads, with their split and label; of a staged table where they are counts alone."""
    if cx.key and pooled is None:
        return RK.mention_rows(M.staged_pairs(cx)) if kind == "ranker" else M.boosted_rows(M.staged_mentions(cx))
    counts = M.staged_counts(cx) if cx.key else M.long_counts(cx.targets, cx.near_words)
    if kind == "ranker":
        return RK.mention_rows(M.pair_features(cx.corpus.spans, counts, pooled))
    return M.boosted_rows(M.mention_features(cx.corpus.spans, counts, TR.relational_features(cx.targets, cx.near_words), pooled, cosines))


def train(cx, kind: str, pooled: DataFrame | None = None, cosines: DataFrame | None = None, **settings) -> Saved:
    """Fit a kind on a labelled context: the ranker on its train split, stopped by the validation split; trees on both."""
    rows = features(cx, kind, pooled, cosines)
    width = M.vector_width(pooled) if pooled is not None else 0
    part = lambda s: rows.where(F.col("split") == s)
    if kind == "ranker":
        size = layout(kind)["size"] + 3 * width
        network, losses = RK.train(part("train"), part("validation"), M.ranker_blocks(size), **settings)
        return Saved(kind, network, width, {**settings, "validation_losses": losses})
    if kind != "boosting":
        raise ValueError(f"no such kind: {kind!r}")
    s = BO.Settings(**settings)
    return Saved(kind, BO.fit(rows.where(F.col("split") != "test"), s), width, asdict(s))


def score(cx, saved: Saved, pooled: DataFrame | None = None, cosines: DataFrame | None = None) -> DataFrame:
    """``(id, p_a, p_b, p_neither)`` of all mentions of a context."""
    width = M.vector_width(pooled) if pooled is not None else 0
    if width != saved.width:
        raise ValueError(f"the scorer was trained with vectors of {saved.width} dimensions, these have {width}")
    rows = features(cx, saved.kind, pooled, cosines)
    return (RK if saved.kind == "ranker" else BO).predict(saved.model, rows)


def register(spark: SparkSession, name: str, any_code: bool = False) -> None:
    """Make ``trained:<folder>`` a scorer by that name; the folder is read and checked now."""
    saved = load(spark, name.removeprefix(PREFIX), any_code)
    R.register_context_scorer(name, lambda cx: score(cx, saved))
