"""Evaluation: J1, A9-A15, K7, K8, T3.

Truth and predictions are aligned by ``id`` (an equi-join), never by row
position; every metric of the report is computed in one aggregate pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.functions import columns as C


def truth_table(mentions: DataFrame) -> DataFrame:
    """``(id, label, y_a, y_b, y_n)`` from a mention table."""
    return mentions.select("id", C.class_label().alias("label"), *C.truth_onehot())


def _sides(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Both tables in one, a row an id, with how often each of them holds it; one shuffle."""
    t = truth.withColumns({"n_truth": F.lit(1), "n_pred": F.lit(0)})
    p = pred.select("id", "p_a", "p_b", "p_neither", F.lit(0).alias("n_truth"), F.lit(1).alias("n_pred"))
    both = t.unionByName(p, allowMissingColumns=True)
    return both.groupBy("id").agg(*(F.max(c).alias(c) for c in both.columns if c not in ("id", "n_truth", "n_pred")),
                                  *(F.sum(c).alias(c) for c in ("n_truth", "n_pred")))


def align(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Truth joined to predictions on ``id``.

    An id that only one side has fails the job, and so does one that a side holds more than once
    (rows without id count as one id).
    """
    both = _sides(truth, pred)
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    fault = F.raise_error(F.when((F.col("n_truth") == 0) | (F.col("n_pred") == 0), F.concat(
        F.lit("truth and predictions do not hold the same ids: "), name)).otherwise(F.concat(
            F.lit("an id stands more than once in truth or predictions: "), name)))
    odd = (F.col("n_truth") != 1) | (F.col("n_pred") != 1)
    return both.select("id", *(F.when(odd, fault).otherwise(F.col(c)).alias(c)
                               for c in both.columns if c not in ("id", "n_truth", "n_pred")))


def alignment_gaps(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Ids that do not stand exactly once on each side, and how often they do (must be empty before scoring)."""
    return _sides(truth, pred).where((F.col("n_truth") != 1) | (F.col("n_pred") != 1)).select("id", "n_truth", "n_pred")


def row_log_loss(eps: float = S.LOGLOSS_EPS) -> Column:
    """A9 per row: clip to [eps, 1-eps], renormalise the row, minus the log of the true classes."""
    pa = F.least(F.greatest(F.col("p_a"), F.lit(eps)), F.lit(1 - eps))
    pb = F.least(F.greatest(F.col("p_b"), F.lit(eps)), F.lit(1 - eps))
    pn = F.least(F.greatest(F.col("p_neither"), F.lit(eps)), F.lit(1 - eps))
    s = pa + pb + pn
    return -(F.col("y_a") * F.ln(pa / s) + F.col("y_b") * F.ln(pb / s) + F.col("y_n") * F.ln(pn / s))


def with_prediction_class(joined: DataFrame) -> DataFrame:
    return joined.withColumn("pred", C.argmax3())


def log_loss(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """One row ``(n, log_loss)``."""
    j = align(truth, pred)
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(row_log_loss()).alias("log_loss"))


def evaluation_report(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """K7: A9, A10, A11, A13 and A14 in one aggregate over the J1 join."""
    j = with_prediction_class(align(truth, pred)).withColumn("loss", row_log_loss())
    correct = F.col("label") == F.col("pred")
    non_neither = (F.col("label") != 2) & (F.col("pred") != 2)
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("loss").alias("log_loss"),
        F.avg(F.when(correct, F.col("loss"))).alias("correct_log_loss"),
        F.avg(correct.cast("double")).alias("accuracy"),
        F.sum(non_neither.cast("long")).alias("non_neither_n"),
        F.avg(F.when(non_neither, correct.cast("double"))).alias("non_neither_accuracy"),
        F.sum((F.col("pred") == 0).cast("long")).alias("pred_a"),
        F.sum((F.col("pred") == 1).cast("long")).alias("pred_b"),
        F.sum((F.col("pred") == 2).cast("long")).alias("pred_neither"))


def class_dimension(spark) -> DataFrame:
    """The fixed 3-row class table (broadcast-safe: constant size)."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(S.CLASS_NAMES)], "cls int, cls_name string")


def confusion_matrix(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """3x3 ``(label, pred, n)``, zero filled."""
    j = with_prediction_class(align(truth, pred))
    counts = j.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    grid = truth.sparkSession.createDataFrame(
        [(i, j) for i in range(3) for j in range(3)], "label int, pred int")   # fixed 9 cells
    return (F.broadcast(grid).join(counts, ["label", "pred"], "left")
            .select("label", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def predicted_counts(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Rows per predicted class over the 3-row class dimension."""
    j = with_prediction_class(align(truth, pred))
    counts = j.groupBy("pred").agg(F.count(F.lit(1)).alias("n"))
    dim = F.broadcast(class_dimension(truth.sparkSession))
    return (dim.join(counts, dim.cls == counts.pred, "left")
            .select(F.col("cls").alias("pred"), "cls_name", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def errors_per_class(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Per true class, rows and wrong predictions."""
    j = with_prediction_class(align(truth, pred))
    return j.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("pred") != F.col("label")).cast("long")).alias("wrong"))


def first_errors(truth: DataFrame, pred: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` wrong rows by id (the limit is the feature)."""
    j = with_prediction_class(align(truth, pred))
    return (j.where(F.col("pred") != F.col("label"))
            .select("id", "label", "pred", "p_a", "p_b", "p_neither")
            .orderBy("id").limit(n))


def error_listing(truth: DataFrame, pred: DataFrame, features: DataFrame, n: int = 20) -> DataFrame:
    """K8: T3 joined to the long features of each wrong row, bag per (id, role, family)."""
    errs = first_errors(truth, pred, n)         # computed once: its few rows meet the features by id
    term = F.when(F.col("feature").isNotNull(), F.concat_ws(":", "feature", F.col("cnt").cast("string")))
    return (errs.join(features, "id", "left").groupBy(*errs.columns, "role", "family")
            .agg(F.sort_array(F.collect_list(term)).alias("terms"))
            .select(*errs.columns, "role", "family", F.when(F.col("role").isNotNull(), F.col("terms")).alias("bag")))
