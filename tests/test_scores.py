import math

import pytest

from mentionkit.operators import evaluate as E
from mentionkit.operators import scorers as R
from mentionkit.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_uniform_log_loss_is_ln3(spark):
    ll = QUERIES["a9_log_loss_uniform"](spark, SF).first()["log_loss"]
    assert abs(ll - 1.09861) < 1e-5 and abs(ll - math.log(3)) < 1e-6


def test_log_loss_renormalises_and_clips(spark):
    truth = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0)], "id long, label int, y_a double, y_b double, y_n double")
    pred = spark.createDataFrame([(1, 0.0, 1.0, 1.0)], "id long, p_a double, p_b double, p_neither double")
    ll = E.log_loss(truth, pred).first()["log_loss"]
    assert abs(ll - (-math.log(1e-15 / (1e-15 + 2 * (1 - 1e-15))))) < 1e-6


@pytest.mark.parametrize("side", ["truth", "predictions", "missing", "extra"])
def test_every_evaluation_fails_on_repeated_or_unmatched_ids(spark, side):
    truth = [(i, i % 3, float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)) for i in range(4)]
    pred = [(i, 0.5, 0.25, 0.25) for i in range(4)]
    change = {"truth": (truth + truth[:1], pred), "predictions": (truth, pred + pred[2:3]),
              "missing": (truth, pred[1:]), "extra": (truth, [*pred, (9, 1.0, 0.0, 0.0)])}
    t, p = change[side]
    truth = spark.createDataFrame(t, "id long, label int, y_a double, y_b double, y_n double")
    pred = spark.createDataFrame(p, "id long, p_a double, p_b double, p_neither double")
    features = spark.createDataFrame([], "id long, role string, family string, feature string, cnt long")
    assert E.alignment_gaps(truth, pred).count() == 1
    for run in (E.log_loss, E.evaluation_report, E.confusion_matrix, E.predicted_counts, E.errors_per_class, E.first_errors,
                lambda t, p: E.error_listing(t, p, features)):
        with pytest.raises(Exception, match="same ids|more than once"):
            run(truth, pred).collect()


def test_syntax_decision(spark):
    pts = spark.createDataFrame([(1, 3, 3), (2, 5, 4), (3, 4, 6), (4, 4, 4)], "id long, a_points long, b_points long")
    got = {r["id"]: (r["p_a"], r["p_b"], r["p_neither"]) for r in R.points_to_scores(pts).collect()}
    assert got == {1: (0.2, 0.2, 0.6), 2: (1.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0), 4: (0.5, 0.5, 0.0)}


def test_prefix_scorer_ignores_empty_prediction(spark):
    from conftest import make_words
    w = make_words(spark, [("her", "PRON", "PRP$", 1, 0, "root"), ("Cheryl", "PROPN", "NNP", 2, 1, "obj"),
                           ("Pauline", "PROPN", "NNP", 3, 1, "obj")])
    t = spark.createDataFrame([(1, 1, "P", 0), (1, 1, "A", 1), (1, 1, "B", 2)],
                              "id long, doc_id long, role string, wi int")
    preds = spark.createDataFrame([(1, 1, "", 0.6), (1, 2, "Cher", 0.3), (1, 3, "Bob", 0.1)],
                                  "id long, rank int, token string, prob double")
    r = R.prefix_scores(t, w, preds).first()
    assert (r["p_a"], r["p_b"], r["p_neither"]) == (1.0, 0.0, 0.0)


def test_pair_rates_and_softmax(spark):
    pp = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5)], "id long, cand string, p double")
    r = R.pair_rates(pp).first()
    assert [round(x, 9) for x in (r["p_a"], r["p_b"], r["p_neither"])] == [0.4, 0.4, 0.2]
    s = spark.createDataFrame([(1, 0.0, 0.0)], "id long, s_a double, s_b double")
    r = R.softmax_pair(s).first()
    assert all(abs(x - 1 / 3) < 1e-12 for x in (r["p_a"], r["p_b"], r["p_neither"]))


def test_report_invariants(spark):
    cm = QUERIES["a12_confusion_cascade"](spark, SF).collect()
    n = QUERIES["k7_report_cascade"](spark, SF).first()["n"]
    assert len(cm) == 9 and sum(r["n"] for r in cm) == n
    preds = QUERIES["r5_cascade_scores"](spark, SF).collect()
    assert all(abs(r["p_a"] + r["p_b"] + r["p_neither"] - 1) < 1e-9 for r in preds)


def test_context_scorers_match_registered_queries(spark):
    from mentionkit.plans.fixture import load_context
    cx = load_context(spark, SF)

    def as_dict(df):
        return {r["id"]: (round(r["p_a"], 9), round(r["p_b"], 9), round(r["p_neither"], 9)) for r in df.collect()}

    assert as_dict(R.context_scorer("syntax", cx.near_words)(cx.targets)) == as_dict(
        QUERIES["r3_syntax_scores"](spark, SF))
    assert as_dict(R.context_scorer("cascade", cx.corpus.words)(cx.targets)) == as_dict(
        QUERIES["r5_cascade_scores"](spark, SF))
