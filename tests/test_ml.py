from pyspark.sql import functions as F

from mentionkit.operators import evaluate as E
from mentionkit.plans import ml as M
from mentionkit.plans.catalog import QUERIES
from mentionkit.plans.fixture import load_context

SF = "/root/testdata/sf0.001"


def test_pairwise_model_probabilities(spark):
    cx = load_context(spark, SF)
    pairs = M.pair_features(cx.corpus.mentions, M.staged_counts(cx))
    assert pairs.count() == 2 * cx.corpus.mentions.count()
    model = M.gbt(maxIter=3).fit(pairs.where(F.col("split") != "test"))
    pred = M.pairwise_predictions(model, pairs.where(F.col("split") == "test")).collect()
    assert pred and all(abs(r["p_a"] + r["p_b"] + r["p_neither"] - 1) < 1e-9 for r in pred)


def test_search_is_seeded():
    a = M.sample_params(M.GBT_SPACE, 5, seed=3)
    assert a == M.sample_params(M.GBT_SPACE, 5, seed=3) and len({str(p) for p in a}) == 5
    assert all(3 <= p["maxDepth"] <= 25 and 0.001 <= p["stepSize"] <= 0.1 for p in a)


def test_model_reports_cover_the_test_split(spark):
    cx = load_context(spark, SF)
    n_test = cx.corpus.mentions.where(M.split_of() == "test").count()
    for name in ("k1_forest_3class", "k4_linear_pair_ranker"):
        r = QUERIES[name](spark, SF).first()
        assert r["n"] == n_test and 0 <= r["accuracy"] <= 1 and r["log_loss"] > 0


def test_learnable_labels_beat_the_uniform_log_loss(spark):
    import math
    import random
    from pyspark.sql import functions as F
    from mentionkit.operators import evaluate as E
    rng = random.Random(0)
    rows, mentions = [], []
    for i in range(400):
        truth = rng.randint(0, 2)
        mentions.append((i, truth == 0, truth == 1))
        for k, cand in enumerate("AB"):
            rows.append((i, cand, 0, 1.0 if truth == k else 0.0))
            rows.append((i, cand, 3, rng.random()))
    truth = spark.createDataFrame(mentions, "id long, a_coref boolean, b_coref boolean")
    vectors = M._dense(spark.createDataFrame(rows, "id long, cand string, idx int, val double"), ["id", "cand"], 5)
    labels = truth.select("id", F.expr("stack(2, 'A', a_coref, 'B', b_coref) AS (cand, y)"))
    pairs = vectors.join(labels, ["id", "cand"]).select("id", "cand", F.col("y").cast("double").alias("label"),
                                                        M.split_of().alias("split"), "features").cache()
    assert set(r["features"].size for r in pairs.collect()) == {5}
    model, results = M.search_and_refit(pairs, truth, trials=2, max_iter=5)
    test = truth.where(M.split_of() == "test")
    loss = E.log_loss(E.truth_table(test), M.pairwise_predictions(model, pairs.where("split = 'test'"))).first()["log_loss"]
    assert len(results) == 2 and loss < 0.8 * math.log(3)


def test_dense_vectors_place_every_entry(spark):
    rows = [(1, 0, 1.5), (1, 4, -2.0), (2, 2, 3.0), (3, 4, 1.0), (3, 0, 0.5), (3, 3, 2.5)]
    got = {r["id"]: r["features"].toArray().tolist() for r in M._dense(
        spark.createDataFrame(rows, "id long, idx int, val double"), ["id"], 5).collect()}
    assert got == {1: [1.5, 0, 0, 0, -2.0], 2: [0, 0, 3.0, 0, 0], 3: [0.5, 0, 0, 2.5, 1.0]}


def test_places_that_stand_several_times_are_gathered_in_turn(spark):
    rows = [(1, 2, 5.0), (1, 0, 1.0), (2, 1, 4.0), (2, 1, 3.0), (2, 3, None), (3, 0, 2.0)]
    got = M._gathered(spark.createDataFrame(rows, "id long, idx int, val double").coalesce(1), ["id"], 4)
    assert {r.id: r.values for r in got.collect()} == {1: [1, 0, 5, 0], 2: [0, 3, 4, 0, None], 3: [2, 0, 0, 0]}
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()     # not laid out number by number in the JVM
