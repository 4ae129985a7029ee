import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionkit.operators import boosting as BO
from mentionkit.operators import evaluate as E
from mentionkit.operators import search as SE
from mentionkit.plans import ml as M

SPACE = {"x": SE.Range(0.0, 1.0), "n": SE.Range(1, 9, step=1), "s": SE.Range(0.6, 1.0, step=0.1), "r": SE.Range(0.001, 0.1, log=True)}


def _run(params, report, rounds=4):
    """A loss that falls with the rounds towards the distance from a known best place."""
    far = abs(params["x"] - 0.7) + abs(params["n"] - 3) / 8 + abs(math.log(params["r"] / 0.01)) / 5
    for r in range(1, rounds + 1):
        if report(r, far + 1 / r):
            return


def test_values_stay_in_their_range_and_on_their_grid():
    for place in (0.0, 0.3, 0.999999, 1.0):
        v = {k: r.value(r.settled(place)) for k, r in SPACE.items()}
        assert 0 <= v["x"] <= 1 and v["n"] in range(1, 10) and isinstance(v["n"], int)
        assert v["s"] in (0.6, 0.7, 0.8, 0.9, 1.0) and 0.001 <= v["r"] <= 0.1 + 1e-12
    assert {SPACE["s"].value(x) for x in np.linspace(0, 1, 101)} == {0.6, 0.7, 0.8, 0.9, 1.0}


def test_a_density_is_one_over_the_unit_interval_and_draws_follow_it():
    x = (np.arange(20_000) + 0.5) / 20_000
    for places in ([], [0.2], [0.2, 0.2, 0.9], [0.0, 1.0]):
        d = SE.Density(places)
        assert d.at(x).mean() == pytest.approx(1, abs=1e-3)
        draws = d.draw(np.random.default_rng(0), 20_000)
        assert len(draws) == 20_000 and draws.mean() == pytest.approx((x * d.at(x)).mean(), abs=0.02)


def test_pruning_is_by_the_median_of_earlier_waves():
    trial = lambda n, losses: SE.Trial(n, {}, {}, losses)
    earlier = [trial(i, {1: 1.0 + i, 2: 0.5 + i}) for i in range(5)]       # median by round 2: 2.5
    assert SE.to_prune(trial(9, {1: 9.0, 2: 2.6}), earlier)
    assert not SE.to_prune(trial(9, {1: 2.4, 2: 2.6}), earlier)            # its best counts
    assert not SE.to_prune(trial(9, {1: 9.0, 2: 9.0}), earlier[:4])        # too few
    assert not SE.to_prune(trial(9, {3: 9.0}), earlier)                    # none got so far


def test_a_search_is_the_same_again_and_its_best_is_that_of_its_trials():
    best, trials = SE.search(SPACE, _run, trials=60, parallel=4, seed=5)
    again = SE.search(SPACE, _run, trials=60, parallel=4, seed=5)[1]
    assert [(t.params, t.losses, t.pruned) for t in trials] == [(t.params, t.losses, t.pruned) for t in again]
    assert [t.number for t in trials] == list(range(60))
    assert best is min((t for t in trials if not t.pruned), key=lambda t: t.loss)
    assert all(t.rounds == 4 or t.pruned for t in trials) and 0 < sum(t.pruned for t in trials) < 60


def test_model_based_sampling_finds_more_than_random_sampling():
    wins = 0
    for seed in range(7):
        model = SE.search(SPACE, _run, trials=60, parallel=2, seed=seed)[0].loss
        at_random = SE.search(SPACE, _run, trials=60, parallel=2, seed=seed, startup=60)[0].loss
        wins += model < at_random
    assert wins >= 5


def test_odd_searches():
    with pytest.raises(ValueError):
        SE.search(SPACE, _run, trials=0)
    with pytest.raises(KeyError):
        SE.search(SPACE, lambda params, report: params["none"], trials=2)
    best, trials = SE.search(SPACE, lambda params, report: report(1, math.nan if params["x"] < 0.5 else 1.0), trials=12)
    assert best.loss == 1.0 and any(t.loss == math.inf for t in trials)


def test_searched_booster_on_planted_labels(spark):
    rng = random.Random(1)
    rows, mentions = [], []
    for i in range(300):
        truth = rng.randint(0, 2)
        mentions.append((i, truth == 0, truth == 1))
        for k, cand in enumerate("AB"):
            rows.append((i, cand, int(truth == k), [float(truth == k) + rng.gauss(0, 0.3), rng.random(), 0.0]))
    truth = spark.createDataFrame(mentions, "id long, a_coref boolean, b_coref boolean")
    pairs = spark.createDataFrame(rows, "id long, cand string, label int, x array<double>").withColumn("split", M.split_of()).cache()
    held = E.truth_table(truth.where(M.split_of() == "validation"))
    best, trials = M.search_boosting(pairs, held, trials=3, rounds=4, every=2, parallel=3)
    assert len(trials) == 3 and all(sorted(t.losses) == [2, 4] for t in trials)
    table = M.trial_table(spark, best, trials)
    row = table.where("best").first()
    # the recorded loss is what the recorded parameters give
    s = BO.Settings(rounds=row.rounds, **json.loads(row.params))
    model = BO.fit(pairs.where("split = 'train'"), s, 2)
    loss = E.log_loss(held, M.boosted_pair_predictions(model, pairs.where("split = 'validation'"))).first()["log_loss"]
    assert loss == pytest.approx(row.log_loss, abs=1e-12) and loss < math.log(3)
    final = M.refit_best(pairs, table)
    test = E.truth_table(truth.where(M.split_of() == "test"))
    got = E.log_loss(test, M.boosted_pair_predictions(final, pairs.where("split = 'test'"))).first()["log_loss"]
    assert len(final.rounds) == row.rounds and got < math.log(3)
    assert table.where(F.col("reason") == "finished").count() >= 1
