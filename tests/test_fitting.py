import numpy as np
import pytest

from mentionkit.operators.fitting import minimise, summed_gradient


def test_minimise_reaches_the_solution_of_an_ill_conditioned_quadratic():
    rng = np.random.default_rng(0)
    scale = 10.0 ** rng.uniform(-3, 3, 40)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    h, best = (q * scale) @ q.T, rng.normal(size=40)
    got = minimise(lambda x: (0.5 * (x - best) @ h @ (x - best), h @ (x - best)), np.zeros(40), 1e-9)
    assert np.abs(h @ (got - best)).max() < 1e-6


def test_early_stopping_ends_the_fit():
    seen = []
    minimise(lambda x: (float(x @ x) ** 2, 4 * float(x @ x) * x), np.ones(3), 0.0,
             after_step=lambda n, x, loss: seen.append(n) or n >= 3)
    assert seen == [1, 2, 3]


def test_partitions_add_up_to_the_whole(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("cast(id as double) / 1000 as x", "cast(id % 3 as double) as y")

    def local(batches, w):
        loss, g = 0.0, np.zeros(2)
        for b in batches:
            x, y = b["x"].to_numpy(), b["y"].to_numpy()
            e = w[0] * x + w[1] - y
            loss += 0.5 * float(e @ e)
            g += [float(e @ x), float(e.sum())]
        return loss, g

    w = minimise(summed_gradient(rows, local), np.zeros(2), 1e-6)
    p = rows.toPandas()
    assert w == pytest.approx(np.polyfit(p.x, p.y, 1), abs=1e-5)
