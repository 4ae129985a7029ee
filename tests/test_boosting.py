import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionkit.operators import boosting as B
from mentionkit.operators import evaluate as E


def twin(x, label, s, classes, edges):
    """Slow and exact: every split of every feature tried on the rows themselves."""
    model = B.SoftmaxTrees(edges, classes, s.depth)
    bins = model.bins(x)
    for number in range(s.rounds):
        g, h = B.derivatives(model.margins(bins), label)
        trees = []
        for c in range(classes):
            allowed = B._allowed(s, number, c, x.shape[1])
            tree = B.Tree(np.full((1 << s.depth) - 1, -1), np.zeros((1 << s.depth) - 1, np.int64), np.zeros(1 << s.depth))

            def grow(inner, own):
                if inner >= len(tree.feature):
                    tree.leaf[inner - len(tree.feature)] = -s.eta * g[own, c].sum() / (h[own, c].sum() + s.l2)
                    return
                best = (1e-9, -1, 0)
                score = lambda o: g[o, c].sum() ** 2 / (h[o, c].sum() + s.l2)
                for f in np.flatnonzero(allowed):
                    for b in range(len(edges[f])):
                        left, right = own & (bins[:, f] <= b), own & (bins[:, f] > b)
                        if min(h[left, c].sum(), h[right, c].sum()) < s.min_child_weight:
                            continue
                        gain = round((score(left) + score(right) - score(own)) / 2 - s.gamma, 9)
                        if gain > best[0]:
                            best = gain, f, b
                _, tree.feature[inner], tree.bin[inner] = best
                f, b = best[1:]
                right = own & (bins[:, f] > b) if f >= 0 else np.zeros_like(own)
                grow(2 * inner + 1, own & ~right)
                grow(2 * inner + 2, right)

            grow(0, np.ones(len(x), bool))
            trees.append(tree)
        model.rounds.append(trees)
    return model


def table(spark, x, label):
    return spark.createDataFrame([(i, int(y), [float(v) for v in r]) for i, (r, y) in enumerate(zip(x, label))],
                                 "id long, label int, x array<double>").repartition(3)


def planted(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 4, n), rng.normal(size=n), rng.integers(0, 2, n), rng.normal(size=n).round(1)])
    label = np.where(x[:, 1] > 0.5, 2, (x[:, 0] > 1).astype(int) ^ x[:, 2].astype(int))
    return x, label


def test_trees_equal_a_slow_exact_twin(spark, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    monkeypatch.setattr(B, "FEATURES", 3)
    x, label = planted(150)
    s = B.Settings(rounds=3, depth=2, eta=0.3, gamma=0.05, min_child_weight=2, bins=8, colsample=0.75)
    got = B.fit(table(spark, x, label), s)
    want = twin(x, label, s, 3, got.edges)
    for ours, theirs in zip(got.rounds, want.rounds, strict=True):
        for a, b in zip(ours, theirs):
            assert a.feature.tolist() == b.feature.tolist() and a.bin.tolist() == b.bin.tolist()
            assert a.leaf == pytest.approx(b.leaf, abs=1e-9)
    again = B.SoftmaxTrees.from_json(got.to_json())
    assert (again.probabilities(x) == got.probabilities(x)).all()


def test_beats_a_forest_on_planted_labels(spark):
    from pyspark.ml.functions import array_to_vector
    from mentionkit.plans import ml as M
    x = np.random.default_rng(1).normal(size=(900, 6)).round(2)
    label = np.digitize(x[:, 0] + x[:, 1] + x[:, 2], [-0.8, 0.8])
    rows = table(spark, x, label)
    truth = E.truth_table(rows.select("id", (F.col("label") == 0).alias("a_coref"), (F.col("label") == 1).alias("b_coref"))).where("id % 3 = 0")
    seen = []
    model = B.fit(rows.where("id % 3 != 0"), B.Settings(rounds=40, eta=0.3, subsample=0.9),
                  after_round=lambda n, m: seen.append(n) or len(seen) == 25)
    loss = E.log_loss(truth, B.predict(model, rows.where("id % 3 = 0"))).first()
    vectors = rows.select("id", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    forest = M.forest().fit(vectors.where("id % 3 != 0"))
    other = E.log_loss(truth, M.three_class_predictions(forest, vectors.where("id % 3 = 0"))).first()
    assert len(model.rounds) == 25 and loss["n"] == 300 and loss["log_loss"] < min(0.6, other["log_loss"])


def test_empty_tables_null_labels_and_constant_features(spark):
    rows = spark.createDataFrame([(1, None, [1.0, 2.0]), (2, 0, [1.0, 2.0]), (3, 1, [1.0, 2.0])], "id long, label int, x array<double>")
    flat = B.predict(B.fit(rows, B.Settings(rounds=1)), rows).collect()
    assert len({(r.p_a, r.p_b, r.p_neither) for r in flat}) == 1 and all(math.isclose(r.p_a + r.p_b + r.p_neither, 1) for r in flat)
    none = B.fit(rows.limit(0), B.Settings(rounds=1))
    assert [r.p_a for r in B.predict(none, rows).collect()] == [pytest.approx(1 / 3)] * 3


def test_stored_rows_keep_only_what_is_not_usual(spark):
    """Mostly zero features take few bytes and few additions, and give the sums and trees of all bins."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((700, 60)) < 0.03, rng.integers(1, 4, (700, 60)), 0).astype(float)
    x[:, :2] = rng.normal(size=(700, 2))
    label = (x[:, 5:15].sum(axis=1) + x[:, 0] > 0.5).astype(int)
    rows = table(spark, x, label)
    edges = B.quantile_edges(rows, "x", 16)
    for f, e in enumerate(edges):        # exact: the nearest ranks of all values
        v = np.sort(x[:, f])
        assert e.tolist() == sorted({v[math.ceil(i / 16 * 700) - 1] for i in range(1, 16)} - {v[-1]})
    stored = B.binned(rows, edges, ["id"])
    assert sum(len(r.bins) for r in stored.table.collect()) < 700 * 60 / 4 + 3 * 4 * 60 * 3
    bins = B.SoftmaxTrees(edges, 2, 2).bins(x)
    for r in stored.table.collect():
        block = B.Block(r.n, (stored.usual, stored.base), r.bins)
        assert all((block.column(f) == bins[r.id, f]).all() for f in range(60))
    s = B.Settings(rounds=3, depth=3, eta=0.3, min_child_weight=0.5)
    got, want = B.fit(stored, s, 2), twin(x, label, s, 2, edges)
    assert all(a.feature.tolist() == b.feature.tolist() and a.bin.tolist() == b.bin.tolist() and a.leaf == pytest.approx(b.leaf, abs=1e-9)
               for ours, theirs in zip(got.rounds, want.rounds, strict=True) for a, b in zip(ours, theirs))
    p = {r.id: r.p for r in B.probability(got, stored, ["id"]).collect()}
    assert np.array([p[i] for i in range(700)]) == pytest.approx(got.probabilities(x)[:, 1], abs=1e-12)


def test_a_side_as_large_as_the_least_but_for_rounding_will_do():
    g, h = np.array([[-1.0, 1.0]]), np.array([[1 - 1e-14, 2.0]])
    assert B.best_split(g, h, np.ones(1, bool), B.Settings(min_child_weight=1))[1:3] == (0, 0)
    assert B.best_split(g, h, np.ones(1, bool), B.Settings(min_child_weight=1.1))[1] == -1
