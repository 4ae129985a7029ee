import hashlib
import math
import random

import numpy as np
import pytest

from mentionkit.llm import centroids as C
from mentionkit.llm import negatives as N
from mentionkit.llm import vectors as V

NAN, INF = float("nan"), float("inf")


def floors(v, scale):
    return [max(-V.LIMIT, min(V.LIMIT, math.floor(scale * x))) for x in v]


# -------------------------------------------------------------- centroids ---
def brute_clusters(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, floors(v, scale)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (digest(r[0]), r[0] is not None, r[0] or 0, r[1]))
    cents = [x for _, x in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda x: min(range(len(cents)), key=lambda c: (square(x, cents[c]), c))
    for _ in range(rounds):
        own = [pick(x) for _, x in kept]
        for c in range(len(cents)):
            mine = [x for (_, x), o in zip(kept, own) if o == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i, pick(x), square(x, cents[pick(x)])) for i, x in kept), key=str), cents


def vector_rows(n, dims, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("dims, k", [(6, 8), (64, 3), (1, 2)])
def test_clusters_equal_brute_force(spark, dims, k):
    rows = vector_rows(120, dims, dims)
    rows += [(200, None), (201, [0.5] * (dims + 1)), (202, []), (203, [NAN] * dims), (204, [INF] * dims),
             (205, [None] * dims), (None, [0.25] * dims), (3, rows[3][1]), (3, rows[3][1]), (206, [1e300] * dims), (207, [-0.0] * dims)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got, cents = C.cluster(table, k=k, rounds=4, dims=dims)
    want, want_cents = brute_clusters(rows, k, 4, dims)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    assert cents.tolist() == want_cents
    out = C.with_inertia(got, cents).collect()
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_cents[r.cluster])).encode()).hexdigest() for r in out)
    assert all(r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) for r in out)


def test_few_equal_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9)], "vec_id long, embedding array<float>")
    got, cents = C.cluster(same, k=4, rounds=2, dims=2)
    assert len(cents) == 4 and {(r.cluster, r.distance) for r in got.collect()} == {(0, 0)}
    got, cents = C.cluster(same.limit(1), k=4, rounds=2, dims=2)
    assert len(cents) == 1 and got.count() == 1
    none = C.with_inertia(*C.cluster(same.limit(0), dims=2))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_places_bound_distances_and_filter_centroids():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (400, 64)) + 2000 * rng.integers(0, 2, (400, 1))
    simplex = C.Simplex(x[:16])
    places = simplex.places(x)
    low, high = C.bounds(places, places[:40])
    exact = C.squared_distances(x, x[:40])
    assert (low <= exact).all() and (exact <= high).all()
    centroids = np.array([x[:200].mean(0), x[200:].mean(0), x[0], x[5], x[9] * 3], int)
    found, distance, compared = C.nearest(x, places, centroids, simplex.places(centroids), distances=True)
    every = C.squared_distances(x, centroids)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all() and compared < every.size
    # dependent pivots are dropped
    assert len(C.Simplex(np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0], [0, 5, 0]])).pivots) < 4


def test_large_integers_are_exact():
    a = np.array([[V.LIMIT, -V.LIMIT] * 32, [1, 0] * 32])
    want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(r, s)) for s in a] for r in a]
    assert C.squared_distances(a, a).tolist() == want
    assert N.scores(a, a).tolist() == [[sum(int(p) * int(q) for p, q in zip(r, s)) for s in a] for r in a]


# -------------------------------------------------------------- negatives ---
def brute_negatives(rows, every, positives, keep, scale=256):
    kept = [(i, label, floors(v, scale)) for i, label, v in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for a, label, x in kept:
        if a is None or a % every:
            continue
        scored = [(i, sum(p * q for p, q in zip(x, y)), own) for i, own, y in kept]
        same = sorted((r for r in scored if r[2] == label and r[0] != a), key=key)[:positives]
        other = sorted((r for r in scored if r[2] != label), key=key)
        for p, score, _ in same:
            fit = [r for r in other if 80 * score <= 100 * r[1] <= 100 * score][:keep]
            out += [(a, p, n + 1, i, score, s) for n, (i, s, _) in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [0.1, 5.0])
def test_negatives_equal_brute_force(spark, monkeypatch, spread):
    for name, value in (("BLOCK", 7), ("CHUNK", 40), ("RUN", 4), ("ANCHORS", 3)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(spread)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(160):
        c = rng.randrange(4)
        rows.append((i, rng.choice([c, c, 9]), [x + rng.gauss(0, spread) for x in centres[c]]))
    rows += [(200, 1, None), (201, None, [1.0] * 8), (202, 1, [NAN] * 8), (203, 1, [1.0, None] * 4), (204, 1, [INF] + [0.0] * 7),
             (205, 1, [2.0, 1.0]), (206, 2, []), (210, 1, [0.0] * 8), (None, 1, [0.3] * 8), (None, 9, [0.31] * 8),
             (30, rows[30][1], rows[30][2]), (31, rows[31][1], rows[31][2]), (220, 9, rows[10][2]), (221, 9, rows[10][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, rank string").repartition(3)
    got = sorted((tuple(r) for r in N.hard_negatives(table, 10, 3, 4).collect()), key=str)
    want = brute_negatives(rows, 10, 3, 4)
    assert got == want and len(got) > 20
    assert N.hard_negatives(table.limit(0)).count() == 0
    assert N.hard_negatives(table.filter("vec_id % 10 <> 0"), 10).count() == 0


def test_bounds_hold_and_skip_scoring_where_angles_tell():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 16)) * 40
    x = np.floor(base[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 16))).astype(np.int64)
    norm, angle = N.norms_and_angles(x, base)
    low, high = N.score_bounds(norm, norm, angle, angle, norm[:50], angle[:50])
    exact = N.scores(x, x[:50])
    assert (low <= exact).all() and (exact <= high).all()
    order = np.lexsort((angle.min(1), angle.argmin(1)))
    rows = [(np.arange(3000)[o], np.zeros(3000, int)[o], x[o], norm[o], angle[o]) for o in np.array_split(order, 4)]
    anchors = {"id": np.arange(50), "label": np.zeros(50, int), "x": x[:50], "norm": norm[:50], "angle": angle[:50]}
    best = N.Best(np.full((50, 1), -N.OPEN), np.full((50, 1), N.OPEN), 5)
    scored = N.search(iter(rows), anchors, best, True)
    np.fill_diagonal(exact[:50], np.iinfo(np.int64).min)
    want = np.sort(exact, axis=0)[::-1][:5].T
    assert (best.score.reshape(50, 5) == want).all() and scored < 0.75 * 3000 * 50
