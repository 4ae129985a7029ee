import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionkit.llm import labelled, quality, toxicity
from mentionkit.llm.common import crc_fold

SF = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    from mentionkit.llm.catalog import QUERIES
    got = QUERIES[name](spark, SF)
    return got.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").filter("held_out").select(
        "score", "predicted", F.col(label).alias("y")).toPandas()


def auc(y, score):
    rank = score.rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_quality_on_held_out_rows(spark):
    got = held_out(spark, "op5_quality", "quality")
    assert len(got) > 1000 and auc(got.y, got.score) > 0.97 and (got.y == got.predicted).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    got = held_out(spark, "op7_toxicity", "toxic")
    assert len(got) > 500 and auc(got.y, got.score) > 0.985 and (got.y == got.predicted).mean() > 0.98


# ------------------------------------------------------------------ parts ---
def test_word_ngrams_equal_slicing():
    words = ["a", "été", "日本語x", "hello", "x" * 40]
    row, bucket = toxicity.word_ngrams([w.encode() for w in words])
    per = {i: sorted(bucket[row == i].tolist()) for i in range(len(words))}
    for i, w in enumerate(words):
        alone = toxicity.word_ngrams([w.encode()])[1]
        assert per[i] == sorted(alone.tolist())
        marked = f" {w} "
        grams = {marked[a:a + n] for n in toxicity.NGRAMS for a in range(len(marked) - n + 1)}
        assert len(alone) == sum(max(0, len(marked) - n + 1) for n in toxicity.NGRAMS)
        assert len(set(alone.tolist())) <= len(grams)
    assert len(toxicity.word_ngrams([])[0]) == 0


def test_features_of_giant_words_and_many_groups(monkeypatch):
    rng = random.Random(8)
    letters = "abcdefghij é語"
    texts = ["".join(rng.choices(letters, k=900)).encode() for _ in range(3)] + [b"ab" * 700, b"q" * 500 + b" short " + b"zx" * 400]
    whole = [toxicity.document_features(t) for t in texts]
    monkeypatch.setattr(toxicity, "SLICE", 37)
    for t, (bucket, n) in zip(texts, whole):
        got = toxicity.document_features(t)
        assert (got[0] == bucket).all() and (got[1] == n).all()


def test_steps_give_back_numbers_and_counts():
    rng = np.random.default_rng(5)
    for numbers in ([], [0], [0, 1, 255, 256, 100_000], np.unique(rng.integers(0, 200_000, 500))):
        numbers = np.array(numbers, np.int64)
        counts = rng.choice([1, 2, 255, 256, 700], len(numbers))
        gaps, shares = toxicity.as_steps(numbers, counts)
        got = np.bincount(np.cumsum(gaps, dtype=np.int64), shares, minlength=200_000)
        assert gaps[0] == shares[0] == 0 and got[numbers].tolist() == counts.tolist() and got.sum() == counts.sum()


def test_a_word_of_five_million_letters_takes_bounded_memory():
    import tracemalloc
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=100_000)).encode() * 50
    tracemalloc.start()
    bucket, n = toxicity.document_features(text)
    score = toxicity.Scorer(np.ones(toxicity.BUCKETS, np.float32), -1.0)([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bucket) > 100_000 and (n == 1).all() and score == 1.0 and peak < 150e6


def test_the_fit_equals_a_dense_newton_solver(spark):
    docs, labels = docs_and_labels(spark)
    docs, labels = docs.filter("doc_id < 400"), labels.filter("doc_id < 400")
    weights, intercept = toxicity.fit(docs, labels, F.lit(True))
    rows = docs.groupBy("doc_id").agg(F.min("text").alias("text")).join(labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(
        F.max("toxic").alias("y")), "doc_id").toPandas()
    x, y = np.zeros((len(rows), toxicity.BUCKETS)), rows.y.to_numpy().astype(float)
    for i, t in enumerate(rows.text):
        bucket, n = toxicity.document_features(t.encode())
        x[i, bucket] = n
    kept = np.flatnonzero((x > 0).sum(axis=0) >= toxicity.LEAST_DOCS)
    x = x[:, kept]
    p, q = x[y == 1].sum(axis=0) + 1, x[y == 0].sum(axis=0) + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x *= ratio
    # in the span of the rows: w = x' a
    k, a, c = x @ x.T, np.zeros(len(y)), 0.0
    for _ in range(100):
        e = 1 / (1 + np.exp(-(k @ a + c)))
        d = e * (1 - e) / len(y) + 1e-12
        system = np.zeros((len(y) + 1, len(y) + 1))
        system[:-1, :-1] = d[:, None] * k + toxicity.RIDGE * np.eye(len(y))
        system[:-1, -1] = d
        system[-1, :-1], system[-1, -1] = d @ k, d.sum()
        right = np.r_[d * (k @ a + c) - (e - y) / len(y), (d * (k @ a + c) - (e - y) / len(y)).sum()]
        new = np.linalg.solve(system, right)
        a, c = new[:-1], new[-1]
    assert weights[kept] == pytest.approx((x.T @ a) * ratio, abs=2e-3) and intercept == pytest.approx(c, abs=3e-2)  # the flattest direction
    assert (weights[np.setdiff1d(np.arange(toxicity.BUCKETS), kept)] == 0).all()


def test_scorer_sums_distinct_words():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    texts = [None, b"", b"one Two two", "été x".encode(), b"long " * 100_000]
    got = toxicity.Scorer(weights, 0.25)(texts)
    for text, score in zip(texts, got):
        z = 0.25
        for w in set((text or b"").lower().split()):
            z += weights[np.unique(toxicity.word_ngrams([w])[1])].astype(float).sum()
        assert score == pytest.approx(1 / (1 + math.exp(-min(max(z, -700), 700))))


def test_statistics_of_odd_texts():
    for text in [None, b"", b" \n\t", b"\xff\xfe", "é".encode(), b"x" * 2_000_000, b"a b c\n" * 100_000]:
        got = quality.statistics(text)
        assert len(got) == len(quality.STATISTICS) and np.isfinite(got).all()
    assert quality.statistics(None) == [0.0] * len(quality.STATISTICS)


def test_trees_learn_and_flat_walk_equals_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.grow(x, y, trees=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    for r in x[:20]:
        z = model.start
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + bool(r[f[i]] > t[i])
            z += leaf[i - len(f)]
        assert model.margin(r[None])[0] == pytest.approx(z)
    assert np.isfinite(quality.grow(np.zeros((10, 2)), np.r_[np.zeros(5), np.ones(5)]).leaf).all()


# ------------------------------------------------------------------ cases ---
def docs_and_labels(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(rng.choices(words, k=20) + ["nasty" if bad else "kindly"] * 3) + (" !!!" if bad else ".")
        docs.append((i, text, "clash"))
        labels.append((i, 0 if bad else 1, int(bad)))
    docs += [(None, "no id nasty", "c"), (1000, None, "c"), (1001, "", None), (1001, "", None), (3, "a repeated id", "c")]
    labels += [(None, 1, 1), (2, None, None), (5, 7, 9), (1002, 1, 0), (3, 1, 0), (3, 0, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("kind, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, kind, label):
    docs, labels = docs_and_labels(spark)
    model = kind.fit(docs, labels, crc_fold("doc_id", 3) != 1, label, per_class=60)
    out = kind.with_score(docs, model, "own")
    assert out.columns == [*docs.columns, "own"]
    got = out.collect()
    assert len(got) == 405 and all(0 <= r.own <= 1 for r in got)
    scores = {r.doc_id: r.own for r in got if r.doc_id is not None and r.doc_id != 3}
    good = [(scores[i] >= 0.5) == ((i % 4 == 0) == (label == "toxic")) for i in range(400) if i != 3]
    assert np.mean(good) > 0.95
    assert kind.with_score(docs.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.filter(F.col(label) == 1)):
        flat = kind.with_score(docs, kind.fit(docs, some, F.lit(True), label)).select("score").collect()
        want = 0.0 if some.count() == 0 else 1.0
        assert all(abs(r.score - want) < 1e-6 for r in flat)


def test_sample_is_bounded_and_the_same(spark):
    docs, labels = docs_and_labels(spark)
    runs = []
    for _ in range(2):
        sample, sizes = labelled.labelled_sample(docs, labels, "toxic", F.lit(True), 30)
        runs.append(sorted(map(tuple, sample.collect())))
    assert runs[0] == runs[1] and len(runs[0]) <= 60
    # id 3 has both labels and counts as 1; ids 2 and 5 keep the one valid label they have
    assert sizes == {0: 300, 1: 101}
    assert labelled.prior_shift({0: 300, 1: 100}, {0: 30, 1: 30}) == pytest.approx(math.log(1 / 3))


def test_rare_features_count_beside_thousands_of_more_telling_ones(spark):
    rng = random.Random(6)
    common = "alpha beta gamma delta epsilon zeta eta theta".split()
    word = lambda n: "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=n))
    often, rare = [word(12) for _ in range(200)], [word(9) for _ in range(60)]
    own = [rng.sample(often, 5) for _ in range(800)] + [[rare[i % 60]] for i in range(420)]
    rows = [(i, " ".join(rng.choices(common, k=15) + w), 1) for i, w in enumerate(own)]
    rows += [(10_000 + i, " ".join(rng.choices(common, k=15)), 0) for i in range(1200)]
    rows += [(20_000 + i, " ".join([*common, w]), None) for i, w in enumerate(rare)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights, intercept = toxicity.fit(table, table, F.lit(True))
    assert (weights != 0).sum() > 8000
    got = toxicity.with_score(table.filter("doc_id >= 20000"), (weights, intercept)).collect()
    assert np.mean([r.score >= 0.5 for r in got]) > 0.95


def test_a_step_of_the_fit_sends_no_features_along(spark, monkeypatch):
    """What a step's function holds passes through the driver each time; the driver's garbage goes between the steps."""
    import numpy as np
    from pyspark import cloudpickle
    from mentionkit.llm import toxicity
    held, cleared, make = [], [], toxicity.summed_gradient
    monkeypatch.setattr(toxicity, "release", lambda s: cleared.append(s))

    def summed(rows, local, most):
        own = make(rows, local, most)
        return lambda w: held.append(len(cloudpickle.dumps(local))) or own(w)

    monkeypatch.setattr(toxicity, "summed_gradient", summed)
    texts = spark.createDataFrame([(i % 2, bytearray(f"word{i % 7} other{i % 5}".encode())) for i in range(40)], "y int, text binary")
    kept = np.arange(toxicity.BUCKETS)
    objective = toxicity._loss(texts, kept, np.linspace(-1, 1, len(kept)), 40)
    for _ in range(4):
        loss, gradient = objective(np.zeros(len(kept) + 1))
    assert abs(loss - np.log(2)) < 1e-12 and gradient.shape == (len(kept) + 1,) and len(cleared) == 1
    assert len(held) == 4 and max(held) < 100_000
