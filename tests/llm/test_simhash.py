import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from mentionkit.llm import simhash as S
from mentionkit.llm.graph import components


def brute_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def near(rng, centre, n, most):
    out = []
    for _ in range(n):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.append(x)
    return out


def test_fingerprint_equals_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One two THREE", "a b c d", "Ünï CODE Ä x y z", "x " * 50_000]
    texts += [" ".join(rng.choices("a bb ccc dd\t E F".split(), k=rng.randint(0, 40))) for _ in range(60)]
    assert [S.fingerprint(t.encode() if t is not None else None) for t in texts] == [
        brute_fingerprint(t) for t in texts]


def test_fingerprint_by_chunks(monkeypatch):
    text = " ".join(map(str, range(500)))
    whole = brute_fingerprint(text)
    monkeypatch.setattr(S, "HASH_CHUNK", 7)
    assert S.fingerprint(text.encode()) == whole


@pytest.mark.parametrize("k", [2, 3, 4, 6])
def test_links_connect_what_brute_force_connects(spark, k, monkeypatch):
    rng = random.Random(k)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(8))]:
        fps.update(near(rng, c, 25, 7))
    fps = sorted(fps)
    rows = [(S._as_long(f),) for f in fps]
    got = S.links(spark.createDataFrame(rows, "fp long"), k).collect()
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in got]
    assert all((a ^ b).bit_count() <= k for a, b in pairs)
    want = brute_roots(fps, lambda a, b: (a ^ b).bit_count() <= k)
    joined = set(pairs) | {(b, a) for a, b in pairs}
    assert brute_roots(fps, lambda a, b: (a, b) in joined) == want
    roots = {r.node: r.root for r in components(spark.createDataFrame(got, "a long, b long")).collect()}
    mine = {f: roots.get(S._as_long(f), S._as_long(f)) for f in fps}
    groups = lambda of: sorted(sorted(f for f in fps if of[f] == r) for r in set(of.values()))
    assert groups(mine) == groups(want)


def test_large_buckets_are_cut_again(monkeypatch):
    rng = random.Random(9)
    finder = S.LinkFinder(4)
    low = 0b1011  # one bucket: the first segment is equal but for bit 0
    fps = {(rng.getrandbits(10) << 30 | low) ^ rng.getrandbits(1) for _ in range(400)}
    f = np.array(sorted(fps), np.uint64)
    whole = [tuple(map(int, p)) for a, b in finder.bucket(f, 0) for p in zip(a, b)]
    monkeypatch.setattr(S, "BUCKET_SCAN", 1)
    cut = [tuple(map(int, p)) for a, b in finder.bucket(f, 0) for p in zip(a, b)]
    ok = lambda pairs: brute_roots(map(int, f), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    first = brute_roots(map(int, f), lambda a, b: bool(finder.linked(
        np.array([a ^ b], np.uint64), ((finder.top, np.uint64(1)),))[0]))
    assert ok(set(whole)) == first == ok(set(cut))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (500, 400), (400, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


DOCS = [
    (5, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "x"),
    (3, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "y"),
    (9, "nothing in common with any of the other texts here at all", None),
    (9, "nothing in common with any of the other texts here at all", None),
    (None, "a null id has a text of its own that is quite different", "z"),
    (2, None, None), (1, "", None), (8, " \t ", None), (None, None, "n")]


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    got = Counter(map(tuple, S.near_duplicates(docs).collect()))
    fp = [brute_fingerprint(t) for _, t, _ in DOCS]
    root = brute_roots(set(fp), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, _, _), f in zip(DOCS, fp):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    assert got == Counter((d, f"{f:016x}", least.get(root[f])) for (d, _, _), f in zip(DOCS, fp))


def test_one_per_group(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, fp string")
    kept = S.one_per_group(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(
        [DOCS[1], DOCS[2], DOCS[4], (1, "", None)])
    assert S.one_per_group(docs.limit(0)).count() == 0
    assert S.near_duplicates(docs.limit(0)).count() == 0
