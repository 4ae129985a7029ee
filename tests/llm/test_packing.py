import itertools
import random
from collections import Counter, defaultdict

import pytest

from mentionkit.llm import packing as P


def cost(bins, overhead):
    return sum(c + overhead for c, _ in bins)


def check(pieces, bins, capacities):
    assert Counter(p for _, held in bins for p in held) == Counter(pieces)
    for c, held in bins:
        used = sum(n for n, _ in held)
        assert held and used <= c
        assert c == min(x for x in capacities if x >= used)  # cut down to its contents


def test_random_packings_are_whole_and_cut_down():
    rng = random.Random(1)
    for _ in range(200):
        capacities = tuple(rng.sample(range(4, 60), rng.randint(1, 4)))
        pieces = [(rng.randint(0, max(capacities)), (i, 0)) for i in range(rng.randint(0, 60))]
        check(pieces, P.pack(pieces, capacities, rng.choice([0, 1, 8])), capacities)


def test_close_to_the_optimum_of_small_cases():
    rng = random.Random(2)
    capacities, overhead = (6, 10, 16), 1
    total = best = 0
    for _ in range(40):
        sizes = [rng.randint(1, 16) for _ in range(7)]
        least = None
        for labels in itertools.product(range(4), repeat=7):
            held = defaultdict(int)
            for s, b in zip(sizes, labels):
                held[b] += s
            if max(held.values()) <= 16:
                c = sum(min(x for x in capacities if x >= u) + overhead for u in held.values())
                least = c if least is None else min(least, c)
        if least is None:
            continue
        mine = cost(P.pack([(s, (i, 0)) for i, s in enumerate(sizes)], capacities, overhead), overhead)
        assert mine <= 1.4 * least
        total, best = total + mine, best + least
    assert total <= 1.1 * best


def test_several_lengths_beat_each_alone():
    rng = random.Random(3)
    pieces = [(int(rng.lognormvariate(5.5, 1)) % 4096 + 1, (i, 0)) for i in range(3000)]
    joint = cost(P.pack(pieces, (512, 1024, 2048, 4096), 16), 16)
    alone = cost(P.pack(pieces, (4096,), 16), 16)
    assert joint <= alone and joint <= 1.02 * sum(n for n, _ in pieces) + 17 * len(pieces) / 4


DOCS = [(1, 5, "x"), (2, 10, "x"), (2, 10, "x"), (3, 37, None), (4, 0, "y"), (5, None, "y"), (None, 7, "z"), (6, -4, "z"),
        (7, 30, "z")]


@pytest.mark.parametrize("block", [2, 1000])
def test_documents_are_packed_whole(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, length long, piece string")
    got = P.pack_documents(docs, (4, 10), 1, block).collect()
    tokens, pieces = Counter(), defaultdict(list)
    for r in got:
        tokens[r.doc_id] += r.length
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert tokens == Counter({1: 5, 2: 20, 3: 37, None: 7, 7: 30, 4: 0, 5: 0, 6: 0})
    assert sorted(pieces[3]) == [(0, 0, 10), (1, 10, 10), (2, 20, 10), (3, 30, 7)]
    assert sorted(pieces[7]) == [(0, 0, 10), (1, 10, 10), (2, 20, 10)] and sorted(pieces[4]) == [(0, 0, 0)]
    by = defaultdict(list)
    for r in got:
        by[r.sequence].append(r)
    for rows in by.values():
        used = sum(r.length for r in rows)
        assert {(r.capacity, r.used) for r in rows} == {(4 if used <= 4 else 10, used)}
        assert sorted(r.piece_order for r in rows) == list(range(len(rows)))
    assert P.pack_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.pack_documents(docs, ())
