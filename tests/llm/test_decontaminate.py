import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mentionkit.llm import decontaminate as D


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(text, items, window):
    """(words, hit flags, item ids) by trying every window at every place."""
    words = [w for w, _, _ in words_of(text)]
    hit, found = [False] * len(words), set()
    for item, own in items:
        own = [w for w, _, _ in words_of(own)]
        n = min(window, len(own))
        wins = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for j in range(len(words) - n + 1 if n else 0):
            if tuple(words[j:j + n]) in wins:
                found.add(item)
                hit[j:j + n] = [True] * n
    return words, hit, found


def tables(seed, window):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "été", "日本", "x1", "q"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i % 7, text(rng.randint(0, 3 * window))) for i in range(9)] + [(None, text(window)), (50, None), (51, "")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)]
    docs += [(100 + i, f"{text(3)} {items[i % 9][1]} {text(3)}") for i in range(20)]
    return docs + [(None, items[0][1]), (207, None), (208, ""), (208, "")], items


@pytest.mark.parametrize("block", [5, 100_000])
@pytest.mark.parametrize("window", [2, 3, 5])
def test_overlaps_equal_brute_force(spark, window, block):
    docs, items = tables(window, window)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = D.overlaps(frame, bench, window, block).collect()
    want = Counter()
    for d, text in docs:
        words, hit, found = brute(text, items, window)
        want[d, len(words), sum(hit), tuple(sorted(str(i) for i in found if i is not None))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    by_id = {d: t for d, t in docs if d is not None}
    for r in got:
        if r.doc_id is not None:
            at = words_of(by_id[r.doc_id])
            assert [(s.start, s.end) for s in r.spans] == [(at[s.start][1], at[s.end - 1][2]) for s in r.runs]


@pytest.mark.parametrize("block", [5, 100_000])
def test_decontaminate_leaves_nothing_and_keeps_clean_texts(spark, block):
    docs, items = tables(11, 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(frame, bench, 3, 0.8, block)
    assert got.columns == frame.columns
    rows = Counter((r.doc_id, r.text) for r in got.collect())
    kept = {d for d, _ in rows}
    for d, text in docs:
        words, hit, _ = brute(text, items, 3)
        if not any(hit):
            assert rows[d, text]
        else:
            assert (d in kept) == (sum(hit) < 0.8 * len(words))
    for _, text in rows:
        assert not any(brute(text, items, 3)[1])


def test_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b c " * 400_000), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.doc_id, r.n_words, r.n_hit) for r in D.overlaps(docs, none).collect()} == {(1, 1_200_000, 0), (2, 0, 0)}
    bench = spark.createDataFrame([(1, "c a b c a b c a b c a")], "item_id long, text string")
    assert D.overlaps(docs.limit(0), bench).count() == 0
    assert {(r.doc_id, r.n_hit) for r in D.overlaps(docs, bench).collect()} == {(1, 1_200_000), (2, 0)}
    assert [r.doc_id for r in D.decontaminate(docs, bench).collect()] == [2]


def test_query_digest(spark, tmp_path):
    from mentionkit.llm.catalog import QUERIES
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, f"x {item.upper()} y"), (2, None)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, item), (9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_decontaminate"](spark, str(tmp_path)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (13, 11, 2, True)
    assert got[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    assert (got[2].n_words, got[2].contaminated, got[2].items_sha256) == (0, False, hashlib.sha256(b"").hexdigest())
