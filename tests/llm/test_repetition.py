import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionkit.llm import repetition as R


def brute_reach(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def brute(text, least):
    words = [w.decode() for w in (text or "").encode().split()]
    reach = brute_reach(words)
    cover = lambda least, most: len({p for i, m in enumerate(reach) if m >= least for p in range(i, i + min(m, most))})
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, cover(5, 5),
            cover(least, 10 ** 9), max(reach, default=0))


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = rng.choice([["a", "b"], ["a", "b", "é", "日本", "#x|"], [str(i) for i in range(60)]])
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))))
    return out


def test_longest_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        words = rng.choices("abc" if rng.random() < 0.5 else "ab", k=rng.randint(1, 40))
        ids = np.array([ord(w) for w in words], np.int64)
        assert R.longest_repeats(ids, np.full(len(ids), len(ids))).tolist() == brute_reach(words)


@pytest.mark.parametrize("pack", [1, 50, 100_000])
def test_measure_equals_brute_force(pack, monkeypatch):
    monkeypatch.setattr(R, "PACK_WORDS", pack)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", *texts(2, 80), ""])]
    packs = R._packs((i, t.encode() if t is not None else None) for i, t in rows)
    got = [r for p in packs for r in R.measure(p, 6)]
    assert got == [(i, *brute(t, 6)) for i, t in rows]


def test_very_long_texts():
    passage = " ".join(str(i) for i in range(100_000))
    (row,) = R.measure([R.read_text((1,), f"{passage} x {passage}".encode())])
    assert row[1] == 200_001 and row[6] == 200_000 and row[7] == 100_000
    (row,) = R.measure([R.read_text((1,), b"a " * 300_000)])
    assert row[1:] == (300_000, 300_000, 0, 0, 300_000, 300_000, 299_999)


def test_rules(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(str(rng.getrandbits(60)) for _ in range(n))
    passage, long = fresh(30), fresh(60)
    cases = {1: (fresh(50), False, True), 2: (fresh(9), True, False), 3: (None, True, False), 4: ("", True, False),
             5: (f"{passage} {fresh(150)} {passage}", True, False),       # 28 % repeated
             6: (f"{passage} {fresh(400)} {passage}", False, False),      # 13 % covered
             7: (f"{passage} {fresh(4000)} {passage}", False, True),
             8: (f"{long} {fresh(9000)} {long}", False, False),           # longest repeat
             9: (f"{fresh(100)} Licensed under the license\n{fresh(50)} Licensed under the license", False, True)}
    rows = [(i, t, "clash") for i, (t, _, _) in cases.items()] + [(1, cases[1][0], None), (None, cases[7][0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumn("kept", F.lit(1))
    got = Counter((r.doc_id, r.base_failed, r.kept) for r in R.repetition(docs).collect())
    assert got == Counter([*((i, b, k) for i, (_, b, k) in cases.items()), (1, False, True), (None, False, True)])
    assert R.repetition(docs.limit(0)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    import duckdb
    from mentionkit.llm.catalog import QUERIES, SQL
    rows = [(i, t) for i, t in enumerate([None, "", *texts(5, 60), *(t * 3 for t in texts(6, 20))])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_quality_rules"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(SQL["op10_quality_rules"]).df()
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).itertuples(index=False)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
