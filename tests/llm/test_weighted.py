import hashlib
import math
import random
import struct
from collections import Counter

import xxhash

from mentionkit.llm import weighted as W

ODD = [None, "", " \t\n", "one", "one one one", "Ünïcode 日本語 x" * 3, "a b c a b a " * 40, "x" * 50_000, "w " * 30_000]


def words_of(text):
    return [w for w in (text or "").encode().split() if w]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def draws(term, number):
    def uniform(i):
        h = xxhash.xxh64_intdigest(struct.pack("<q", term ^ signed((i + 1) * W._STEP % (1 << 64))), 42)
        return ((h >> (64 - W.VALUE_BITS)) + 0.5) * 2.0 ** -W.VALUE_BITS
    p, q, u = -math.log(uniform(3 * number)), -math.log(uniform(3 * number + 1)), uniform(3 * number + 2)
    s = p / (p + q)
    r = -math.log(u) - math.log(s)
    return p + q, r, -math.log(u) / r       # c, r, b of the method


def plain_samples(text, samples):
    """The textbook form: the smallest a = c / (y e^r) of all terms."""
    bag, out = Counter(words_of(text)), []
    for k in range(samples):
        best = None
        for w, weight in bag.items():
            term = signed(xxhash.xxh64_intdigest(w, 42))
            c, r, b = draws(term, k)
            t = math.floor(math.log(weight) / r + b)
            a = c / (math.exp(r * (t - b)) * math.exp(r))
            best = min(best or (math.inf,), (a, term, t))
        out.append(best[1:] if best else None)
    return out


def likeness(a, b):
    if not a[0] or not b[0]:
        return float(not a[0] and not b[0])
    return sum(x == y for x, y in zip(a, b)) / len(a)


def generalised_jaccard(a, b):
    a, b = Counter(words_of(a)), Counter(words_of(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, samples):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        own = plain_samples(text, samples)
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(),
                       likeness(own, plain_samples(edited, samples)), likeness(own, plain_samples(after, samples)))
    return out


def collected(df):
    return [r for r in df.collect()]


def test_equals_the_textbook_form(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(3 * i, " ".join(rng.choices(vocabulary[:rng.choice([5, 60])], k=rng.randrange(0, 120)))) for i in range(25)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD[:7])] + [(-5, "negative id"), (2 ** 62, rows[3][1]), (None, "no id at all")]
    rng.shuffle(rows)
    want = brute(rows, 8)
    got = collected(W.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 8))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == want[r.doc_id]
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_share_of_equal_samples_estimates_generalised_jaccard(spark):
    rng = random.Random(2)
    rows = []
    for i in range(12):
        common = [f"c{i}_{j}" for j in range(30) for _ in range(rng.choice([1, 1, 2, 5, 20]))]
        cut = rng.randrange(len(common))
        rows.append((i, " ".join(common), " ".join(common[:cut] + ["other"] * rng.randrange(1, 40))))
    table = spark.createDataFrame(rows, "i int, a string, b string")
    side = [W.signatures(W.word_terms(table.select("i", c), c), ["i"], 100).toPandas().set_index("i").fingerprint for c in "ab"]
    errors = []
    for i, a, b in rows:
        parts = [[s[i][at:at + W.DIGITS] for at in range(0, len(s[i]), W.DIGITS)] for s in side]
        errors.append(sum(x == y for x, y in zip(*parts)) / 100 - generalised_jaccard(a, b))
    assert max(map(abs, errors)) < 0.18 and abs(sum(errors)) / len(errors) < 0.05


def test_fractional_weights_scale_free(spark):
    terms = spark.createDataFrame([(i, t, w * f) for i, f in ((0, 0.25), (1, 0.25), (2, 3.7)) for t, w in ((11, 1.0), (12, 2.0), (13, 0.5))],
                                  "i int, term long, weight double")
    got = {r.i: r.fingerprint for r in W.signatures(terms, ["i"], 16).collect()}
    assert got[0] == got[1] and len(got[2]) == 16 * W.DIGITS


def test_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(4, ODD[4], "again"), (4, "same id, other text", "x"), (None, None, None), (None, "b", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = collected(W.edited_fingerprints(table, 4))
    assert len(got) == len(rows)
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t, _ in rows)
    assert all(r.fingerprint == "" for r in got if r.doc_id in (0, 1, 2)) and len({r.fingerprint for r in got}) > 4
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert W.edited_fingerprints(table.limit(0)).count() == 0
    alone = W.edited_fingerprints(spark.createDataFrame([(7, "one two three four")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"one two threone tw").hexdigest()


def test_a_hot_id_and_hot_copies(spark):
    rows = [(9, "hot copy text")] * 300 + [(None, f"null id {i}") for i in range(300)] + [(i, f"text {i} own") for i in range(10, 300)]
    got = collected(W.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 4))
    assert len(got) == len(rows) and sum(r.doc_id == 9 for r in got) == 300 and sum(r.doc_id is None for r in got) == 300


def test_no_python_in_the_plan(spark, capsys):
    from mentionkit.llm.catalog import QUERIES
    QUERIES["op11_fingerprints"](spark, "/root/testdata/sf0.001").explain()
    assert not any(w in capsys.readouterr().out for w in ("Arrow", "Python", "Pandas"))
