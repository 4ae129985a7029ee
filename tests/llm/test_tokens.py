import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mentionkit.llm import tokens as T


@pytest.fixture(scope="module")
def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T.Vocabulary(f.read(), T.PATTERN).encoder()


def brute(text, sections, encoding, rule):
    """Attribution byte by byte."""
    data = text.encode()
    owner = [None] * len(data)
    for k, (a, b) in enumerate(sections):
        x, y = len(text[:a].encode()), len(text[:b].encode())
        owner[x:y] = [k] * (y - x)
    got, crossing, at = [0.0] * len(sections), [0] * len(sections), 0
    tokens = encoding.encode_ordinary(text)
    for t in tokens:
        n = len(encoding.decode_single_token_bytes(t))
        held = owner[at:at + n]
        at += n
        for k in set(held) - {None}:
            crossing[k] += len(set(held)) > 1
        if rule == "first":
            winner = held[0]
        elif rule == "most":
            # runs in order, so that gaps compete part by part and the earlier of equals wins
            runs, best = [], (0, None)
            for k in held:
                if runs and runs[-1][1] == k:
                    runs[-1][0] += 1
                else:
                    runs.append([1, k])
            for size, k in runs:
                if size > best[0]:
                    best = (size, k)
            winner = best[1]
        else:
            for k in set(held) - {None}:
                got[k] += held.count(k) / n
            continue
        if winner is not None:
            got[winner] += 1
    return len(tokens), got, crossing


@pytest.mark.parametrize("rule", T.RULES)
def test_attribution_equals_brute_force(encoder, rule):
    rng = random.Random(rule)
    words = ["the ", "internationalisation", " été", "\n", "\n\n", " 日本語", "🙂", "x", " ", "12345", "  ", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choices(words, k=rng.randint(0, 9)))
        cuts = sorted(rng.choices(range(len(text) + 1), k=2 * rng.randint(0, 4)))
        sections = list(zip(cuts[::2], cuts[1::2]))
        total, got, crossing = T.attribute(text, sections, *encoder, rule)
        want = brute(text, sections, encoder[0], rule)
        assert total == want[0]
        assert got.tolist() == pytest.approx(want[1])
        assert crossing.tolist() == want[2]


def test_spans_cover_the_text_exactly(encoder):
    text = "Zoë’s 日本 🙂 text\nwith lines " * 2000 + "a" * 200_000
    total, got, _ = T.attribute(text, [(0, len(text))], *encoder)
    assert got.tolist() == [total] == [len(encoder[0].encode_ordinary(text))]


DOCS = [(1, "src", "en", "one line\ntwo lines\n", "x"), (2, None, None, None, None), (3, "s", "", "", "y"),
        (None, "s", "de", "é\n\n🙂 end", "z"), (1, "src", "en", "one line\ntwo lines\n", "x")]


@pytest.mark.parametrize("rule", T.RULES)
def test_fields_and_lines(spark, encoder, rule):
    docs = spark.createDataFrame(DOCS, "doc_id long, source string, lang string, text string, sections string")
    vocabulary = T.broadcast_vocabulary(spark)
    rendered = T.with_fields_and_lines(docs, ["source", "lang"])
    got = T.token_counts(rendered, vocabulary, rule).collect()
    by = defaultdict(float)
    for r in got:
        by[r.doc_id] += r.tokens
    for d, source, lang, text, _ in DOCS:
        whole = "\n".join(x or "" for x in (source, lang, text))
        n = len(encoder[0].encode_ordinary(whole)) * sum(x[0] == d for x in DOCS)
        assert by[d] == pytest.approx(n)
    first = [(r.section, r.part, r.start, r.end) for r in got if r.doc_id is None]
    assert first == [("source", 0, 0, 1), ("lang", 0, 2, 4), ("text", 0, 5, 7), ("text", 1, 7, 8), ("text", 2, 8, 13),
                     ("rest", 0, None, 13)]
    assert T.token_counts(rendered.limit(0), vocabulary, rule).count() == 0


def test_limits_nulls_and_overlaps(spark):
    vocabulary = T.broadcast_vocabulary(spark)
    kind = "doc_id long, text string, sections array<struct<section:string,part:int,start:int,end:int>>, tokens int"
    docs = spark.createDataFrame([(1, "some text", [("a", 0, -5, 4), ("b", 0, 4, None), ("c", 0, 99, 200)], 0),
                                  (2, "more", None, 0), (3, None, [("a", 0, None, None)], 0)], kind)
    got = {(r.doc_id, r.section): r.tokens for r in T.token_counts(docs, vocabulary).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 1, (1, "c"): 0, (1, "rest"): 0, (2, "rest"): 1, (3, "a"): 0, (3, "rest"): 0}
    bad = spark.createDataFrame([(1, "some text", [("a", 0, 0, 4), ("b", 0, 3, 9)], 0)], kind)
    with pytest.raises(Exception, match="overlap"):
        T.token_counts(bad, vocabulary).collect()
    with pytest.raises(ValueError):
        T.token_counts(docs, vocabulary, "last")


def test_lengths(spark, encoder):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    got = T.lengths(docs.withColumn("size", F.lit(1)), T.broadcast_vocabulary(spark)).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(1, 2), (2, 0), (3, 0)]


def test_long_white_space_gives_the_same_tokens(monkeypatch):
    rng = random.Random(3)
    encoder, _ = T.Vocabulary(open(T.VOCABULARY, "rb").read(), T.PATTERN).encoder()
    spaces = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000"]
    monkeypatch.setattr(T, "LONG_SPACE", 3)
    monkeypatch.setattr(T, "_LONG_SPACE", re.compile(f"[{T.SPACES}]{{3,}}"))
    for _ in range(3000):
        text = "".join("".join(rng.choices(spaces, k=rng.randrange(9))) + rng.choice(["a", "don't", "9", "!", "語", "\x1c", "\u200b", ""])
                       for _ in range(rng.randrange(1, 6)))
        assert T.encode(encoder, text) == encoder.encode_ordinary(text)


def test_millions_of_blanks_line_ends_and_letters(spark):
    texts = [" " * 5_000_000, "word" + "\n" * 5_000_000 + "word", "x" * 5_000_000, "a\t" + " \n" * 500_000 + " b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = {r.doc_id: r.length for r in T.lengths(docs, T.broadcast_vocabulary(spark)).select("doc_id", "length").collect()}
    assert all(0 < n[i] <= len(t) for i, t in enumerate(texts))
    sections = docs.withColumn("sections", F.expr("array(struct('all' as section, 0 as part, 0 as start, cast(null as int) as end))"))
    got = T.token_counts(sections, T.broadcast_vocabulary(spark)).filter("section = 'all'").collect()
    assert {r.doc_id: r.tokens for r in got} == n
