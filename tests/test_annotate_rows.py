"""Words by tasks over whole passages, the words near places, and what a job stages."""
import os
import re
import tempfile

import pytest

from mentionkit.operators import annotate as A
from mentionkit.operators.align import targets_of
from mentionkit.plans.fixture import load_corpus, neighbourhood_words
from mentionkit.session import shared_folder

TEXTS = [(3, "Ann met Bob.  Then she  left! Why? \n"), (1, ""), (2, None), (4, "  x.y"), (5, "One two. " * 40), (6, "Zoë's 日本 1.5 cafés")]


def _by_hand(texts):
    """The running quantities, word by word; rows of one key take turns."""
    out, by = [], {}
    for d, t in texts:
        by.setdefault(d, []).append(re.findall(r"\w+|[ \t\r\n]+|[^\w \t\r\n]", t or ""))
    for d, many in by.items():
        toks = [m[i] for i in range(max(map(len, many))) for m in many if i < len(m)]
        o = wi = sent = nb = pb = lead = 0
        last = -1
        for t in toks:
            if t[0] in " \t\r\n":
                lead = len(t)
            else:
                out.append((d, wi, sent, wi - last, o, o - lead, nb, pb, t))
                nb, pb, lead = nb + len(t), pb - (-len(t) // 4), 0
                if t in ".?!":
                    sent, last = sent + 1, wi
                wi += 1
            o += len(t)
    return sorted(out)


@pytest.mark.parametrize("texts,tokens", [(TEXTS, 200_000), (TEXTS, 3), (TEXTS + [TEXTS[0], TEXTS[3], TEXTS[0]], 5)])
def test_words_are_as_by_hand(spark, monkeypatch, texts, tokens):
    monkeypatch.setattr(A, "TOKENS", tokens)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, A.tokenize_words(df).collect())) == _by_hand(texts)


def test_only_texts_are_shuffled_and_sorted(spark):
    """No window over the tokens, no sort or exchange above them."""
    plan = A.annotate(spark.createDataFrame(TEXTS, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Window" not in plan and "Sort" not in above and "Exchange" not in above


@pytest.mark.parametrize("radius", [0, 3])
def test_words_near_places_hold_all_that_targets_and_neighbourhoods_read(spark, radius):
    docs = spark.createDataFrame([(d, (t or "") + " Ann Lee saw it. " * d) for d, t in TEXTS], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(d, d, texts[d], "it", texts[d].index("it."), "Ann Lee", texts[d].rindex("Ann Lee") + 8, True,
             "saw", texts[d].index("saw") - 1, False) for d in (1, 3, 5)]
    mentions = spark.createDataFrame(rows, "id long, doc_id long, text string, pronoun string, pronoun_offset int, a string, "
                                           "a_offset int, a_coref boolean, b string, b_offset int, b_coref boolean")
    from mentionkit.operators.align import mention_targets
    places = mention_targets(mentions).selectExpr("doc_id", "off", f"{A.REPAIR + radius} + target_len as reach")
    words, near = A.annotate(docs), A.rule_tags(A.tokenize_words(docs, places=places))
    got = sorted(map(tuple, near.collect()))
    assert set(got) <= set(map(tuple, words.collect())) and len(got) < words.count()
    whole, some = targets_of(mentions, words), targets_of(mentions, near)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, some.collect()))
    assert sorted(map(tuple, neighbourhood_words(words, whole, radius).collect())) == sorted(
        map(tuple, neighbourhood_words(near, some, radius).collect()))


def test_a_job_on_passages_stages_no_words(spark):
    folder = tempfile.mkdtemp(prefix="mk-docs-")
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    corpus = load_corpus(spark, folder)
    staged = f"{shared_folder(spark)}/staged"
    assert corpus.passages.count() == len(TEXTS)
    assert not any(corpus.key in f for f in (os.listdir(staged) if os.path.isdir(staged) else []))
    assert corpus.mentions.count() >= 0 and any(f.startswith("words-") and corpus.key in f for f in os.listdir(staged))


def test_large_staged_tables_are_not_broadcast(spark, monkeypatch):
    """A compressed table's file size says little about its rows; they must not meet on the driver."""
    from mentionkit.sources import staging
    key = os.path.basename(tempfile.mkdtemp(prefix="mk-size-"))
    small = staging.staged(spark, "size", key, lambda: spark.range(1000))
    plan = lambda t: spark.range(10**9).join(t, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small)
    monkeypatch.setattr(staging, "MOST_BROADCAST_BYTES", 100)
    large = staging.staged(spark, "size", key, lambda: spark.range(1000))
    assert "SortMergeJoin" in plan(large) and large.join(spark.range(5), "id").count() == 5


def test_words_stored_in_order_read_back_the_same(spark):
    from mentionkit.sources.staging import staged
    words = A.tokenize_words(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    back = staged(spark, "in-order", os.path.basename(tempfile.mkdtemp(prefix="mk-order-")), lambda: words, in_order=True)
    assert sorted(map(tuple, back.collect())) == _by_hand(TEXTS)


MANY = [(d, f"Then he saw {' '.join(names)} of the town. She left, Zoë {names[0]} said. " * (d % 3 + 1))
        for d, names in enumerate([["Ann", "Bob"], ["Ann"], ["Bob", "Carl", "Ann", "Dora"], ["Eve", "Fred", "Gil"]] * 3)]


@pytest.fixture(scope="module")
def odd_corpus(spark):
    """Passages that come twice, without id, without text, and with a negative id."""
    rows = MANY + [MANY[4], MANY[4], MANY[7], (MANY[4][0], None), (None, MANY[0][1]), (-3, MANY[2][1]), (90, None), (91, "")]
    folder = tempfile.mkdtemp(prefix="mk-odd-")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_mentions_come_from_the_marked_words_alone(spark, odd_corpus):
    """The same mentions as from a table of all words, which is neither staged nor shuffled for them."""
    from collections import Counter
    from mentionkit.plans.fixture import MENTION_COLUMNS, load_context, mention_fixture
    whole, corpus = load_corpus(spark, odd_corpus, stage=False), load_corpus(spark, odd_corpus)
    assert corpus.mentions.columns == MENTION_COLUMNS
    rows = lambda df: Counter(map(tuple, df.collect()))
    want = rows(mention_fixture(A.annotate(whole.passages), whole.passages).drop("text"))
    assert len(want) >= 9 and max(want.values()) == 4
    assert rows(corpus.spans.select(*whole.spans.columns)) == want == rows(corpus.mentions.drop("text"))
    cx = load_context(spark, odd_corpus)
    sizes = {r.doc_id: r.n_words for r in A.doc_sizes(whole.words).collect()}
    assert cx.targets.count() == 3 * sum(want.values()) and all(r.n_words == sizes[r.doc_id] for r in cx.targets.collect())
    assert cx.near_words.count() == cx.near_words.select("doc_id", "wi").distinct().count()
    assert not any(f.startswith(f"words-{corpus.key}") or f.startswith(f"near_words-12-{corpus.key}") for f in os.listdir(f"{shared_folder(spark)}/staged"))


def test_phrases_and_names_are_read_from_passages(spark, odd_corpus):
    """Phrase hits and scope names as from all words, of which only those asked for are shuffled."""
    from collections import Counter
    from mentionkit.operators import phrase as PH
    from mentionkit.operators import scorers as R
    from mentionkit.plans.fixture import load_context
    cx, words = load_context(spark, odd_corpus), A.annotate(load_corpus(spark, odd_corpus).passages)
    rows = lambda df: Counter(map(tuple, df.collect()))
    asked = spark.createDataFrame([(1, 4, "the town"), (2, 4, "HE saw Ann"), (3, 2, "zoë"), (4, 2, "Zoë bob"), (5, 77, "he"), (6, 3, "")],
                                  "id long, doc_id long, phrase string")
    ph = PH.phrase_lemmas(asked)
    some = cx.corpus.words_like(ph)
    assert rows(PH.phrase_hits(ph, some)) == rows(PH.phrase_hits(ph, words)) and 0 < some.count() < words.count() / 4
    assert rows(R.scope_name_counts(cx.targets, cx.near_words, cx.corpus.names())) == rows(R.scope_name_counts(cx.targets, words))
    assert not any(f.startswith(f"words-{cx.key}") for f in os.listdir(f"{shared_folder(spark)}/staged"))


def test_tokens_by_character_classes_equal_the_pattern(spark):
    """Texts of all scripts are cut in the task as Spark's own expression cuts them; marks keep few words."""
    import random
    import pyarrow as pa
    from pyspark.sql import functions as F
    from mentionkit import schema as S
    from mentionkit.plans.fixture import can_be_marked
    rng = random.Random(5)
    any_char = lambda: chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x30000)]))
    texts = [(i, "".join(rng.choice([any_char(), " ", "\n", "a", "Z", "_", "9", "."]) for _ in range(rng.randrange(60)))) for i in range(300)]
    df = spark.createDataFrame([*texts, (300, None), (301, ""), (302, " "), (303, "Ⅷ½ á  x")], "i long, t string").coalesce(1)
    rows = df.select("t", F.regexp_extract_all("t", F.lit(S.TOKEN_PATTERN), 0).alias("r")).collect()
    got = A._cut(pa.array([r.t for r in rows], pa.string()), A._classes(A.word_characters(spark)))
    assert got.to_pylist() == [r.r or [] for r in rows]
    assert "RegExpExtractAll" not in A.tokenize_words(df.toDF("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert can_be_marked(pa.array(["the", "HIS", "Ann", "An", "ann", "Éva", "12", "x"])).tolist() == [True, True, True, False, False, True, False, False]


def test_nearest_pieces_read_few_words_and_stage_none(spark, odd_corpus):
    from collections import Counter
    from mentionkit.operators import wordpiece as WP
    from mentionkit.plans import catalog_embed as CE
    from mentionkit.plans import standins as ST
    from mentionkit.plans.fixture import load_context
    cx = load_context(spark, odd_corpus)
    rows = lambda df: Counter(map(tuple, df.collect()))
    words = A.annotate(cx.corpus.passages)
    asked = WP.target_beginnings(cx.targets, cx.near_words).select("doc_id", "piece")
    assert 0 < cx.corpus.words_beginning(asked).count() < words.count() / 2
    assert rows(CE._nearest(cx)) == rows(WP.nearest_pieces(cx.targets, cx.near_words, ST.first_pieces(words)))
    assert not any(f.startswith(f"words-{cx.key}") for f in os.listdir(f"{shared_folder(spark)}/staged"))
