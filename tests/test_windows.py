from conftest import make_targets, make_words

from mentionkit.operators import vectorize as V
from mentionkit.operators import windows as W

TAGS = ["NN", "VB", "JJ", "DT", "IN", "NNP", "RB", "CC", "CD", "PRP"]


def _words(spark, n=20):
    rows = [(f"w{i}", "NOUN", TAGS[i % len(TAGS)], i + 1, 0 if i == 0 else 1, "dep") for i in range(n)]
    return make_words(spark, rows)


def _win(spark, wi, tl=1, n=5, kind="XPOS"):
    w = _words(spark)
    t = make_targets(spark, [(1, "P", wi, tl)])
    rows = W.tag_window(t, w, n, kind).orderBy("k").collect()
    return [r["tag"] for r in rows]


def test_window_length_mid_text(spark):
    tags = _win(spark, 10)
    assert len(tags) == 11
    assert tags == [TAGS[i % 10] for i in range(5, 16)]


def test_window_start_of_text_pads_bos(spark):
    tags = _win(spark, 0)
    assert len(tags) == 11 and tags[:5] == ["BOS"] * 5 and tags[5] == TAGS[0]


def test_window_target_len_two_skips_second_word(spark):
    tags = _win(spark, 10, tl=2)
    expect = [TAGS[i % 10] for i in list(range(5, 11)) + list(range(12, 17))]
    assert tags == expect


def test_window_end_pads_eos_then_absent(spark):
    tags = _win(spark, 18)                 # 19 real, then 4 EOS
    assert len(tags) == 11 and tags[-4:] == ["EOS"] * 4
    assert len(_win(spark, 18, tl=3)) == 10   # a slice of the padded list: one position absent


def test_ngrams(spark):
    w = _words(spark)
    t = make_targets(spark, [(1, "P", 10, 1)])
    grams = [r["gram"] for r in W.tag_ngrams(t, w, 5, 2, "XPOS").orderBy("s").collect()]
    assert len(grams) == 11
    assert grams == [f"{TAGS[i % 10]}_{TAGS[(i + 1) % 10]}" for i in range(5, 16)]


def test_positional_features(spark):
    w = _words(spark)
    t = make_targets(spark, [(1, "P", 10, 1)])
    feats = [r["feature"] for r in W.positional_window(t, w, 3, "XPOS").orderBy("k").collect()]
    assert feats[0] == f"{TAGS[7]}_-3" and feats[3] == f"{TAGS[0]}_0" and len(feats) == 7


def test_vocabulary_widths():
    assert len(V.vocabulary("normal", "UPOS")) == 18
    assert len(V.vocabulary("ngram", "UPOS")) == 361
    assert len(V.vocabulary("position", "UPOS")) == 209
    assert len(V.vocabulary("dependency", "UPOS")) == 108
    assert len(V.vocabulary("normal", "XPOS")) == 36


def test_xpos_bag_counts_two_targets(spark):
    w = _words(spark)
    t = make_targets(spark, [(1, "P", 10, 1), (1, "A", 10, 2)])
    bag = W.tag_window(t, w, 5, "XPOS").selectExpr("id", "role", "tag as feature")
    counts = V.count_features(bag, "normal", "XPOS")
    assert counts.groupBy().sum("cnt").first()[0] == 22
    vecs = V.bag_vectors(bag, "normal", "XPOS").collect()
    assert all(r["vec"].size == 36 for r in vecs) and sum(r["vec"].toArray().sum() for r in vecs) == 22


def test_positions_beyond_vocabulary_drop_out(spark):
    w = _words(spark)
    t = make_targets(spark, [(1, "P", 10, 1)])
    counts = V.count_features(W.positional_window(t, w, 10, "UPOS"), "position", "UPOS")
    assert counts.groupBy().sum("cnt").first()[0] == 11
