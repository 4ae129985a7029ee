"""SURVEY §5 invariants on the fixture derived from the driver tables."""
from pyspark.sql import functions as F

from mentionkit.operators import windows as W
from mentionkit.plans.fixture import load_context

SF = "/root/testdata/sf0.001"


def test_windows_have_2n_plus_1_tags(spark):
    cx = load_context(spark, SF)
    sizes = W.tag_window(cx.targets, cx.near_words).groupBy("id", "role").count()
    assert sizes.where("count <> 11").count() == 0
    assert sizes.count() == cx.targets.count()


def test_aligned_words_equal_the_text_at_their_offset(spark):
    cx = load_context(spark, SF)
    t = (cx.targets.join(cx.corpus.words.select("doc_id", "wi", "word", "o"), ["doc_id", "wi"])
         .join(cx.corpus.mentions.select("id", "text"), "id"))
    at_offset = F.substr("text", F.col("off") + 1, F.length("word"))
    bad = t.where((F.col("o") != F.col("off")) | (at_offset != F.col("word")))
    assert t.count() == cx.targets.count() and bad.count() == 0
