from pyspark.sql import functions as F

from mentionkit.operators.align import align_targets, mention_targets
from mentionkit.operators.annotate import annotate, tokenize_words
from mentionkit.operators.phrase import hit_summary, phrase_hits, phrase_lemmas

T1 = ("Zoe Telford -- played the police officer girlfriend of Simon, Maggie. Dumped by Simon in the final "
      "episode of series 1, after he slept with Jenny, and is not seen again. Phoebe Thomas played Cheryl "
      "Cassidy, Pauline's friend and also a year 11 pupil in Simon's class. Dumped her boyfriend following "
      "Simon's advice after he wouldn't have sex with her but later realised this was due to him catching "
      "crabs off her friend Pauline.")


def _passage(spark, text, doc_id=1):
    return spark.createDataFrame([(doc_id, text)], "doc_id long, text string")


def test_words_concatenate_back_and_offsets(spark):
    w = tokenize_words(_passage(spark, T1)).orderBy("wi").collect()
    assert all(T1[r["o"]:r["o"] + len(r["word"])] == r["word"] for r in w)
    assert w[0]["idx"] == 1 and w[0]["sent"] == 0
    assert sum(len(r["word"]) for r in w) == len(T1.replace(" ", ""))


def test_offset_alignment_and_repair(spark):
    words = annotate(_passage(spark, "x He said it"))
    t = spark.createDataFrame([(1, 1, "P", 0, "He", 1), (2, 1, "P", 1, "He", 1), (3, 1, "P", 3, "He", 1),
                               (4, 1, "P", 40, "it", 1)],
                              "id long, doc_id long, role string, off int, target string, target_len int")
    got = {r["id"]: r["wi"] for r in align_targets(t, words).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: None}


def test_target_stacking(spark):
    m = spark.createDataFrame([(1, 1, "her", 3, "Cheryl Cassidy", 10, "Pauline", 20)],
                              "id long, doc_id long, pronoun string, pronoun_offset int, a string, a_offset int, "
                              "b string, b_offset int")
    rows = {r["role"]: (r["target"], r["target_len"]) for r in mention_targets(m).collect()}
    assert rows == {"P": ("her", 1), "A": ("Cheryl", 2), "B": ("Pauline", 1)}


def test_phrase_search_counts(spark):
    words = annotate(_passage(spark, T1))
    ph = spark.createDataFrame([(1, 1, "her"), (2, 1, "Pauline"), (3, 1, "Cheryl Cassidy"), (4, 1, "Nobody")],
                               "id long, doc_id long, phrase string")
    lem = phrase_lemmas(ph)
    got = {r["id"]: r["n_hits"] for r in hit_summary(lem, phrase_hits(lem, words)).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 0}


def test_phrase_search_uses_first_sentence_of_phrase(spark):
    words = annotate(_passage(spark, "Ann left. Bob came. Ann left. Ann stayed."))
    ph = spark.createDataFrame([(1, 1, "Ann left. Bob"), (2, 1, "ann")], "id long, doc_id long, phrase string")
    lem = phrase_lemmas(ph)
    assert {r["id"]: r["lemmas"] for r in lem.collect()} == {1: ["ann", "left", "."], 2: ["ann"]}
    got = {r["id"]: (r["n_hits"], r["first_hit"]) for r in hit_summary(lem, phrase_hits(lem, words)).collect()}
    assert got == {1: (2, 0), 2: (3, 0)}
