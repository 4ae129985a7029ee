from collections import Counter

from conftest import make_targets, make_words

from mentionkit.operators import tree as TR

# sentence 1: idx 1..6, root idx 2; sentence 2: idx 1..3, root idx 1
ROWS = [("a", "NOUN", "NN", 1, 2, "nsubj"), ("b", "VERB", "VBD", 2, 0, "root"),
        ("c", "NOUN", "NN", 3, 2, "obj"), ("d", "ADJ", "JJ", 4, 3, "amod"),
        ("e", "DET", "DT", 5, 3, "det"), ("her", "PRON", "PRP$", 6, 4, "nmod:poss"),
        ("f", "VERB", "VB", 1, 0, "root"), ("g", "NOUN", "NN", 2, 1, "obj"), ("h", "NOUN", "NN", 3, 1, "obl")]


def _bag(spark, wi):
    w = make_words(spark, ROWS)
    t = make_targets(spark, [(1, "P", wi, 1)])
    return Counter(f"{r['tag']}_{r['relation']}" for r in TR.dependency_bag(t, w, "UPOS").collect())


def test_bag_of_inner_word(spark):
    assert _bag(spark, 2) == Counter(["VERB_governor", "NOUN_sibling", "ADJ_child", "DET_child", "PRON_grandchild"])


def test_bag_of_root_has_only_descendants(spark):
    assert _bag(spark, 1) == Counter(["NOUN_child", "NOUN_child", "ADJ_grandchild", "DET_grandchild"])


def test_bag_with_ancestor_and_no_sibling(spark):
    assert _bag(spark, 5) == Counter(["ADJ_governor", "NOUN_ancestor"])


def test_children_stay_in_sentence(spark):
    assert _bag(spark, 0) == Counter(["VERB_governor", "NOUN_sibling", "ADJ_sibling_child", "DET_sibling_child"])


def test_same_sentence_and_possessive(spark):
    w = make_words(spark, ROWS)
    t = make_targets(spark, [(1, "P", 5, 1), (1, "A", 7, 1), (1, "B", 8, 1)])
    ss = TR.same_sentence(t, w).first()
    assert (ss["same_pa"], ss["same_pb"], ss["same_ab"]) == (False, False, True)
    f2 = TR.relational_features(t, w).first()
    assert f2["possessive"] == 1 and f2["dist_a"] == 2 and f2["dist_b"] == 3
