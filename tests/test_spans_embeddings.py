from conftest import make_targets, make_words

from mentionkit.operators import windows as W
from mentionkit.operators import wordpiece as WP
from mentionkit.plans import standins as ST

# three sentences; idx restarts at 1; governors inside the sentence
TEXT_WORDS = [("Ann", 1, 2), ("met", 2, 0), ("Bob", 3, 2), (".", 4, 2),
              ("Then", 1, 2), ("she", 2, 0), ("left", 3, 2), (".", 4, 2),
              ("Carl", 1, 0), ("stayed", 2, 1), (".", 3, 1)]


def _ctx(spark):
    rows = [(w, "X", "X", i, g, "dep") for w, i, g in TEXT_WORDS]
    words = make_words(spark, rows)
    text = " ".join(w for w, _, _ in TEXT_WORDS)
    passages = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return words, passages


def test_scope_spans_first_to_last_target_sentence(spark):
    words, passages = _ctx(spark)
    t = make_targets(spark, [(1, "P", 5, 1), (1, "A", 0, 1), (1, "B", 8, 1)])
    assert W.scope_text(t, words, passages).first()["scope"] == "Ann met Bob. Then she left. Carl stayed."
    # the last target is the first word of its sentence: its whole sentence is kept
    t2 = make_targets(spark, [(1, "P", 5, 1), (1, "A", 4, 1), (1, "B", 5, 1)])
    assert W.scope_text(t2, words, passages).first()["scope"] == "Then she left."
    t3 = make_targets(spark, [(1, "P", 5, 1), (1, "A", 4, 1), (1, "B", 5, 1)])
    assert W.scope_text(t3, words, passages, from_scope_start=False).first()["scope"] == "Ann met Bob. Then she left."


def test_text_before_pronoun(spark):
    words, passages = _ctx(spark)
    # 'left' (idx 3, governor 2) -> starts at its governor 'she'
    t = make_targets(spark, [(1, "P", 6, 1), (1, "A", 0, 1), (1, "B", 2, 1)])
    assert W.text_before_pronoun(t, words, passages).first()["before"] == "she"
    # 'she' is its sentence's root -> starts at the sentence start
    t = make_targets(spark, [(1, "P", 5, 1), (1, "A", 0, 1), (1, "B", 2, 1)])
    assert W.text_before_pronoun(t, words, passages).first()["before"] == "Then"


def test_pooling_sums_pronoun_and_averages_candidates(spark):
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    matched = spark.createDataFrame([(1, "P", 0, "ab"), (1, "P", 1, "a"), (1, "A", 0, "ab"), (1, "A", 1, "a")],
                                    "id long, role string, wi int, piece string")
    # vec_id = (7 wi + len) mod 4 -> P/A pieces map to 2 and 0
    got = {r["role"]: (r["n_pieces"], [round(v, 6) for v in r["vec"]])
           for r in WP.pool_spans(ST.with_vectors(matched, emb)).collect()}
    assert got == {"P": (2, [2.0, 2.0]), "A": (2, [1.0, 1.0])}


def test_cosine_features(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    chosen = spark.createDataFrame([(1, "P", 1, 0, "x"), (1, "A", 2, 0, "xx"), (1, "B", 3, 0, "y")],
                                   "id long, role string, j int, wi int, piece string")
    r = WP.cosine_features(ST.with_vectors(chosen, emb)).first()
    # P -> vec 1 (len 1), A -> vec 2 (len 2), B -> vec 1
    assert abs(r["cos_pa"] - 2 ** -0.5) < 1e-9 and abs(r["cos_pb"] - 1.0) < 1e-9


def test_roles_side_by_side_on_every_layer(spark):
    rows = [(1, "P", 0, [1.0, 2.0]), (1, "P", 0, [3.0, 4.0]), (1, "B", 0, [5.0, 7.0]), (1, "B", 0, [6.0, 8.0]),
            (1, "A", 1, [9.0, 9.5])]
    pooled = WP.pool_spans(spark.createDataFrame(rows, "id long, role string, layer int, vector array<double>"))
    got = {r["layer"]: r["vec"] for r in WP.concat_roles(pooled).collect()}
    assert got == {0: [4.0, 6.0, 0.0, 0.0, 5.5, 7.5], 1: [0.0, 0.0, 9.0, 9.5, 0.0, 0.0]}


def test_cosine_features_give_the_vectors_too(spark):
    v = spark.createDataFrame([(1, "P", [1.0, 0.0]), (1, "A", [0.0, 2.0])], "id long, role string, vector array<double>")
    r = WP.cosine_features(v, with_vectors=True).first()
    assert (r["cos_pa"], r["cos_pb"], r["p"], r["a"], r["b"]) == (0.0, None, [1.0, 0.0], [0.0, 2.0], None)
