from pyspark.sql import functions as F

from mentionkit.operators import scorers as R
from mentionkit.operators import wordpiece as WP
from mentionkit.operators.annotate import annotate, annotate_with_plugin, tokenize_words
from mentionkit.plans import standins as ST


def test_annotator_plugin_parses_each_distinct_passage_once(spark):
    def _toy_parser():
        """A stand-in parser plug-in: whitespace words, one sentence, chain tree."""
        def parse(text):
            out, pos = [], 0
            for i, w in enumerate(text.split()):
                o = text.index(w, pos)
                pos = o + len(w)
                out.append({"idx": i + 1, "o": o, "word": w, "lemma": w.lower(), "upos": "X", "xpos": "X",
                            "governor": i, "deprel": "dep" if i else "root"})
            return out
        return parse

    p = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d e")], "doc_id long, text string")
    w = annotate_with_plugin(p, _toy_parser, key="toy").orderBy("doc_id", "wi").collect()
    assert [(r["doc_id"], r["wi"], r["word"], r["sent"], r["governor"]) for r in w] == [
        (1, 0, "a", 0, 0), (1, 1, "b", 0, 1), (1, 2, "c", 0, 2), (2, 0, "d", 0, 0), (2, 1, "e", 0, 1)]


def test_next_word_plugin_feeds_top_predictions(spark):
    prompts = spark.createDataFrame([(1, "Ann met Bob. Ann left.")], "id long, prompt string")

    def factory():
        return lambda ps: [[("Ann", 2.0), ("Bob", 1.0)] for _ in ps]

    top = R.top_predictions(R.predict_with_plugin(prompts, factory, key="toy-lm")).orderBy("rank").collect()
    assert [r["token"] for r in top] == ["Ann", "Bob"]
    assert abs(sum(r["prob"] for r in top) - 1) < 1e-12 and top[0]["prob"] > top[1]["prob"]


def test_packing_flags_overlong_without_truncating(spark):
    p = spark.createDataFrame([(1, "short text"), (2, " ".join(["word"] * 600))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in WP.pack_features(ST.piece_array(p), ST.piece_id).collect()}
    assert rows[1]["reason"] is None and len(rows[1]["input_ids"]) == 512 and rows[1]["tokens"][0] == "[CLS]"
    assert sum(rows[1]["input_mask"]) == rows[1]["n_tokens"]
    assert rows[2]["reason"] is not None and rows[2]["n_tokens"] == 602 and len(rows[2]["input_ids"]) == 602


def test_running_piece_offsets_equal_closed_form(spark):
    p = spark.createDataFrame([(1, "Abcdefghij kl, mnopq.\nRst uvwxyzab!")], "doc_id long, text string")
    win = {(r["wi"], r["piece"]): r["pos"] for r in WP.piece_offsets(ST.piece_array(p)).collect()}
    closed = {(r["wi"], r["piece"]): r["pos"] for r in ST.near_pieces(tokenize_words(p)).collect()}
    assert win == closed and ("0", "abcd") not in win and win[(0, "##efgh")] == 4


def test_scorer_registry(spark):
    m = spark.createDataFrame([(1, "she", "Ann", "Bob", True, False)],
                              "id long, pronoun string, a string, b string, a_coref boolean, b_coref boolean")
    out = m.transform(R.get_scorer("constant")).first()
    assert (out["p_a"], out["p_b"], out["p_neither"]) == (0.33333, 0.33333, 0.33333)
    R.register_scorer("always_a", lambda df: df.select("id", F.lit(1.0).alias("p_a"), F.lit(0.0).alias("p_b"),
                                                       F.lit(0.0).alias("p_neither")))
    assert m.transform(R.get_scorer("always_a")).first()["p_a"] == 1.0


def test_plugin_words_align_and_join_like_built_in_ones(spark):
    """A plug-in that repeats the built-in rules gives the built-in table, and J8, W1 and F1 run on it."""
    from mentionkit.operators import align, tree, windows
    rows = [(1, "Ann met Bob. She left,  he\tstayed!"), (2, "Ann met Bob. She left,  he\tstayed!"), (3, "He saw Eve."), (4, None)]
    p = spark.createDataFrame(rows, "doc_id long, text string")
    built_in = annotate(p)
    known = {(r["doc_id"], r["wi"]): r for r in built_in.collect()}
    by_text = {t: [known[d, i].asDict() for i in range(sum(k[0] == d for k in known))] for d, t in rows if t}

    def factory():
        return lambda text: by_text.get(text, [])

    words = annotate_with_plugin(p, factory, key="same-rules")
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, built_in.select(*words.columns).collect()))
    m = spark.createDataFrame([(10, 1, "She", 13, "Ann", 0, "Bob", 8)], "id long, doc_id long, pronoun string, "
                              "pronoun_offset int, a string, a_offset int, b string, b_offset int")
    for use in (lambda w: align.targets_of(m, w), lambda w: windows.tag_window(align.targets_of(m, w), w),
                lambda w: tree.dependency_bag(align.targets_of(m, w), w)):
        assert sorted(map(str, use(words).collect())) == sorted(map(str, use(built_in).collect()))


def test_plugin_model_is_made_once_in_a_worker(spark):
    import os
    import tempfile
    folder = tempfile.mkdtemp(prefix="mk-calls-")

    def factory():
        open(os.path.join(folder, f"{os.getpid()}-{len(os.listdir(folder))}"), "w").close()
        return lambda ps: [[("x", 1.0)] for _ in ps]

    prompts = spark.range(64).selectExpr("id", "'p' AS prompt").repartition(32)
    for _ in range(2):
        assert R.predict_with_plugin(prompts, factory, key="count").count() == 64
    calls = os.listdir(folder)
    assert len(calls) == len({c.split("-")[0] for c in calls}) < 32


def brute_pieces(word, ids):
    """Longest match first, character by character."""
    out, rest, mark = [], word, ""
    while rest:
        fit = [n for n in range(1, len(rest) + 1) if mark + rest[:n] in ids]
        if not fit or len(word) > WP.LONGEST_WORD:
            return [("[UNK]", 7)]
        out.append((mark + rest[:max(fit)], ids[mark + rest[:max(fit)]]))
        rest, mark = rest[max(fit):], "##"
    return out


def test_vocabulary_pieces_equal_brute_force_broadcast_and_joined(spark):
    import random
    rng = random.Random(2)
    pieces = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(30)} | {"é", "##é"}
    pieces |= {"##" + "".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(12)}
    ids = {p: i + 10 for i, p in enumerate(sorted(pieces))}
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(150)] + ["a" * 101, "a" * 100, "", "zz"]
    table = spark.createDataFrame([(w,) for w in words + words[:20]], "word string")
    vocabulary = spark.createDataFrame(list(ids.items()), "piece string, id int")
    want = {w: brute_pieces(w, ids) for w in words if w}
    for most in (WP.MOST_BROADCAST_PIECES, 0):
        got = WP.vocabulary_pieces(table, vocabulary, 7, most_broadcast=most).collect()
        assert len(got) == len(want) and {r.word: [tuple(p) for p in r.pieces] for r in got} == want
    docs = spark.createDataFrame([(1, 1, "é"), (1, 0, "zz"), (1, 2, "é"), (2, 0, "zz")], "doc_id long, wi int, word string")
    packed = {r.doc_id: r for r in WP.pack_features(WP.passage_pieces(docs, WP.vocabulary_pieces(docs, vocabulary, 7)), seq_length=4).collect()}
    assert packed[2].input_ids == [101, 7, 102, 0] and packed[2].input_mask == [1, 1, 1, 0] and packed[2].reason is None
    assert packed[1].input_ids == [101, 7, ids["é"], ids["é"], 102] and packed[1].reason == "more than 4 tokens"


def test_vectors_from_a_plugin_keep_shape_budget_and_masks(spark, tmp_path):
    calls = str(tmp_path)

    def factory():
        import os
        import uuid

        import numpy as np
        open(os.path.join(calls, f"made-{uuid.uuid4().hex}"), "w").close()

        def embed(ids, mask):
            assert ids.shape[0] == 1 or ids.size <= 40
            assert ((ids != 0) == (mask == 1)).all()
            return np.stack([ids * 1.0, ids * 2.0])[..., None] + np.zeros(3)
        return embed

    rows = [(i, [f"t{j}" for j in range(n)], n, list(range(1, n + 1)) + [0] * 5, "too long" if n > 60 else None)
            for i, n in enumerate([3, 50, 1, 7, 7, 20, 61, 2, 0])]
    packed = spark.createDataFrame(rows, "doc_id long, tokens array<string>, n_tokens int, input_ids array<int>, reason string").coalesce(1)
    got = WP.vectors_with_plugin(packed, factory, key=f"toy-{calls}", token_budget=40).collect()
    assert len(got) == 2 * sum(n for _, _, n, _, reason in rows if not reason)
    assert all(r.vector == [(r.j + 1.0) * (r.layer + 1)] * 3 for r in got)
    import os
    assert len(os.listdir(calls)) == 1
    import pytest
    bad = WP.vectors_with_plugin(packed, lambda: lambda ids, mask: ids * 1.0, key="bad")
    with pytest.raises(Exception, match="shape"):
        bad.collect()
