from pyspark.sql import functions as F

from mentionkit.functions import columns as C


def test_class_labels(spark):
    df = spark.createDataFrame([(True, False), (False, True), (False, False), (True, True)], "a_coref boolean, b_coref boolean")
    assert [r[0] for r in df.select(C.class_label()).collect()] == [0, 1, 2, 1]


def test_gender_flags(spark):
    pr = ["he", "she", "her", "His", "him", "She", "He", "Her"]
    df = spark.createDataFrame([(p,) for p in pr], "pronoun string")
    assert [r[0] for r in df.select(C.gender_flag()).collect()] == [1, 0, 0, 1, 1, 0, 1, 0]


def test_argmax_first_max_wins(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.2, 0.6), (0.1, 0.5, 0.5), (0.3, 0.3, 0.3)],
                               "p_a double, p_b double, p_neither double")
    assert [r[0] for r in df.select(C.argmax3()).collect()] == [0, 2, 1, 0]


def test_detokenize(spark):
    df = spark.createDataFrame([(["He", "did", "n't", "go", ",", "she", "said", "."],)], "w array<string>")
    assert df.select(C.detokenize("w")).first()[0] == "He didn't go, she said."


def test_first_token_and_count(spark):
    df = spark.createDataFrame([(" Cheryl  Cassidy ",), ("her",), ("",)], "x string")
    rows = df.select(C.first_token("x"), C.token_count("x")).collect()
    assert [tuple(r) for r in rows] == [("Cheryl", 2), ("her", 1), ("", 0)]


def test_nonblank_counts(spark):
    df = spark.createDataFrame([("ab cd\tef", 6, "x y")], "text string, off int, a string")
    r = df.select(C.nonblank_before("text", "off"), C.nonblank_length("a")).first()
    assert tuple(r) == (4, 2)


def test_normalise_and_parts(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, -3)], "p_a double, p_b double, p_neither double, x int")
    r = df.select(*C.normalise3(), C.positive_part("x"), C.negative_part("x")).first()
    assert tuple(r) == (0.25, 0.25, 0.5, 0, 3)
