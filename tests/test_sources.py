import csv
import os
import tempfile

from pyspark.sql import functions as F

from mentionkit.operators.profile import global_ordinal
from mentionkit.sources import tsv


def test_mention_tsv_quoting(spark):
    d = tempfile.mkdtemp(prefix="mk-tsv-")
    path = os.path.join(d, "m.tsv")
    text = 'He said "hi"\tthen\nleft \\ 𝄞 her'
    rows = [["ID", "Text", "Pronoun", "Pronoun-offset", "A", "A-offset", "A-coref", "B", "B-offset", "B-coref", "URL"],
            ["t-1", text, "her", str(len(text) - 3), "He", "0", "TRUE", "left", "18", "False", "u"]]
    with open(path, "w", newline="") as f:
        csv.writer(f, delimiter="\t", quoting=csv.QUOTE_MINIMAL, lineterminator="\n").writerows(rows)
    df = tsv.read_mentions(spark, path)
    r = df.first()
    assert df.count() == 1 and r["text"] == text and r["a_coref"] is True and r["b_coref"] is False
    assert r["text"][r["pronoun_offset"]:r["pronoun_offset"] + 3] == "her"
    assert df.select(F.substring("text", r["pronoun_offset"] + 1, 3)).first()[0] == "her"


def test_prediction_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="mk-csv-")
    pred = spark.createDataFrame([(1, 0.2, 0.3, 0.5)], "id long, p_a double, p_b double, p_neither double")
    tsv.write_predictions(pred, d + "/out")
    back = tsv.read_predictions(spark, d + "/out").first()
    assert (back["id"], back["p_a"], back["p_b"], back["p_neither"]) == ("1", 0.2, 0.3, 0.5)


def test_global_ordinal_matches_sorted_order(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("b"))
    got = global_ordinal(df, ["b", "k"]).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(5000))
    assert [(r["b"], r["k"]) for r in got] == sorted((r["b"], r["k"]) for r in got)
