"""The TSV entry path gives the same answers as the pipeline on the driver tables."""
import tempfile

from pyspark.sql import functions as F

from mentionkit.plans.catalog import QUERIES
from mentionkit.plans.fixture import load_corpus, load_tsv_context
from mentionkit.operators import scorers as R
from mentionkit.sources import tsv

SF = "/root/testdata/sf0.001"


def test_tsv_context_matches_parquet_pipeline(spark):
    d = tempfile.mkdtemp(prefix="mk-tsv-pipe-")
    m = load_corpus(spark, SF).mentions
    tsv.write_mentions(m.withColumn("id", F.concat(F.lit("m-"), F.col("id").cast("string"))), d + "/in")
    cx = load_tsv_context(spark, d + "/in")
    got = {r["id"]: (round(r["p_a"], 9), round(r["p_b"], 9), round(r["p_neither"], 9))
           for r in R.cascade(R.prefix_scores(cx.targets, cx.corpus.words,
                                              R.top_predictions(R.scope_name_counts(cx.targets, cx.corpus.words))),
                              R.syntax_scores(cx.targets, cx.near_words)).collect()}
    want = {f"m-{r['id']}": (r["p_a"], r["p_b"], r["p_neither"])
            for r in QUERIES["r5_cascade_scores"](spark, SF).collect()}
    assert got == want


def test_cli_writes_predictions_and_scores(spark, capsys):
    from mentionkit import cli
    d = tempfile.mkdtemp(prefix="mk-cli-")
    tsv.write_mentions(load_corpus(spark, SF).mentions, d + "/in")
    cli.main(["--input", d + "/in", "--output", d + "/out", "--scorer", "constant"])
    assert abs(float(capsys.readouterr().out.strip().splitlines()[-1]) - 1.0986123) < 1e-6
    assert spark.read.option("header", True).csv(d + "/out").columns == ["ID", "A", "B", "NEITHER"]


def test_cli_reaches_every_scorer_and_plug_ins(spark, capsys, monkeypatch):
    import pytest
    from mentionkit import cli
    from mentionkit.operators import scorers as R
    from mentionkit.plans.fixture import load_tsv_context
    d = tempfile.mkdtemp(prefix="mk-cli-plug-")
    with open(f"{d}/always_b_plugin.py", "w") as f:
        f.write("from pyspark.sql import functions as F\nfrom mentionkit.operators.scorers import register_context_scorer\n"
                "register_context_scorer('always_b', lambda cx: cx.corpus.mentions.select('id', F.lit(0.0).alias('p_a'), "
                "F.lit(1.0).alias('p_b'), F.lit(0.0).alias('p_neither')))\n")
    monkeypatch.syspath_prepend(d)
    tsv.write_mentions(load_corpus(spark, SF).mentions, d + "/in")
    cli.main(["--input", d + "/in", "--output", d + "/out", "--scorer", "always_b", "--plugin", "always_b_plugin"])
    assert {r["B"] for r in spark.read.option("header", True).csv(d + "/out").collect()} == {"1.0"}
    with pytest.raises(SystemExit):
        cli.main(["--input", d + "/in", "--output", d + "/out2", "--scorer", "nobody"])
    cx = load_tsv_context(spark, d + "/in")
    ids = {r["id"] for r in cx.corpus.mentions.select("id").collect()}
    for name in ("constant", "name_gender", "syntax", "prefix", "cascade"):
        assert {r["id"] for r in R.score_context(cx, name).select("id").collect()} == ids
