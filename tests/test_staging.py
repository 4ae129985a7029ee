import os
import subprocess
import sys
import tempfile

import pytest

from mentionkit.plans.fixture import load_context
from mentionkit.operators import evaluate as E
from mentionkit.operators import scorers as R
from mentionkit.operators import windows as W
from mentionkit.sources.staging import _publish, _published, input_fingerprint, staged

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_second_application_reads_what_the_first_staged():
    shared = tempfile.mkdtemp(prefix="mk-shared-")
    job = ("import sys; from mentionkit.session import build_session; from mentionkit.plans.fixture import load_corpus; "
           "s = build_session(master='local[2]', extra={'spark.checkpoint.dir': sys.argv[1]}); "
           "print(load_corpus(s, sys.argv[2]).mentions.count())")

    def run():
        subprocess.run([sys.executable, "-c", job, shared, SF], check=True, cwd=ROOT, capture_output=True,
                       env=os.environ | {"PYTHONPATH": ROOT}, timeout=600)
        return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns)
                      for d, _, files in os.walk(shared) for f in files)

    first = run()
    assert any("/staged/words-" in f for f, _ in first) and run() == first


def test_fingerprint_follows_the_files(spark):
    folder = tempfile.mkdtemp(prefix="mk-in-")
    path = f"{folder}/t.parquet"
    spark.range(5).write.parquet(path)
    key = input_fingerprint(spark, path)
    assert key == input_fingerprint(spark, path) != input_fingerprint(spark, path, "other")
    spark.range(6).write.mode("overwrite").parquet(path)
    assert key != input_fingerprint(spark, path)


def test_two_writers_publish_one_table(spark):
    folder = tempfile.mkdtemp(prefix="mk-two-")
    assert _published(spark, folder) is None
    assert _publish(spark, folder, "part-a") == "part-a"
    assert _publish(spark, folder, "part-b") == "part-a" == _published(spark, folder)
    made = []
    for _ in range(2):
        staged(spark, "once", os.path.basename(folder), lambda: made.append(1) or spark.range(3))
    assert len(made) == 1


def test_a_window_beyond_the_neighbourhood_fails(spark):
    cx = load_context(spark, SF)
    with pytest.raises(Exception, match="larger radius"):
        W.tag_window(cx.targets, cx.near_words, n=40).collect()
    wide = load_context(spark, SF, radius=40)
    assert W.tag_window(wide.targets, wide.near_words, n=40).where("tag is null").count() == 0


def test_evaluation_fails_on_missing_and_extra_ids(spark):
    truth = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0), (2, 1, 0.0, 1.0, 0.0)], "id long, label int, y_a double, y_b double, y_n double")
    pred = spark.createDataFrame([(i, 0.4, 0.3, 0.3) for i in (1, 2, 3)], "id long, p_a double, p_b double, p_neither double")
    assert E.log_loss(truth, pred.where("id < 3")).first()["n"] == 2
    for some in (pred, pred.where("id = 1")):
        for report in (E.log_loss, E.evaluation_report, E.confusion_matrix, E.predicted_counts, E.errors_per_class):
            with pytest.raises(Exception, match="same ids"):
                report(truth, some).collect()


def test_plugin_candidates_are_ranked_not_cut(spark):
    prompts = spark.createDataFrame([(1, "x")], "id long, prompt string")

    def factory():
        return lambda ps: [[(f"t{i}", float(i)) for i in range(8)] for _ in ps]

    top = R.top_predictions(R.predict_with_plugin(prompts, factory, key="ascending")).orderBy("rank").collect()
    assert [r["token"] for r in top] == ["t7", "t6", "t5", "t4", "t3"]


def test_every_scorer_keeps_every_mention(spark):
    cx = load_context(spark, SF)
    ids = {r["id"] for r in cx.corpus.mentions.select("id").collect()}
    lost = cx.targets.withColumn("wi", cx.targets["wi"] + 10_000_000)
    for pred in (R.syntax_scores(cx.targets, cx.near_words), R.context_scorer("cascade", cx.corpus.words)(cx.targets)):
        assert {r["id"] for r in pred.select("id").collect()} == ids
    assert {r["id"] for r in R.syntax_points(lost, cx.near_words).select("id").collect()} == ids
