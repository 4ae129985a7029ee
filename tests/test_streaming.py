import tempfile

from mentionkit import schema as S
from mentionkit.operators import scorers as R
from mentionkit.plans.fixture import load_corpus
from mentionkit.streaming.scoring import read_mention_stream, score_stream, start_to_parquet

SF = "/root/testdata/sf0.001"


def test_stream_scores_equal_batch(spark):
    m = load_corpus(spark, SF).mentions
    src = tempfile.mkdtemp(prefix="mk-stream-src-")
    m.repartition(3, "id").write.mode("overwrite").parquet(src + "/in")
    stream = read_mention_stream(spark, src + "/in")
    scored = score_stream(stream, m, S.ANCHORS_F, S.ANCHORS_M, lower=True)
    start_to_parquet(scored, src + "/out", "mk-test-stream", checkpoint=src + "/progress").awaitTermination(300)
    # a restarted query has nothing left to do
    again = score_stream(read_mention_stream(spark, src + "/in"), m, S.ANCHORS_F, S.ANCHORS_M, lower=True)
    start_to_parquet(again, src + "/out", "mk-test-stream", checkpoint=src + "/progress").awaitTermination(300)
    rows = spark.read.parquet(src + "/out").collect()
    got = {r["id"]: (r["p_a"], r["p_b"], r["p_neither"]) for r in rows}
    assert len(rows) == len(got)
    want = {r["id"]: (r["p_a"], r["p_b"], r["p_neither"])
            for r in R.name_gender_scores(m, m, S.ANCHORS_F, S.ANCHORS_M, lower=True).collect()}
    assert got == want and len(got) == m.count()
