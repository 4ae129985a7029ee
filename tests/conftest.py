import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from mentionkit.session import build_session, checkpoint_dir
    s = build_session(master="local[*]", shuffle_partitions=8)
    checkpoint_dir(s)          # a scratch folder only because none is configured in tests
    yield s


def make_words(spark, rows, doc_id=1):
    """Hand-built words: rows of (word, upos, xpos, idx, governor, deprel); sentences by idx == 1."""
    out, o, nb, pb, sent = [], 0, 0, 0, -1
    for wi, (word, upos, xpos, idx, gov, dep) in enumerate(rows):
        if idx == 1:
            sent += 1
        lo = o if wi == 0 else o - 1
        out.append((doc_id, wi, sent, idx, o, lo, nb, pb, word, word.lower(), upos, xpos, gov, dep))
        o += len(word) + 1
        nb += len(word)
        pb += -(-len(word) // 4)
    return spark.createDataFrame(out, "doc_id long, wi int, sent int, idx int, o int, lo int, nb int, pb int, "
                                      "word string, lemma string, upos string, xpos string, governor int, "
                                      "deprel string")


def make_targets(spark, rows, doc_id=1, with_sizes=None):
    """rows of (id, role, wi, target_len)."""
    data = [(i, doc_id, r, wi, tl, 0, "x") for i, r, wi, tl in rows]
    df = spark.createDataFrame(data, "id long, doc_id long, role string, wi int, target_len int, off int, target string")
    if with_sizes is not None:
        from pyspark.sql import functions as F
        df = df.withColumn("n_words", F.lit(with_sizes))
    return df
