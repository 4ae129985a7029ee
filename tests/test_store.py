from collections import Counter

import pytest
from pyspark.sql import functions as F

from mentionkit.operators.annotate import annotate
from mentionkit.sources import store as ST


@pytest.fixture
def store(spark, tmp_path):
    asked = []

    def parse(passages):
        asked.append(sorted(r.text for r in passages.collect()))
        return annotate(passages)

    return ST.Store(spark, f"{tmp_path}/store", parse), asked


def passages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").select(ST.text_digest().alias("doc_id"), "text")


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "wi", "sent", "o", "word", "upos").collect())


def test_only_new_texts_are_parsed(spark, store):
    s, asked = store
    first = passages(spark, "Ann met Bob.", "She left.", "She left.")
    second = passages(spark, "She left.", "He came. He saw.", "")
    assert s.add(first) == 2 and s.add(first) == 0 and s.add(second) == 2
    assert asked == [["Ann met Bob.", "She left."], ["", "He came. He saw."]] and len(s.parts()) == 2
    assert rows(s.words(second)) == rows(annotate(second.dropDuplicates(["doc_id"])))
    assert rows(s.words(first.limit(0))) == Counter() and len(asked) == 2


def test_two_writers_and_one_that_died(spark, store, monkeypatch):
    s, _ = store
    both = passages(spark, "Ann met Bob.", "She left.")
    monkeypatch.setattr(ST.Store, "parts", lambda self: [])      # neither sees the other
    assert s.add(both) == 2 and s.add(both.limit(1)) == 1
    monkeypatch.setattr(ST.Store, "_publish", lambda self, part: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        s.add(both)
    monkeypatch.undo()
    assert len(s.parts()) == 2
    assert rows(s.words(both)) == rows(annotate(both))


def test_expiry_keeps_what_is_wanted(spark, store):
    s, asked = store
    s.expire(passages(spark, "nothing there yet"))
    s.add(passages(spark, "One.", "Two."))
    s.add(passages(spark, "Three."))
    s.expire(passages(spark, "Two.", "Three."))
    assert len(s.parts()) == 1 and len(asked) == 2
    assert {r.word for r in s.words(passages(spark, "Two.", "Three.")).collect()} == {"Two", "Three", "."}
    assert s.add(passages(spark, "One.", "Two.", "Three.")) == 1


def test_an_empty_store_gives_no_words(spark, store):
    s, _ = store
    assert s.words(passages(spark, "x").limit(0)).where(F.col("word").isNotNull()).count() == 0
