"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of ``documents``. Between stages the table is written to the shared checkpoint
folder and read back, so a lost executor costs a stage's tasks, not the stages before it.

Defined results: a null text is empty to every stage; it is not toxic by itself (it scores the
classifier's intercept), is one group with the other texts without words, and packs as its
end-of-document token. ``n_chars`` follows the text where a stage changes it. Empty tables pass
through. Extra columns travel with their rows up to the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit.llm import decontaminate, packing, secrets, simhash, tokens, toxicity
from mentionkit.llm.common import crc_fold, free_name, materialise, read


#: Bytes of an Arrow batch to a Python task, at most: whole rows travel, and both ends hold a batch or two.
BATCH_BYTES = 8 << 20


def _bounded(spark: SparkSession) -> SparkSession:
    """The session, with smaller Arrow batches where it allows more (a row that is larger travels alone)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1], 0)
    if int(now.rstrip("kmg")) << unit > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now; where there is no text it stays."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; learnt as ``op7_toxicity`` does."""
    model = toxicity.fit(docs, read(_bounded(spark), sf_dir, "labels", "doc_id", "toxic"), crc_fold("doc_id", 5) != 0)
    score = free_name(docs, "__toxic")
    return toxicity.with_score(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    _bounded(spark)
    return simhash.one_per_group(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly benchmark go."""
    return _counted(decontaminate.decontaminate(docs, read(_bounded(spark), sf_dir, "benchmark", "item_id", "text")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark."""
    _bounded(spark)
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in training sequences; a document has one end-of-document token."""
    sized = tokens.lengths(docs.select("doc_id", "text"), tokens.broadcast_vocabulary(_bounded(spark)))
    return packing.pack_documents(sized.select("doc_id", (F.col("length") + 1).alias("length")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifier, the fingerprints and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
