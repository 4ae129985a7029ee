"""S1-S3 -- mention TSV scan, prediction CSV scan and prediction CSV sink.

The mention TSV follows pandas' default quoting: a field may be quoted with
doubled quotes inside and may hold tabs and newlines, so the reader needs
``multiLine`` and ``escape='"'`` (with defaults such records split silently).
The schema is declared and parsing is FAILFAST; hyphenated names are renamed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.sources.store import text_digest


def read_mentions(spark: SparkSession, path: str, with_url: bool | None = None) -> DataFrame:
    """``(id, doc_id, text, pronoun, ...)``; ``doc_id`` keys the distinct passage text.

    The columns present are taken from the header (as the task's reader does); their
    types are the declared ones, unknown columns are strings.
    """
    from pyspark.sql import types as T
    header = (spark.read.option("sep", "\t").option("header", True).option("multiLine", True)
              .option("escape", '"').csv(path).columns)
    declared = {f.name: f for f in S.MENTION_SCHEMA.fields}
    fields = [declared.get(c, T.StructField(c, T.StringType(), True)) for c in header]
    if with_url is False:
        fields = [f for f in fields if f.name != "URL"] if "URL" not in header else fields
    df = (spark.read.schema(T.StructType(fields)).option("sep", "\t").option("header", True)
          .option("multiLine", True).option("quote", '"').option("escape", '"')
          .option("mode", "FAILFAST").csv(path))
    df = df.select(*[F.col(f"`{c}`").alias(S.MENTION_RENAMES.get(c, c)) for c in df.columns])
    return df.withColumn("doc_id", text_digest())


def write_mentions(mentions: DataFrame, path: str) -> None:
    """Write a mention table as TSV in the same dialect (header, quoted where needed)."""
    cols = [c for c in S.MENTION_SCHEMA.fieldNames() if S.MENTION_RENAMES[c] in mentions.columns]
    out = mentions.select(*[F.col(S.MENTION_RENAMES[c]).alias(c) for c in cols])
    (out.write.mode("overwrite").option("sep", "\t").option("header", True)
     .option("quote", '"').option("escape", '"').csv(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``(id, p_a, p_b, p_neither)`` from a header CSV ``ID,A,B,NEITHER``."""
    df = spark.read.schema(S.PREDICTION_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(F.col("ID").alias("id"), F.col("A").alias("p_a"), F.col("B").alias("p_b"),
                     F.col("NEITHER").alias("p_neither"))


def write_predictions(pred: DataFrame, path: str) -> None:
    """S3: project to ``ID,A,B,NEITHER`` with a header; a directory of part files (no forced single file)."""
    out = pred.select(F.col("id").cast("string").alias("ID"), F.col("p_a").alias("A"),
                      F.col("p_b").alias("B"), F.col("p_neither").alias("NEITHER"))
    out.write.mode("overwrite").option("header", True).csv(path)


def score_files(spark: SparkSession, truth_path: str, pred_path: str) -> DataFrame:
    """The scoring entry point: log loss of a prediction CSV against a mention TSV.

    Raises when the two files do not hold the same ids, each once (the rows are matched by id)."""
    from mentionkit.operators import evaluate as E
    truth = E.truth_table(read_mentions(spark, truth_path))
    pred = read_predictions(spark, pred_path)
    if E.alignment_gaps(truth, pred).limit(1).count() > 0:
        raise ValueError("truth and predictions do not hold the same ids, each once")
    return E.log_loss(truth, pred)
