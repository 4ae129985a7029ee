"""Streaming scoring: R1 / R2 and the P-columns on a Structured Streaming source.

The reference has no streaming operator; these scorers are stateless, so the
same DataFrame code runs on ``readStream``: the name-gender cohort is a static
dimension and the join is a stream-static left join (no state, no watermark).
Progress lives in a folder that the caller names, by default below the shared
folder, so a query restarted by a new process resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from mentionkit.functions import columns as C
from mentionkit.operators import scorers as R
from mentionkit.session import shared_folder

MENTION_STREAM_SCHEMA = ("id long, doc_id long, text string, pronoun string, pronoun_offset int, a string, "
                         "a_offset int, a_coref boolean, b string, b_offset int, b_coref boolean")


def read_mention_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(MENTION_STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def score_stream(mentions: DataFrame, cohort_source: DataFrame, she: list[str], he: list[str],
                 lower: bool = False) -> DataFrame:
    """Per streamed mention: P-columns plus the name-gender scores (static cohort)."""
    scored = R.name_gender_scores(mentions, cohort_source, she, he, lower, keep=[
        C.after_pronoun("a_offset").alias("a_after_pronoun"), C.signed_distance("a_offset").alias("a_dist"),
        C.signed_distance("b_offset").alias("b_dist"), C.class_label().alias("label")])
    return scored


def start_to_parquet(stream: DataFrame, out_path: str, name: str, trigger_once: bool = True,
                     checkpoint: str | None = None):
    """Append the scored stream to Parquet; ``checkpoint`` (default ``<shared folder>/streams/<name>``) keeps progress."""
    place = checkpoint or f"{shared_folder(stream.sparkSession)}/streams/{name}"
    w = stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", place)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.outputMode("append").start()
