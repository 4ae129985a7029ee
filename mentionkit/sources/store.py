"""S4 + K5 -- an annotation store addressed by content: a text is parsed once, whatever file it comes in.

The store is a folder of parts. A part holds the words of some texts and the list of these texts, by the
128-bit digest of the text (``text_digest``, the passage key of mention tables). Asking for the words of
some passages parses only the texts that no published part lists, as one new part, and publishes the part
by creating its marker, after which everybody reads it. Parts are only added: a new input file, or a
changed one, costs its own new texts.

Two writers that meet may both parse a text; each publishes its part, and of every text the words of the
first part (by name) count, so readers see each word once. A writer that dies leaves a part without marker,
which nobody reads. ``expire`` rewrites what is still wanted as one part and removes the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit.session import shared_folder
from mentionkit.sources.staging import STAGING_VERSION


def text_digest(text: str | Column = "text") -> Column:
    """The key of a text: 128 bits, so that no two texts of any corpus meet; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass
class Store:
    """A store below ``folder``; ``annotate`` makes words, with ``doc_id``, of passages ``(doc_id, text)``."""

    spark: SparkSession
    folder: str
    annotate: Callable[[DataFrame], DataFrame]

    @classmethod
    def shared(cls, spark: SparkSession, name: str, annotate: Callable[[DataFrame], DataFrame]) -> "Store":
        """The store of that name in the shared folder, for this version of the code."""
        return cls(spark, f"{shared_folder(spark)}/store/{name}-{STAGING_VERSION}", annotate)

    def words(self, passages: DataFrame) -> DataFrame:
        """The words of ``passages(doc_id, text)``, whose ``doc_id`` is the text's digest; new texts are parsed first."""
        self.add(passages)
        asked = passages.select("doc_id").distinct()
        return self._first_of_each(self.parts()).join(asked, "doc_id", "left_semi")

    def add(self, passages: DataFrame) -> int:
        """Parse and publish the texts that are not in the store; how many these were."""
        asked = passages.select("doc_id", "text").dropDuplicates(["doc_id"])
        known = self._listed(self.parts())
        fresh = asked if known is None else asked.join(known, "doc_id", "left_anti")
        part = f"part-{uuid.uuid4().hex}"
        # the list is written first: the words are those of exactly these texts, whatever is published meanwhile
        fresh.select("doc_id", F.lit(part).alias("part")).write.parquet(f"{self.folder}/{part}/texts")
        listed = self._listed([part])
        parsed = listed.count()
        if parsed:
            self.annotate(asked.join(listed, "doc_id", "left_semi")).withColumn("part", F.lit(part)).write.parquet(
                f"{self.folder}/{part}/words")
            self._publish(part)
        return parsed

    def parts(self) -> list[str]:
        """The published parts, by name."""
        fs, path = self._path("published")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def expire(self, wanted: DataFrame) -> None:
        """Keep the words of ``wanted(doc_id)`` only, as one part. For times when nobody else uses the store."""
        old = self.parts()
        if not old:
            return
        part = f"part-{uuid.uuid4().hex}"
        kept = self._listed(old).select("doc_id").distinct().join(wanted.select("doc_id"), "doc_id", "left_semi")
        kept.withColumn("part", F.lit(part)).write.parquet(f"{self.folder}/{part}/texts")
        self._first_of_each(old).join(self._listed([part]), "doc_id", "left_semi").withColumn("part", F.lit(part)).write.parquet(
            f"{self.folder}/{part}/words")
        self._publish(part)
        for name in old:
            for below in (f"published/{name}", name):     # the marker first: what has none is not read
                fs, path = self._path(below)
                fs.delete(path, True)

    def _listed(self, parts: list[str]) -> DataFrame | None:
        """``(doc_id, part)`` of the texts that the parts list."""
        return self.spark.read.parquet(*(f"{self.folder}/{p}/texts" for p in parts)) if parts else None

    def _first_of_each(self, parts: list[str]) -> DataFrame:
        """The words of all texts, each from the first part that lists it."""
        words = self.spark.read.parquet(*(f"{self.folder}/{p}/words" for p in parts)) if parts else self.annotate(
            self.spark.createDataFrame([], "doc_id string, text string")).withColumn("part", F.lit(""))
        if len(parts) > 1:
            first = self._listed(parts).groupBy("doc_id").agg(F.min("part").alias("part"))
            words = words.join(first, ["doc_id", "part"], "left_semi")
        return words.drop("part")

    def _path(self, below: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _publish(self, part: str) -> None:
        fs, path = self._path(f"published/{part}")
        fs.create(path, False).close()
