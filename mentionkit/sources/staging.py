"""S4 / S5 -- staged tables and model persistence.

S4: an expensive derived table (the annotated ``words``, the ``mentions``) is written once as Parquet
below the shared folder (``spark.checkpoint.dir``), under a key that fingerprints its inputs (paths,
sizes and modification times on any file system, and the package source). Later jobs and later
applications read it back with column pruning and predicate pushdown instead of re-annotating; a
changed input gives a new key, and a failure while loading is raised, never swallowed into a silent
recompute. Writing it also cuts the lineage: a lost executor re-reads the table.

A writer fills a folder of its own and then publishes it by creating one marker file that must not
exist yet, so of two writers one wins and both read the winner's table. Nothing is ever overwritten
or removed: whoever owns the shared folder clears ``staged`` when its inputs are gone.

S5: Spark ML ``PipelineModel`` save / load (parameters live in the saved stages).
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionkit.session import shared_folder


def _code_version() -> str:
    """Hash of this package's source: any code change gives staged tables a new key (but for ``llm``, which stages none)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for dirpath, _, files in sorted(os.walk(root)):
        if os.path.relpath(dirpath, root).split(os.sep)[0] == "llm":
            continue
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(f.encode())
                    h.update(fh.read())
    return h.hexdigest()[:12]


STAGING_VERSION = _code_version()


def input_fingerprint(spark: SparkSession, path: str, *extra: str) -> str:
    """Fingerprint of the files below ``path`` (names, sizes, times), read by Spark from any file system."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length", "modificationTime"))     # contents are not read
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.sum(F.xxhash64(
        "path", "length", "modificationTime").cast("decimal(38,0)")).alias("mix")).first()
    return hashlib.sha1(repr((STAGING_VERSION, *seen, *map(str, extra))).encode()).hexdigest()[:20]


def staged(spark: SparkSession, name: str, key: str, compute: Callable[[], DataFrame],
           sort_by: list[str] | None = None, in_order: bool = False) -> DataFrame:
    """Read the published table ``<shared folder>/staged/<name>-<key>``, else compute, write and publish it.

    ``in_order``: its numbers mostly go up from row to row, and are stored as differences.
    """
    folder = f"{shared_folder(spark)}/staged/{name}-{key}"
    part = _published(spark, folder)
    if part is None:
        df = compute()
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        own = f"part-{uuid.uuid4().hex}"
        out = df.write.option("compression", "zstd")
        if in_order:
            out = out.option("parquet.writer.version", "v2")
            for field in df.schema:
                if isinstance(field.dataType, (T.IntegerType, T.LongType)):
                    out = out.option(f"parquet.enable.dictionary#{field.name}", "false")
        out.parquet(f"{folder}/{own}")
        part = _publish(spark, folder, own)
    return _by_its_size(spark.read.parquet(f"{folder}/{part}"))


#: Bytes of a staged table's files from which its rows, once read, are no broadcast: the files are compressed, up to
#: some 20 times, while Spark takes the size of the columns that a join reads from theirs.
MOST_BROADCAST_BYTES = 512 << 10


def _by_its_size(table: DataFrame) -> DataFrame:
    """The table, to be joined by merging where it is large, so that it never comes to the driver."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return table.hint("merge") if size > MOST_BROADCAST_BYTES else table


def _marker(spark: SparkSession, folder: str):
    """The marker's file system and path (Hadoop's, so any store Spark can reach)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _published(spark: SparkSession, folder: str) -> str | None:
    fs, path = _marker(spark, folder)
    if not fs.exists(path) or not fs.getFileStatus(path).getLen():
        return None
    return spark.read.text(str(path)).first()[0]


def _publish(spark: SparkSession, folder: str, part: str) -> str:
    """Name ``part`` in the marker; another writer's part where that one was first."""
    fs, path = _marker(spark, folder)
    try:
        out = fs.create(path, False)        # fails where the marker exists
    except Exception as error:
        for _ in range(100):
            if (winner := _published(spark, folder)) is not None:
                return winner
            time.sleep(0.1)
        raise RuntimeError(f"no published table in {folder}") from error
    out.write(bytearray(part.encode()))
    out.close()
    return part


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel`` (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
