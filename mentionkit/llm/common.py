"""Helpers shared by the operators of this subpackage.

Text travels to Python tasks as UTF-8 bytes. On bytes, ``lower()`` changes A-Z only and ``split()``
cuts at exactly ``[\\x20\\x09-\\x0D]+``, which is what the query contracts ask for.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionkit.session import checkpoint_dir

#: Rows that a task turns into Python objects at a time.
CHUNK_ROWS = 256
#: Output rows and bytes that a task holds before it hands them on.
FLUSH_ROWS = 4096
FLUSH_BYTES = 8 << 20


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


def crc_fold(column: str, folds: int) -> Column:
    """``crc32(column as text) mod folds``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing, and what several later
    steps read is computed once. The folder is named by ``spark.checkpoint.dir``; whoever owns that
    folder clears it after the application.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose DataFrames are gone.

    Spark removes them when the driver's garbage collector finds them unreachable; a driver with little
    garbage of its own may not collect for long, while every finished level's files stay on the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def python_rows(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK_ROWS) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; at most ``chunk`` rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            part = batch.slice(at, chunk)
            yield from zip(*(c.to_pylist() for c in part.columns))
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: a Python worker lives on for other stages' tasks, whose needs add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def arrow_out(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] | None = None,
              flush_rows: int = FLUSH_ROWS) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``flush_rows`` rows or about ``FLUSH_BYTES`` (by ``size``)."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += size(row) if size else 0
        if len(held) >= flush_rows or weight >= FLUSH_BYTES:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


def bytes_to_points(text: bytes, offsets: list[int]) -> list[int]:
    """Code-point offsets of ascending byte offsets (each at a character's first byte or the end)."""
    if text.isascii():
        return list(offsets)
    out, at, points = [], 0, 0
    for o in offsets:
        points += len(text[at:o].decode("utf-8", "replace"))
        at = o
        out.append(points)
    return out


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*columns)
