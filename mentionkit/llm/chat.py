"""Chat formatting after the collapse of cumulative snapshots.

A logged conversation often stands several times in the log, each time with the turns so far. Every
turn adds a hash of its place, role and text to a running sum, so the sum after turn k identifies
the first k turns (two independent 64-bit hashes, added without overflow). A conversation whose whole
sum is the sum of a strict prefix of another one is a snapshot of it and goes by an anti-join; of
equal conversations the one with the smallest id stays. What remains is rendered with turn marks.

All of it is DataFrame operations. Scale: running sums are one window over each conversation (a
conversation becomes one row of text in the end, so it is bounded by a row); prefixes are made
distinct by a partial aggregate before they are joined, so an opening that a third of all
conversations share is one row; no pair of conversations is ever formed.

Defined results: a null role is ``unknown``, a null text is empty; a null turn comes before all
others, and turns with one number are in the order of role and text. Rows that are repeated in all
four columns count once. Rows without ``conv_id`` are one conversation, whose id is null. Turn marks
inside a role or text are broken (``<|`` becomes ``< |``). An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionkit.llm.common import materialise

START, END = "<|im_start|>", "<|im_end|>\n"
UNKNOWN = "unknown"


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """``conv_id, role, text, k, n, a, b``: the k-th of n turns and the hash (a, b) of the first k."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = "decimal(20,0)"
    return (rows.withColumn("k", F.row_number().over(order))
            .withColumn("a", F.sum(F.xxhash64("k", "role", "text").cast(big)).over(so_far))
            .withColumn("b", F.sum(F.xxhash64("text", F.lit("|"), "role", "k").cast(big)).over(so_far))
            .withColumn("n", F.count("*").over(Window.partitionBy("conv_id")).cast("int"))
            .select("conv_id", "role", "text", "k", "n", "a", "b"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id, copies`` of the conversations that are no strict prefix of another one."""
    whole = prefixes.filter("k = n").groupBy("n", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    strict = prefixes.filter("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    return whole.join(strict, ["n", "a", "b"], "left_anti").select("conv_id", "copies")


def _safe(column: str):
    return F.regexp_replace(column, r"<\|", "< |")


def render(conversations: DataFrame) -> DataFrame:
    """``conversations`` (``conv_id, turn, role, text``) -> ``conv_id, n_turns, copies, rendered`` of the maximal ones."""
    prefixes = materialise(prefix_hashes(conversations), "chat-turns")
    kept = maximal(prefixes).withColumnRenamed("conv_id", "kept_id")
    turns = prefixes.join(kept, prefixes["conv_id"].eqNullSafe(kept["kept_id"]))
    piece = F.concat(F.lit(START), _safe("role"), F.lit("\n"), _safe("text"), F.lit(END))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.max("copies").alias("copies"),
        F.array_sort(F.collect_list(F.struct("k", piece.alias("piece")))).alias("pieces")).select(
        "conv_id", "n_turns", "copies", F.array_join(F.col("pieces.piece"), "").alias("rendered"))
