"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionkit.llm.common import materialise, release

#: Rounds after which the job gives up with an error; the method needs about log2(longest path)^2.
MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> ``(node, root)``: for every linked node the smallest node of its component.

    Alternating large-star and small-star steps: each is one partial minimum per node and one equi
    join, so a node with very many neighbours is pre-aggregated before the shuffle and its join is
    left to Spark's skew splitting. Every round's links are written to the shared folder; the driver
    sees only their count and checksum. Self-links and repeated links are allowed, nulls are not.
    """
    edges = materialise(links.filter("a != b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # large-star: every larger neighbour of v links to v's smallest neighbour (or v)
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = (both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .filter("v != u").distinct())
        # small-star: v and its smaller neighbours link to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .unionByName(least.select("v", F.col("m").alias("u"))).filter("v != u").distinct())
        edges = materialise(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
                edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        seen = now
        release(links.sparkSession)  # the round's shuffle files, and the driver's record of its tasks
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
