"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components", rows: int | None = None) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    `edges` has two long columns a and b. Each round turns the neighbours of a node to its
    smallest neighbour, first from above and then from below; the forest shrinks to stars in a
    number of rounds logarithmic in the longest chain, and ends when a round changes nothing.
    Each round is written to the shared folder, in files by its row count; `rows` bounds that of
    `edges` where it is known. Only a row count and a checksum reach the driver.
    """
    now = scratch.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{name}-0", rows=rows)
    mark, k = None, 0
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, k = tuple(seen), k + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        after = small.select("e.a", F.col("e.m").alias("b")).where("a != b").distinct()
        now = scratch.stage(after, f"{name}-{k}", rows=seen[0])
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
