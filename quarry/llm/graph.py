"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.common import cut, drop_table


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node in edges (a, b: bigint), by alternating stars, as a written table.

    Each step hangs neighbours on the least node known to them; the edges become stars in a number of rounds that grows
    with the logarithm of the longest path. The state is written after every step, so no step depends on executors that
    ran an earlier one, and both sides of each join are plain tables, so that AQE can split a hub's edges.
    """
    stars = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Large star: every node's greater neighbours hang on the least of its neighbours and itself.
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "large")
        # Small star: every node and its smaller neighbours hang on the least of them.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least2 = cut(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = down.join(least2, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least2.select(F.col("m").alias("a"), F.col("u").alias("b")))
        seen = Observation()
        new = cut(joined.where("a <> b").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        for t in (stars, least, large, least2):
            drop_table(t)
        stars = new
        if seen.get == before:
            break
        before = seen.get
    out = cut(stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), "components")
    drop_table(stars)
    return out
