"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a group-by with partial aggregation; nodes and links stay in tables. The number of steps grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import saved


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("least"))
    return (
        both.where("other > node").join(least, "node").select(F.col("least").alias("a"), F.col("other").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    return (
        links.join(least, "b")
        .select(F.explode(F.array(F.struct("least", F.col("a").alias("x")), F.struct("least", F.col("b").alias("x")))).alias("s"))
        .select(F.col("s.least").alias("a"), F.col("s.x").alias("b"))
        .where("a < b")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``links``: integer columns a < b. Returns node, component (its smallest node) for every node that has a link."""
    links = saved(links.where("a < b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        links = saved(_small_star(_large_star(links)), "links")
        row = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")
        ).first()
        if row == seen:
            break
        seen = row
    nodes = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return nodes.unionByName(roots)
