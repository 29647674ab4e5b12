"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailverdict.llm.common import scratch


def components(links: DataFrame) -> DataFrame:
    """`(node, root)` for every node of the links `(a, b)`; `root` is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every round hangs nodes
    under smaller ones until each component is one star. Each step joins the links with one row per
    node; both are tables, so Spark can split the rows of a hub. Links with a null end are ignored.
    """
    ends = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = scratch(
        ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = scratch(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(), "large-star",
        )
        least = scratch(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch(
            moved.filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star"
        )
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
