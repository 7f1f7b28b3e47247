"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daypanel.llm.staging import staged

MAX_ROUNDS = 60


def _lowest(both: DataFrame) -> DataFrame:
    """Lowest node among each node and its neighbours, with map-side combine for hubs."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the lowest node it is connected to.

    In each round every node hands its larger, then its smaller neighbours to its lowest one, until the
    edges are stars. The edges stay a distributed table throughout; each round is written to the shared
    folder, which cuts the lineage. Null ends and self loops are ignored, repeated edges count once.
    """
    now = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
    now = staged(now.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "edges")
        low = _lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        after = staged(small.where("u <> v").distinct(), "edges")
        digest = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        if now.agg(*digest).first() == after.agg(*digest).first():
            break
        now = after
    else:
        raise RuntimeError("the components did not settle")
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
