"""Connected components over link tables, as joins and aggregations of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.shared import stored

#: A safety net; labels settle in a number of rounds that is logarithmic in the longest chain.
MAX_ROUNDS = 60


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link downwards, to a node that has none, or links upwards only."""
    ends = links.select(F.col("big").alias("node"), F.lit(1).alias("down")).unionByName(
        links.select(F.col("small").alias("node"), F.lit(0).alias("down"))
    )
    found = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return found.agg(F.count_if((F.col("down") > 0) & (F.col("n") > 1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; ``root`` is the smallest node reachable.

    Large-star and small-star steps in turn: each node hands its neighbours the smallest node it knows. Every
    step is a minimum per node (summed up before the shuffle) and a join, so a node with very many links
    costs no more per task than others; tables are written to the shared folder between rounds. No round is made
    once the links are settled, be it from the start: a look at that takes one aggregation, a round six shuffles.
    """

    def starred(links: DataFrame, large: bool) -> DataFrame:
        """Links (big, small), big > small: each node's larger (or smaller and itself) neighbours get its minimum."""
        if large:
            both = links.select(F.col("big").alias("v"), F.col("small").alias("u")).unionByName(
                links.select(F.col("small").alias("v"), F.col("big").alias("u"))
            )
        else:
            both = links.select(F.col("big").alias("v"), F.col("small").alias("u"))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        joined = both.join(least, "v")
        if large:
            moved = joined.filter(F.col("u") > F.col("v")).select(F.col("u").alias("big"), F.col("m").alias("small"))
        else:
            moved = joined.select(F.col("u").alias("big"), F.col("m").alias("small")).unionByName(
                least.select(F.col("v").alias("big"), F.col("m").alias("small"))
            )
        return moved.filter(F.col("big") != F.col("small")).distinct()

    ordered = edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
    links = stored(ordered.filter(F.col("big") != F.col("small")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _settled(links):
            break
        links = stored(starred(starred(links, True), False), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()
    return links.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(roots)
