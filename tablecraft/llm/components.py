"""Connected components of a graph given as links, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import keep

MAX_ROUNDS = 60


def _star(pairs: DataFrame) -> DataFrame:
    """Point each node of ``pairs`` (node, other) and its larger others at the smallest node around it."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    joined = pairs.join(least, "node")
    larger = joined.filter(F.col("other") != F.col("least")).select(F.col("other").alias("a"), F.col("least").alias("b"))
    own = least.filter(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    return larger.union(own)


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Smallest node reachable from each linked node: (node, component).

    Alternating large-star and small-star rounds; each round is stored. Null ends and loops link nothing. Nodes
    without a link are not in the result. The number of rounds grows with the logarithm of the longest path.
    """
    edges = (
        links.filter(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct()
    )
    edges = keep(edges, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        large = _star(both).filter(F.col("a") > F.col("b")).distinct()
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        edges = keep(_star(down).filter(F.col("a") > F.col("b")).distinct(), "links")
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())
