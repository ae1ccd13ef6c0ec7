"""Connected components of a link table, as Spark jobs.

Alternating large-star and small-star rounds: every round is two grouped
minima and joins over the remaining links; the links of a round are written
to the shared checkpoint folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _minima(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` -> ``(node, root)`` for every node of a link that is
    not its component's smallest node; root is that smallest node.

    Links may repeat, point either way or to themselves; nulls are dropped.
    An empty table gives an empty table.
    """
    links = (links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    links = written(links, "links")
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written before they are joined: a node with very many links is then a skewed
        # partition of a plain join, which Spark splits, and never meets its links in one task.
        least = written(_minima(both).select("u", F.least("u", "m").alias("m")), "least")
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = written(large, "links")
        # Small star: u and its smaller neighbours go to the least of them.
        least = written(_minima(large), "least")
        small = large.join(least, "u")
        small = (small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        small = written(small, "links")
        if small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        links = small
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")
