"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Links of one task of a round.
LINKS_PER_TASK = 200_000


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Each round hooks the neighbours of a node to the smallest of them.  The
    smallest neighbour comes from a partial aggregate and is joined back, so a
    node with very many links is not gathered in one task.  Rounds grow with the
    logarithm of the longest chain.  No step makes more links than it was given,
    so the number of tasks follows the number of links: a small table is not
    dealt into shuffle files and checkpoint parts of a few rows each.
    """
    edges = links.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpoint(edges)
    tasks = 1 + edges.count() // LINKS_PER_TASK
    edges, state = edges.coalesce(tasks), None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = checkpoint(edges.coalesce(tasks).distinct().coalesce(tasks))
        row = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    return (edges.groupBy("a").agg(F.min("b").alias("component"))
            .union(edges.select("b", "b")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("component")))
