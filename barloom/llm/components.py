"""Connected components over edge tables, with every round cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import checkpointed

#: Rounds after which something must be wrong: each round at least halves the longest path.
MAX_ROUNDS = 64
#: Edges a task, and the fewest tasks.
ROWS, LEAST_TASKS = 250_000, 6


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates two steps until nothing changes: each node hands the smallest of its
    neighbourhood to its larger neighbours, then to its smaller ones. Minima are aggregated
    before the shuffle, so a node with very many edges gathers nothing in one task. Self
    links and repeated edges are allowed; an empty table gives an empty one.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = mark(links)
    for _ in range(MAX_ROUNDS):
        few = max(LEAST_TASKS, -(-state[0] // ROWS))  # a small graph takes few tasks: each of a shuffle's tasks leaves files
        links = links.coalesce(few)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(few)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(few)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(few).distinct().coalesce(few)
        lower = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(few)
        joined = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpointed(joined.union(lower.select("a", F.col("m").alias("b"))).coalesce(few).distinct().coalesce(few))
        now = mark(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
