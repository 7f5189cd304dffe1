"""Connected components of a list of links, as joins and aggregates over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import checkpointed, own_shuffle

MAX_ROUNDS = 60


def _sum_of(links: DataFrame) -> tuple:
    """Number and order-free checksum of the links; the one row of each round that reaches the driver."""
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    return tuple(row)


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    least = least.select(own_shuffle(F.col("a")).alias("a"), "m")
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; ``links`` point from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    by_node = least.select(own_shuffle(F.col("a")).alias("a"), "m")
    others = links.join(by_node, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``); the root is the component's smallest node.

    Large-star and small-star rounds alternate until the links stop changing; by then every node points to its root.
    A node's neighbours are never gathered: their minimum is an aggregate, and the join that hands it to them may be
    split by adaptive execution.  Each round is a reliable checkpoint.  Links of a node to itself are left out.
    """
    smaller = F.least("a", "b").alias("b")
    links = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), smaller).distinct())
    state = _sum_of(links)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        links = checkpointed(_small_star(_large_star(links).distinct()).distinct())
        before, state = state, _sum_of(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots)
