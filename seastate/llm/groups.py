"""Connected groups of a link table, by alternating star contractions until nothing moves.

Each pass is two aggregates and joins over the links; a node with very many neighbours is pre-aggregated for its minimum and its
join is one that adaptive execution can split. Links only shrink towards stars, so a pass never makes more rows than twice the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node hands its neighbours (larger ones, or the smaller ones and itself) to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else \
        moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root: the smallest id of the group, for every id that has a link and is not itself the root."""
    edges = materialise(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = print_of(edges)
    while before[0]:
        edges = materialise(_star(_star(edges, True), False), "stars")
        now = print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
