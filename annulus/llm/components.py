"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step takes a partial minimum before the shuffle, and joins that deal the edges of a hub
out over several tasks, so a node with very many edges meets neither in one row nor in one
task; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored


def _linked(edges: DataFrame, lowest_first: bool, total: int) -> DataFrame:
    """One step on at most `total` edges (u, v) with u > v: (u, v) rows that point nearer to the component's minimum."""
    if lowest_first:  # small star: a node's smaller neighbours and itself to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__rows"))
        moved = spread_join(edges, least, ["u"], total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    every = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = every.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__rows")).withColumn("m", F.least("u", "m"))
    moved = spread_join(every, least, ["u"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge table; component is its least node.

    Loops and nulls are left out, repeated edges and either direction don't matter.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    now, before = stored(now), None
    while True:
        said = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(said) == before:
            break
        before = tuple(said)
        if not said[0]:
            break
        large = stored(_linked(now, False, said[0]))
        now = stored(_linked(large, True, said[0]))
    pointed = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pointed.unionByName(roots)
