"""Connected components of an undirected graph by DataFrame operations alone (alternating large and small stars).

Each round links every node to the smallest node it sees: large stars hang the larger neighbours of a node on its
smallest neighbour, small stars its smaller ones. After a logarithmic number of rounds every component is a star around
its smallest node. A node's neighbours are never gathered: their minimum is an aggregate that is combined before the
shuffle, and is joined back (a join whose large keys adaptive execution can split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): every node that has an edge to another one, with its component's smallest node."""
    a, b = F.col(u), F.col(v)
    clean = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.table(clean, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        nxt = scratch.table(_small_star(_large_star(now)), "stars")
        # a star forest is the only graph that both steps leave as it is
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(now)
        now = nxt
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
