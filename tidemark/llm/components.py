"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_staged, staged

MAX_ROUNDS = 60


def _smallest(directed: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; partial sums before the shuffle keep a hot node cheap."""
    return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where(F.col("v") > F.col("u")).join(_smallest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = _smallest(edges)
    return edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable. Null ends and loops are left out.

    Each round is written to the shared folder; edges shrink towards stars. No neighbour list is ever gathered.
    """
    one = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now, mark = staged(one.distinct(), "edges"), None
    for _ in range(MAX_ROUNDS):
        following = staged(_small_star(_large_star(now).where(F.col("u") != F.col("v")).distinct()).distinct(), "edges")
        drop_staged(now)
        now = following
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == mark:
            break
        mark = sums
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", F.col("v")).distinct())
