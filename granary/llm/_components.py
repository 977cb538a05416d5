"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm._common import discard, materialise


#: A node with more than this part of all edges is a hub; there can be no more than HUBS of them.
HUBS = 4096


def _hang(edges: DataFrame, low: DataFrame, size: int) -> DataFrame:
    """Edges joined to low (k, m, n) by u = k. n is k's number of edges, of `size` in all.

    The at most HUBS nodes with more than a HUBS-th of the edges are joined by broadcast, so that no task
    gets all edges of a hub; the others are joined by shuffling.
    """
    hubs = F.broadcast(low.where(F.col("n") > size / HUBS))
    rest = edges.join(hubs, F.col("u") == F.col("k"), "left_anti").join(low.where(F.col("n") <= size / HUBS), F.col("u") == F.col("k"))
    return edges.join(hubs, F.col("u") == F.col("k")).union(rest)


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"), "n")
    return _hang(both.where("v > u"), low, 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of them; u > v in every edge."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), "m", "n")
    hung = _hang(edges, low, size).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v), component being its smallest node.

    Every round is two joins of the edges with one row per node; the edges of nodes with very many of them
    stay where they are. Rounds end when the edges no longer
    change; their number grows with the logarithm of the longest path. Each round's edges are written to
    the shared folder. Null ends and loops are ignored; no edges give no rows.
    """
    now = materialise(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if state == seen or not state[0]:
            break
        seen, last = state, now
        large = materialise(spark, _large_star(now, state[0]), "large")
        now = materialise(spark, _small_star(large, large.count()), "edges")
        discard(spark, large)
        discard(spark, last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
