"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import cut

LEAST_TASKS, TASK_ROWS = 8, 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of `edges` (columns a, b: long) with the smallest node that it is connected to.

    Each step replaces the neighbours of a node by the smallest of them, through a pre-aggregated minimum that is joined
    back, so that a node with very many neighbours needs no list of them; both sides of that join are dealt by the join
    alone, so that adaptive execution can split a node with very many. The rounds grow with the logarithm of the longest
    chain; stars end after two. Every round but the last lowers some label, so the loop ends. Tables of edges are held in
    one partition for every TASK_ROWS of them. Edges with a null end and loops are left out.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = cut(now), None
    while (state := _state(now)) != before and state[0]:
        before, tasks = state, max(LEAST_TASKS, state[0] // TASK_ROWS)
        now = now.coalesce(tasks)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m").coalesce(tasks)
        small = large.join(least, large.u == least.k).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        now = cut(small.coalesce(tasks).distinct().coalesce(tasks))
    roots = now.groupBy("v").agg(F.lit(0)).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
