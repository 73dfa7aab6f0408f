"""Connected components of a table of edges, by alternating star operations.

Every node is led to the least neighbour of its neighbourhood until the edges are stars around the least id of
each component. A round is two groupings and two joins; the number of rounds grows with the logarithm of the
longest path. No component is ever gathered in one place: the neighbours of a hub are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docweave.llm.skew import LEAST, star_join
from docweave.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't itself the root. Self edges and nulls count for nothing."""
    now, mark = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        n = mark[0]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n").where("n > 0")
        large = star_join(both.where("v > u"), least.select("u", "m"), "u", "v", least.select("u", "n"), n).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        if n > LEAST:
            large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        pairs = star_join(large, least.select("a", "m"), "a", "b", least.select("a", "n"), n).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        last = mark
        now, mark = _written(pairs.where("e.a <> e.m").select("e.a", F.col("e.m").alias("b")).distinct())
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and the exclusive-or of their hashes, which are the same for the same edges, seen while they are written."""
    seen = Observation()
    table = cut(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
    return table, (seen.get["n"], seen.get["x"])
