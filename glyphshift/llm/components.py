"""Connected components by alternating stars: each round points every node at smaller neighbours, and edges stay linear.

Edges are a table of two long columns. Minima are grouped with partial sums and joined back, so a node with very many
neighbours is never collected; skewed joins are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import release, write_cut


def star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): with m the least of u and its v, the edges from each of them to m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    return joined.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, least), a written table: of every node with an edge, the least node that it reaches."""
    clean = lambda df: df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = write_cut(clean(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = clean(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, now = now, write_cut(clean(star(large)))
        release(before)
        if (then := state(now)) == seen:
            break
        seen = then
    # Every edge now points at the least node of its component.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct()
    found = write_cut(now.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(roots))
    release(now)
    return found
