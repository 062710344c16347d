"""Connected components by alternating large and small stars; nothing is gathered on the driver but a count and a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labcurate.llm.common import cut, discard, join_unique


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r.n, int(r.h)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node that can be reached.

    Each round sends every node's larger neighbours to its smallest neighbour, then every node and its smaller neighbours to the
    smallest of them; the edges end as stars.  A node's neighbours are only ever reduced to their minimum, with partial
    minima where they are, and the edges of a node with very many are joined with it where they are.  Self-loops, repeated and reversed edges are harmless; no edges give no rows.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = join_unique(both.where(F.col("b") > F.col("a")), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.where(F.col("a") != F.col("b")))
        below = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        rest = join_unique(large, below, "a", "n").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, cut(rest.unionByName(below.select("a", F.col("m").alias("b"))).distinct())
        discard(old, large, least, below)
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
