"""Connected components of links, by alternating large and small stars over DataFrames.

Per-node minima are written tables: small ones are broadcast after a check of
their size, larger ones are joined by shuffles whose hot keys Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.shared import forget, small, written, written_at


def _minima(edges: DataFrame, paths: list[str]) -> DataFrame:
    out, path = written_at(edges.groupBy("a").agg(F.min("b").alias("low")), "minima")
    paths.append(path)
    return small(out, 40)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (columns a, b; both long), root being the smallest node reached."""
    spark = links.sparkSession
    edges, path = written_at(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen, paths = None, [path]
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen or not state["n"]:
            break
        seen = (state["n"], state["h"])
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node is linked to the node's smallest
        large = both.filter("b > a").join(_minima(both, paths), "a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        large, path = written_at(large, "links")
        paths.append(path)
        # small star: a node and its smaller neighbours are linked to the smallest of them
        joined = large.join(_minima(large, paths), "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges, path = written_at(joined.select("e.a", "e.b").filter("a <> b").distinct(), "links")
        for old in paths:
            forget(spark, old)
        paths = [path]
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def component_of_nodes(first: DataFrame, rooted: DataFrame) -> DataFrame:
    """node, component_id, root of a written table node, first_id, given node, root of the linked ones."""
    member = first.join(rooted, "node")
    lowest = written(member.groupBy("root").agg(F.min("first_id").alias("lowest")), "lowest")
    named = written(rooted.join(small(lowest, 40), "root").select("node", "lowest", "root"), "named")
    joined = first.join(small(named, 48), "node", "left")
    alone = F.col("root").isNull()
    return written(joined.select("node", F.when(alone, F.col("first_id")).otherwise(F.col("lowest")).alias("component_id"), F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root")), "components")
