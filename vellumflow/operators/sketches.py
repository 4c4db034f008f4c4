"""Keys that groups share: counted from the rows, or estimated from theta sketches that are stored and merged without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.operators.entities import cooccurrences
from vellumflow.sources.scratch import cut

#: Logarithm of a sketch's entries: groups of at most 4,096 keys are exact, larger
#: ones have a relative standard error of about 1.6 % (an overlap's is of the union).
LG_ENTRIES = 12


def group_sketches(df: DataFrame, group: str, key: Column, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """group, sketch: the distinct keys of each group; partial sketches are merged before and after the shuffle.

    Keys go in by their 64-bit hash, the empty text among them; null keys don't count.
    Null groups are left out.
    """
    hashed = F.when(key.isNotNull(), F.xxhash64(key))
    return df.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("group")).agg(F.theta_sketch_agg(hashed, lg_entries).alias("sketch"))


def merged(first: DataFrame, *others: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Sketches of several tables, as if made of all their rows: stored ones need no second look at the old rows."""
    for other in others:
        first = first.unionByName(other)
    return first.groupBy("group").agg(F.theta_union_agg("sketch", lg_entries).alias("sketch"))


def overlaps(sketches: DataFrame, *, blocks: int = 16) -> DataFrame:
    """a, b, n_a, n_b, n_shared: estimates for every two groups a < b that share a key.

    Work is of the number of groups squared, on sketches of at most 32 KB: groups are
    dealt into blocks, a pair of blocks is a key, and no group's rows are read.
    """
    dealt = sketches.withColumn("at", F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int"))
    low = dealt.select("group", "sketch", F.col("at").alias("i"), F.explode(F.sequence("at", F.lit(blocks - 1))).alias("j")).alias("x")
    high = dealt.select("group", "sketch", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j")).alias("y")
    met = low.join(high, (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & ((F.col("x.i") < F.col("x.j")) | (F.col("x.group") < F.col("y.group"))))
    turned = F.col("x.group") > F.col("y.group")
    n = {side: F.theta_sketch_estimate(f"{side}.sketch") for side in ("x", "y")}
    rows = met.select(
        F.least("x.group", "y.group").alias("a"),
        F.greatest("x.group", "y.group").alias("b"),
        F.when(turned, n["y"]).otherwise(n["x"]).alias("n_a"),
        F.when(turned, n["x"]).otherwise(n["y"]).alias("n_b"),
        F.theta_sketch_estimate(F.theta_intersection("x.sketch", "y.sketch")).alias("n_shared"),
    )
    return rows.filter("n_shared > 0")


def exact_overlaps(df: DataFrame, group: str, key: Column) -> DataFrame:
    """a, b, n_a, n_b, n_shared: distinct keys of every two groups a < b that share one, whatever their number.

    Keys are told apart by their SHA-256, so that long texts aren't shuffled; a key of
    very many groups is paired by blocks. Null keys and groups are left out.
    """
    keys = df.filter(F.col(group).isNotNull() & key.isNotNull()).select(F.col(group).cast("string").alias("group"), F.unhex(F.sha2(key.cast("binary"), 256)).alias("key"))
    keys = cut(keys.distinct(), "keys")
    sizes = keys.groupBy("group").agg(F.count("*").alias("n"))
    sides = [sizes.select(F.col("group").alias(side), F.col("n").alias(f"n_{side}")) for side in ("a", "b")]
    shared = cooccurrences(keys, "key", "group").withColumnRenamed("n", "n_shared")
    return shared.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "n_shared")
