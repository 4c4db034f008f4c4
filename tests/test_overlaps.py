"""Overlaps of groups with more keys than a sketch holds."""

from pyspark.sql import functions as F

from vellumflow.operators.sketches import exact_overlaps


def test_overlaps_beyond_a_sketch(spark):
    rows = spark.range(20_000).select(F.explode(F.array(*[F.when(F.col("id") % k == 0, F.lit(g)) for g, k in (("a", 1), ("b", 2), ("c", 3))])).alias("g"), F.col("id").cast("string").alias("k"))
    rows = rows.union(rows.filter("g = 'b'")).union(spark.createDataFrame([("a", None), (None, "1"), ("d", ""), ("e", ""), ("f", "alone")], "g string, k string"))
    out = exact_overlaps(rows, "g", F.col("k"))
    assert sorted(map(tuple, out.collect())) == [("a", "b", 20_000, 10_000, 10_000), ("a", "c", 20_000, 6_667, 6_667), ("b", "c", 10_000, 6_667, 3_334), ("d", "e", 1, 1, 1)]
