"""Sketches of groups against exact sets."""

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import sketches


def shared(rows):
    sets = {}
    for g, k in rows:
        if g is not None:
            sets.setdefault(g, set()).update([k] if k is not None else [])
    return {(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_small_groups_are_exact(spark, blocks):
    rows = [(f"g{g}", f"k{(g * 5 + i * i) % 17}") for g in range(9) for i in range(g + 1)] * 2 + [("g1", None), (None, "k1"), ("g2", ""), ("g3", ""), ("lone", "x"), ("none", None)]
    made = sketches.group_sketches(spark.createDataFrame(rows, "g string, k string"), "g", F.col("k"))
    assert {tuple(r) for r in sketches.overlaps(made, blocks=blocks).collect()} == shared(rows)
    assert sketches.overlaps(made.limit(0), blocks=blocks).count() == 0


def test_merged_equals_made_at_once_and_large_ones_are_close(spark, tmp_path):
    df = spark.range(60_000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("g"), "id").filter("(g = 'a' and id < 40000) or (g = 'b' and id >= 20000)")
    for name, part in (("old", df.filter("id % 3 = 0")), ("new", df.filter("id % 3 <> 0"))):
        sketches.group_sketches(part, "g", F.col("id")).write.parquet(str(tmp_path / name))
    stored = sketches.merged(*[spark.read.parquet(str(tmp_path / n)) for n in ("old", "new")])
    for made in (stored, sketches.group_sketches(df, "g", F.col("id"))):
        r = sketches.overlaps(made).first()
        assert abs(r["n_a"] - 40_000) < 2_500 and abs(r["n_b"] - 40_000) < 2_500 and abs(r["n_shared"] - 20_000) < 3_500
