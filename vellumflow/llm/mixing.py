"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source, targets follow from the weights (a source's target
stops at ``most`` times its size, what it can't take goes to the others by
weight), and a source's repetition rate is its target over its size. A document
is emitted floor(rate) times, and once more if a number drawn from its hash is
below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.shared import column_name, small, written

WORD = r"[^\x20\x09-\x0D]+"
_HEX = 13  # digits of the hash that a draw uses, 52 bits


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the id's hash, or from the text's where the id is null."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, _HEX), 16, 10).cast("double") / float(16**_HEX)


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target, rate from a table source, size: a row per source, the null source too.

    Sources in code point order, null last, have the weights in turn. The level is
    where all targets, each the smaller of ``most`` times its source and level
    times weight, add up to ``share`` of all sizes; it is found from the sums over
    sources sorted by the level at which they stop. One row per source.
    """
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place % len(weights) + 1)
    ranked = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    stops = ranked.select(
        "*",
        F.row_number().over(by_stop).alias("k"),
        (F.col("cap") / F.col("weight")).alias("stop"),
        F.coalesce(F.sum("cap").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("stopped"),
        F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
        (F.sum("source_size").over(whole) * F.lit(share)).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open_weight"))
    found = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("k", "level"))).over(whole)["level"]
    target = F.coalesce(F.least(F.col("cap").cast("double"), found * F.col("weight")), F.col("cap").cast("double"))
    return written(
        stops.withColumn("target", target).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")),
        "targets",
    )


def copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("int")).cast("long")


def _with_rates(rows: DataFrame, targets: DataFrame, source: str, of: str) -> DataFrame:
    """Rows beside their source's targets, whose source is named ``of``; null sources match each other."""
    row_bytes = F.lit(48) + F.coalesce(F.octet_length(of), F.lit(0))
    return rows.join(small(targets, row_bytes), F.col(source).eqNullSafe(F.col(of)))


def mix_ledger(docs: DataFrame, *, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken, a row per row of ``docs``.

    A null text has size 0; null sources are one source, the last. Null ids draw
    by their text. Rows that share an id (or, without one, a text) draw alike.
    Sources without words have target 0 and take nothing. Empty: no rows; further
    columns are left out.
    """
    text, doc_id = F.col(text_col), F.col(id_col)
    sized = written(docs.select(doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), draw(seed, doc_id, text).alias("drawn")), "sized")
    rated = _with_rates(sized, source_targets(sized, **how).withColumnRenamed("source", "of_source"), "source", "of_source")
    return rated.withColumn("copies", copies(F.col("rate"), F.col("drawn"))).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, *, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    text, source = F.col(text_col), F.col(source_col).cast("string")
    targets = source_targets(docs.select(source.alias("source"), n_words(text).alias("size")), **how)
    key, of, rate, copy = (column_name(docs, stem) for stem in ("mixed_source", "of_source", "mix_rate", "mix_copy"))
    rated = _with_rates(docs.withColumn(key, source), targets.select(F.col("source").alias(of), F.col("rate").alias(rate)), key, of)
    n = copies(F.col(rate), draw(seed, F.col(id_col), text))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rated.select(*columns, F.explode(F.array_repeat(F.lit(1), n.cast("int"))).alias(copy)).select(*columns)
