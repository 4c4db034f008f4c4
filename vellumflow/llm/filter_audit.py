"""Audit of how filters interact: what each removes in every order they may be applied in.

A relational word pipeline: words are exploded, counted by (document, word), and
those counts by document, for totals and distinct words. Other flags are outer-joined
to them; the five failure bits of a document make one of 32 masks, and a part's
documents are counted by mask in 32 conditional columns (three times: all, good and
toxic ones). All 120 orders are then arithmetic on these counts: a document is gone
before a step if its mask meets the filters of the steps before.

A document is known by its id and its text's digest. Texts are dealt by that key
before they are exploded, so both counts happen where the words are made and no word is
shuffled. Copies under many ids are many keys; whoever is first of its text is
found by a minimum that combines before its shuffle, and joined on the same key.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.shared import Scratch, written

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["doc_id", "digest"]


def texts_of(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.md5(text.cast("binary")).alias("digest"))


def word_totals(texts: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, n_distinct of the texts that have words.

    A null beside each text's words counts the rows that share id and text, so that
    repeated rows don't count their words twice.
    """
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    dealt = texts.select(*_KEY, "text").repartition(*_KEY)
    each = dealt.select(*_KEY, F.explode(F.array_append(words, F.lit(None).cast("string"))).alias("word"))
    by_word = each.groupBy(*_KEY, "word").agg(F.count("*").alias("n"))
    rows = F.max(F.when(F.col("word").isNull(), F.col("n")))
    n_words = F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0))
    return by_word.groupBy(*_KEY).agg((n_words / rows).cast("long").alias("n_words"), F.count("word").alias("n_distinct"))


def bit(condition: Column, letter: str) -> Column:
    return F.when(condition, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic, n: the rows of ``docs`` that share id, text and part, and how many they are."""
    texts = texts_of(docs, id_col, text_col, part_col)
    n_upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    own = bit(100 * n_upper > 5 * F.length("text"), "C") + bit(F.col("text").rlike(r"[#$%&*|]"), "D")
    with Scratch(docs.sparkSession) as scratch:
        flags = scratch.written(texts.select(*_KEY, "part", own.alias("own")), "flags")
        flags = flags.groupBy(*_KEY, "part", "own").agg(F.count("*").alias("n"))
        first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        labelled = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        words = word_totals(texts)
        same = [F.col(f"f.{k}").eqNullSafe(F.col(f"w.{k}")) for k in _KEY]
        joined = flags.alias("f").join(words.alias("w"), same[0] & same[1], "left").select("f.*", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
        joined = joined.join(first, _KEY, "left").join(labelled, "doc_id", "left")
        later = F.col("first").isNull() & F.col("doc_id").isNotNull()
        mask = F.col("own") + bit(F.col("n_words") < 50, "A") + bit(100 * F.col("n_distinct") < 65 * F.col("n_words"), "B") + bit(later, "E")
        return written(joined.select("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n"), "masks")


def conditional_counts(masked: DataFrame) -> DataFrame:
    """part and the arrays n, good, toxic: for each of the 32 masks its documents in the part."""

    def columns(condition: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & condition, F.col("n"))), F.lit(0)).cast("long") for m in range(1 << len(FILTERS))])

    return masked.groupBy("part").agg(columns(F.lit(True)).alias("n"), columns(F.col("good")).alias("good"), columns(F.col("toxic")).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, by the counts of :func:`conditional_counts`."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {c: F.instr(F.col("filter_order"), F.lit(c)) for c in FILTERS}
    before = sum((F.when(place[c] < F.col("step"), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(FILTERS)), F.lit(0))
    here = sum((F.when(place[c] == F.col("step"), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"before": before, "here": here})

    def total(of: str, condition) -> Column:
        """Documents of the masks that meet a condition."""
        terms = F.transform(F.col(of), lambda n, m: F.when(condition(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, b: a + b)

    def fails(m: Column) -> Column:
        return m.bitwiseAND(F.col("here")) != 0

    def gone(m: Column) -> Column:
        return m.bitwiseAND(F.col("before")) != 0

    def removed(m: Column) -> Column:
        return fails(m) & ~gone(m)

    # a filter is the first of a mask's k failing ones in 120 / k orders
    ranks = F.transform("n", lambda n, m: F.when(fails(m), n * (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("here")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.aggregate(ranks, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty (it fails A), a null part as an empty string.
    Repeated rows count as often as they occur, and none of them makes another fail
    E, as their ids are equal; a null id is not larger than any, so it never fails E.
    A document is good (toxic) if any label of its id says so; labels of no document
    are ignored. Texts are taken whole, whatever their length; further columns are
    left out; an empty table gives no rows.
    """
    return audit(conditional_counts(masks(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)))
