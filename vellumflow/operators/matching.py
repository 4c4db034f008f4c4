"""Predicted and true lines of a page, matched one to one by their boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.metrics import box_iou
from vellumflow.sources.scratch import cut

PAIR = ["page", "truth", "pred"]
CROWDED = 512  # pairs beyond which a page isn't walked by one task


def cells(box: Column, cell: int, corner: bool) -> Column:
    """Numbers of the grid's columns and rows that a box touches, as an array of (cx, cy)."""
    low = [F.floor(box[c] / cell) for c in ("x0", "y0")]
    if corner:
        return F.struct(low[0].alias("cx"), low[1].alias("cy"))
    high = [F.floor(box[c] / cell) for c in ("x1", "y1")]
    return F.flatten(F.transform(F.sequence(low[0], high[0]), lambda x: F.transform(F.sequence(low[1], high[1]), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def overlapping(truth: DataFrame, pred: DataFrame, *, page: str = "page", key: str = "line_id", box: str = "box", cell: int = 256) -> DataFrame:
    """page, truth, pred, iou: the pairs of boxes of a page that share an area.

    Boxes are dealt to the cells of a grid and meet there, so a page of very many
    lines is many keys; a pair that shares several cells counts in the one that holds
    the first corner of what it shares. A box goes to as many cells as it touches:
    ``cell`` should be about the height or width of a common line. Boxes that are null
    or without area, and null pages, meet nothing.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        b = F.col(box)
        some = df.filter((b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & F.col(page).isNotNull() & F.col(key).isNotNull())
        return some.select(F.col(page).alias("page"), F.col(key).alias(name), b.alias(f"{name}_box"), F.explode(cells(b, cell, False)).alias("c")).select("page", name, f"{name}_box", "c.*")

    met = dealt(truth, "truth").join(dealt(pred, "pred"), ["page", "cx", "cy"])
    shared = F.struct(*[F.greatest(f"truth_box.{c}", f"pred_box.{c}").alias(c) for c in ("x0", "y0")])
    iou = box_iou(F.col("truth_box"), F.col("pred_box"))
    once = cells(shared, cell, True) == F.struct("cx", "cy")
    return met.filter(once).select(*PAIR, iou.alias("iou")).filter("iou > 0")


def rank(iou: Column, truth: Column, pred: Column) -> Column:
    """What pairs are taken by, ascending."""
    return F.struct((-iou).alias("worse"), F.md5(F.concat_ws(":", truth, pred).cast("binary")).alias("tie"), truth.alias("truth"), pred.alias("pred"))


def walked(pairs: DataFrame) -> DataFrame:
    """The pairs of :func:`one_to_one`, each page's one after the other; for pages of few pairs, which are shuffled once."""
    each = pairs.groupBy("page").agg(F.collect_list(F.struct("truth", "pred", "iou")).alias("ps"))
    ranked = F.array_sort(F.transform("ps", lambda p: rank(p["iou"], p["truth"], p["pred"])))

    def step(taken: Column, p: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["truth"] == p["truth"]) | (t["pred"] == p["pred"]))
        return F.when(free, F.concat(taken, F.array(p))).otherwise(taken)

    kind = "array<struct<worse:double,tie:string,truth:string,pred:string>>"
    taken = F.aggregate(ranked.cast(kind), F.array().cast(kind), step)
    return each.select("page", F.explode(taken).alias("o")).select("page", "o.truth", "o.pred", (-F.col("o.worse")).alias("iou"))


def one_to_one(pairs: DataFrame, *, crowded: int = CROWDED) -> DataFrame:
    """Of page, truth, pred, iou the pairs taken by descending iou, a line at most once on either side.

    Equal ones go by the md5 of their lines' ids. A page of at most ``crowded`` pairs is
    walked by one task. For the others, in each round every pair is taken that comes
    first for both its lines, which gives the same as one pair after the other; as
    equal ones are in a random order, a row of lines that overlap alike takes few
    rounds. Rounds are written tables: what is left shrinks in each.
    """
    strings = [F.col("page"), F.col("truth").cast("string").alias("truth"), F.col("pred").cast("string").alias("pred"), F.col("iou").cast("double").alias("iou")]
    pairs = cut(pairs.select(*strings), "pairs")
    large = cut(pairs.groupBy("page").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("page"), "crowded")
    if large.isEmpty():
        return cut(walked(pairs), "matched")
    rounds = [cut(walked(pairs.join(large, "page", "left_anti")), "matched")]
    order = rank(F.col("iou"), F.col("truth"), F.col("pred"))
    left = cut(pairs.join(large, "page", "left_semi").withColumn("o", order), "pairs")
    while not left.isEmpty():
        first = [left.groupBy("page", side).agg(F.min("o").alias("o")).select("page", "o") for side in ("truth", "pred")]
        both = first[0].join(first[1], ["page", "o"]).select("page", "o.truth", "o.pred", (-F.col("o.worse")).alias("iou"))
        rounds.append(cut(both, "matched"))
        for side in ("truth", "pred"):
            left = left.join(rounds[-1].select("page", side), ["page", side], "left_anti")
        left = cut(left, "pairs")
    return reduce(DataFrame.unionByName, rounds)


def match_lines(truth: DataFrame, pred: DataFrame, *, page: str = "page", key: str = "line_id", box: str = "box", cell: int = 256) -> DataFrame:
    """page, truth, pred, iou: all lines, those without a partner with null and 0.

    Lines are matched greedily by their boxes' intersection over union. A line's id
    is unique within its page and side; rows that share one are one line with several
    boxes. Lines with null ids are left out; an empty side leaves the other unmatched.
    """
    matched = one_to_one(overlapping(truth, pred, page=page, key=key, box=box, cell=cell))

    def alone(df: DataFrame, side: str) -> DataFrame:
        lines = df.select(F.col(page).alias("page"), F.col(key).alias(side)).filter(F.col(side).isNotNull()).distinct()
        return lines.join(matched.select("page", side), ["page", side], "left_anti").withColumn("iou", F.lit(0.0))

    return matched.unionByName(alone(truth, "truth"), allowMissingColumns=True).unionByName(alone(pred, "pred"), allowMissingColumns=True)


def matching_summary(matches: DataFrame, thresholds: tuple[float, ...] = (0.75, 0.85)) -> DataFrame:
    """Matched, missed and invented lines; mean and median over matched pairs, and how many exceed each threshold."""
    iou = F.when(F.col("truth").isNotNull() & F.col("pred").isNotNull(), F.col("iou"))
    return matches.agg(
        F.count(iou).alias("n_matched"),
        F.count_if(F.col("pred").isNull()).alias("n_missed"),
        F.count_if(F.col("truth").isNull()).alias("n_invented"),
        F.round(F.avg(iou), 6).alias("mean_iou"),
        F.round(F.percentile(iou, F.lit(0.5)), 6).alias("median_iou"),
        *[F.count_if(iou > t).alias(f"n_over_{round(t * 100)}") for t in thresholds],
    )
