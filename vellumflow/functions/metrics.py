"""Error rates, agreement and confidence measures as Columns and small aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import distances

def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance in code points; equal texts cost nothing, others n + d² steps for n signs and d edits."""
    return F.when(a == b, F.lit(0)).otherwise(F.arrow_udf(distances.text_distances, "int")(F.when(a != b, a), b))


def cer(pred: Column, gold: Column) -> Column:
    """Edit distance over the gold text's length in code points; 0 for an empty gold text, may exceed 1."""
    return F.when(F.length(gold) == 0, F.lit(0.0)).otherwise(edit_distance(pred, gold) / F.length(gold))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of texts."""
    return F.when(a == b, F.lit(0)).otherwise(F.arrow_udf(distances.list_distances, "int")(F.when(a != b, a), b))


def wer(pred: Column, gold: Column) -> Column:
    """Edit distance over words; 0 where the gold text has none."""
    g = words(gold)
    return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(token_distance(words(pred), g) / F.size(g))


def accuracy(error: Column) -> Column:
    """One minus the mean error; no rows count as wrong."""
    return 1 - F.coalesce(F.avg(error), F.lit(1.0))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def needs_review(confidence: Column, text: Column, *, preset: str = "readme", est_cer: Column | None = None) -> Column:
    """Low confidence or a very short text; ``readme`` also asks for an estimated error rate."""
    least_conf, least_len = {"readme": (0.7, 5), "article": (0.6, 3)}[preset]
    flag = (confidence < least_conf) | (F.length(text) < least_len)
    return flag | (est_cer > 0.25) if preset == "readme" and est_cer is not None else flag


def bbox(points: Column) -> Column:
    """x0, y0, x1, y1 of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def clip(box: Column, width: Column, height: Column) -> Column:
    def within(value: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(value, most))

    return F.struct(F.greatest(F.lit(0), box["x0"]).alias("x0"), F.greatest(F.lit(0), box["y0"]).alias("y0"), within(box["x1"], width).alias("x1"), within(box["y1"], height).alias("y1"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 for two empty ones."""
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))

    def area(x: Column) -> Column:
        return (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])

    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def _filled(points: np.ndarray, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """Pixels whose centres lie within a polygon, by the even-odd rule."""
    out = np.zeros((height, width), bool)
    ys, xs = np.arange(height) + y0 + 0.5, np.arange(width) + x0 + 0.5
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0), strict=True):
        rows = np.flatnonzero((ys < ay) != (ys < by))
        if len(rows):
            cut = ax + (ys[rows] - ay) * (bx - ax) / (by - ay)
            out[rows] ^= xs[None, :] > cut[:, None]
    return out


def polygon_iou(a: Column, b: Column) -> Column:
    """Intersection over union, in whole pixels, of two arrays of (x, y); 0 where both are empty, null for null."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(left, right, strict=True):
            if p is None or q is None:
                out.append(None)
                continue
            p, q = (np.array([(v["x"], v["y"]) for v in ps], float).reshape(-1, 2) for ps in (p, q))
            both = np.concatenate([p, q])
            if not len(p) or not len(q):
                out.append(0.0)
                continue
            low, high = np.floor(both.min(0)).astype(int), np.ceil(both.max(0)).astype(int)
            m, n = (_filled(s, low[0], low[1], *(high - low)) for s in (p, q))
            union = int((m | n).sum())
            out.append(float((m & n).sum() / union) if union else 0.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def iou_summary(df: DataFrame, iou: str = "iou", thresholds: tuple[float, ...] = (0.75, 0.85)) -> DataFrame:
    v = F.col(iou)
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean_iou"), F.percentile(v, F.lit(0.5)).alias("median_iou"), *[F.count_if(v > t).alias(f"n_over_{round(t * 100)}") for t in thresholds])


def mcnemar(df: DataFrame, a_right: Column, b_right: Column, *, correction: bool = False) -> DataFrame:
    """Discordant counts, chi-square and p; without discordant rows 0 and 1."""
    counts = df.agg(F.count_if(a_right & ~b_right).alias("n_a_only"), F.count_if(~a_right & b_right).alias("n_b_only"))
    gap = F.abs(F.col("n_a_only") - F.col("n_b_only")).cast("double")
    gap = F.greatest(gap - 1, F.lit(0.0)) if correction else gap
    total = F.col("n_a_only") + F.col("n_b_only")
    return counts.withColumn("chi2", F.when(total > 0, gap * gap / total).otherwise(F.lit(0.0)))


def chi2_p(chi2: float) -> float:
    """Probability of a larger value with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, chi2) / 2))


def poisson(u: Column) -> Column:
    """The Poisson(1) count of a number in [0, 1)."""
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    return sum(((u >= s).cast("int") for s in steps), F.lit(0))


def bootstrap_ci(df: DataFrame, value_col: str, *, rounds: int = 1000, seed: int = 42, level: float = 0.95, few: int = 64) -> DataFrame:
    """Percentile interval of the mean, each round weighting rows by Poisson(1) counts drawn from hashes.

    Equal values are counted first, and a round draws once for a value: its rows'
    counts add up to a Poisson count of their number, near a normal one where they
    are more than ``few``; the rows of a rarer value draw one by one. So the work
    is rounds times distinct values, whatever the rows, and draws are summed by
    round before the shuffle.
    """
    counts = df.select(F.col(value_col).cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count("*").alias("_c"))
    each = counts.withColumn("_i", F.explode(F.when(F.col("_c") > few, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "_c"))))
    each = each.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "_r", "_v", "_i").cast("binary"))
    u, w = (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") / float(16**13) for at in (1, 14))
    normal = F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * w)
    weight = F.when(F.col("_i") == 0, F.greatest(F.lit(0.0), F.floor(F.col("_c") + F.sqrt("_c") * normal + 0.5).cast("double"))).otherwise(poisson(u).cast("double"))
    means = each.groupBy("_r").agg(F.try_divide(F.sum(F.col("_v") * weight), F.sum(weight)).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.round(F.percentile("m", F.lit(tail)), 6).alias("low"), F.round(F.percentile("m", F.lit(1 - tail)), 6).alias("high"), F.count("m").alias("n_rounds"))
