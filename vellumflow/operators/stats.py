"""Corpus statistics: lengths, abbreviation signs, alphabets, normalisation impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.metrics import cer
from vellumflow.functions.text import ABBREVIATIONS, normalize, text_column

#: Signs that stand for an abbreviation; the keys that are words are left out.
SIGNS = [k for k in ABBREVIATIONS if not k.isascii()]


def sign_count(text: Column, signs: list[str] | None = None) -> Column:
    return F.regexp_count(text, F.lit("|".join(SIGNS if signs is None else signs)))


def line_stats(df: DataFrame, text: Column, confidence: Column, review: Column) -> DataFrame:
    """One row: lines, mean and median length, lines with signs, signs, mean confidence, share to review."""
    n = sign_count(text)
    return df.agg(
        F.count(text).alias("n_lines"),
        F.round(F.avg(F.length(text)), 6).alias("mean_length"),
        F.percentile(F.length(text), F.lit(0.5)).alias("median_length"),
        F.count_if(n > 0).alias("n_with_signs"),
        F.sum(n).alias("n_signs"),
        F.round(F.avg(confidence), 6).alias("mean_confidence"),
        F.round(F.avg(review.cast("int")), 6).alias("review_share"),
    )


def top_signs(df: DataFrame, text: Column, k: int = 5, signs: list[str] | None = None) -> DataFrame:
    """sign, n of the k most frequent signs."""
    hits = df.select(F.explode(F.regexp_extract_all(text, F.lit(f"({'|'.join(SIGNS if signs is None else signs)})"), F.lit(1))).alias("sign"))
    return hits.groupBy("sign").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sign").limit(k)


def alphabet(df: DataFrame, text: Column) -> DataFrame:
    """sign, n for every code point; a task's signs are counted before the shuffle."""
    return df.select(F.explode(F.split(text, "")).alias("sign")).filter("sign <> ''").groupBy("sign").agg(F.count("*").alias("n"))


def normalization_impact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """original, normalized, cer_modification, changed for each line; TypeError if they aren't texts."""
    text_column(df, text_col)
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("original"), normalize(F.col(text_col)).alias("normalized"))
    return rows.select("original", "normalized", cer(F.col("normalized"), F.col("original")).alias("cer_modification"), (F.col("original") != F.col("normalized")).alias("changed"))


def recognition_summary(df: DataFrame, pred: Column, gold: Column) -> DataFrame:
    """n, n_errors, mean_cer, accuracy: rows without a prediction are errors and not in the mean."""
    error = F.col("_error")
    rows = df.select(F.when(pred.isNotNull() & gold.isNotNull(), cer(pred, gold)).alias("_error"))
    return rows.agg(F.count(error).alias("n"), F.count_if(error.isNull()).alias("n_errors"), F.round(F.avg(error), 6).alias("mean_cer"), F.round(1 - F.coalesce(F.avg(error), F.lit(1.0)), 6).alias("accuracy"))
