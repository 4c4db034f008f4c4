"""The line-level data contract and the dataset-level one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions.metrics import needs_review
from vellumflow.functions.text import normalize
from vellumflow.operators.corpus import update_element
from vellumflow.operators.entities import ENTITY

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
LINE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "shelfmark", "text", "text_normalized")],
        T.StructField("confidence", T.DoubleType()),
        T.StructField("needs_review", T.BooleanType()),
        T.StructField("polygon_ref", T.ArrayType(POINT)),
        T.StructField("ner_spans", T.ArrayType(ENTITY)),
        T.StructField("century", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)


def contract_lines(df: DataFrame, *, id_col: str, text_col: str, confidence: Column, preset: str = "readme") -> DataFrame:
    """Rows in the line contract; columns that ``df`` lacks are null."""
    text = F.col(text_col)
    made = {"id": F.col(id_col).cast("string"), "text": text, "text_normalized": normalize(text), "confidence": confidence.cast("double"), "needs_review": needs_review(confidence, text, preset=preset)}
    return df.select(*[(made[f.name] if f.name in made else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LINE])


def with_model_metrics(contract: DataFrame, model_id: str, **metrics) -> DataFrame:
    """The contract's models, the one with this id updated."""
    return contract.withColumn("modeles_htr", update_element(F.col("modeles_htr"), "id", F.lit(model_id), **{k: F.lit(v) for k, v in metrics.items()}))
