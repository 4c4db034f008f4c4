"""Request-shaped entry points over the same operators; bulk work uses ``entities.analyze`` on a table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vellumflow.operators.entities import GazetteerPredictor, NERPipeline, analyze

STATUS = "ok"


def health(pipeline: NERPipeline | None = None) -> dict[str, str]:
    return {"status": STATUS, "model": (pipeline or NERPipeline()).name}


def analyze_texts(spark: SparkSession, texts: list[str], make=GazetteerPredictor) -> list[dict]:
    """original, normalized, entities, n_entities per text, in order; a blank text raises ValueError.

    A text of which the rules leave nothing has no entities.
    """
    if bad := [type(t).__name__ for t in texts if t is not None and not isinstance(t, str)]:
        raise TypeError(f"texts are expected, not {bad[0]}")
    if any(t is None or not t.strip() for t in texts):
        raise ValueError("a text is blank")
    rows = analyze(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", make).orderBy("i").collect()
    return [{"original": r["original"], "normalized": r["normalized"], "entities": [e.asDict() for e in r["entities"] or []], "n_entities": r["n_entities"]} for r in rows]
