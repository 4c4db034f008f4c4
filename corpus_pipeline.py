"""Corpus pipeline: quality classifier, quality rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes each stage's rows to the shared folder and rereads them.
All but the last return the columns of ``docs``, whatever those are named. In
every stage a null text counts as empty, an empty table gives no rows, and long
texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumflow.llm import mixing, near_duplicates, packing, quality_classifier, quality_rules
from vellumflow.llm.shared import written
from vellumflow.llm.tokens import default_tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more; it is trained on ``docs`` and the labels.

    Null ids and repeated rows are scored like others; without labels of both
    kinds all have one score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_quality(docs, quality_classifier.fit_quality(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of policy v1, by the bits of their written ledger.

    A text without 50 words fails, so null and empty ones go; repeated rows are judged alike.
    """
    return quality_rules.filter_by_rules(docs, "v1")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Links are all pairs whose five-word shingles have a Jaccard coefficient of 0.8 or
    more: fingerprints that meet at covering anchors propose, an exact step completes
    them, and each link is decided by the coefficient.

    Texts without words are one group. Of repeated rows one stays; a group without
    any id keeps a row of each of its sets of shingles.
    """
    return near_duplicates.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for.

    Null sources are one source. Rows that share an id are taken alike; a null id
    draws by its text.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 ids.

    Null ids are kept; repeated rows are packed as often as they occur.
    """
    return packing.pack_documents(docs, default_tokenizer(), cache=PIECES)


#: Pieces that a worker's tokenizer keeps while packing; fewer than packing alone, as the worker has served other stages.
PIECES = 200_000
STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("near-duplicates", deduplicate), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs


#: Trained trees, fingerprints and a tokenizer aren't for SQL; the tests have a brute-force version.
ORACLE_SQL = None
