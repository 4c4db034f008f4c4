"""Command line: ``python -m vellumflow.cli COMMAND``; every path may be in any store that Spark reaches."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellumflow.functions import metrics, text
from vellumflow.operators import corpus, entities, images, stats, tei
from vellumflow.sources import readers, writers


def table(spark: SparkSession, path: str):
    return readers.read_corpus_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def normalise(spark, a) -> None:
    text.with_normalized(table(spark, a.input), a.text).write.mode("overwrite").parquet(a.output)


def analyze(spark, a) -> None:
    entities.analyze(table(spark, a.input), a.text).write.mode("overwrite").parquet(a.output)


def split(spark, a) -> None:
    df = table(spark, a.input)
    best = corpus.split_search(df, a.group, a.stratum, a.strata.split(",") if a.strata else None, seeds=a.seeds).first()
    seeds = spark.createDataFrame([(best["seed1"], best["seed2"])], "seed1 int, seed2 int")
    groups = df.select(F.col(a.group).cast("string").alias("group")).filter("group is not null").distinct()
    assigned = corpus._assigned(groups, seeds, 0.15, 0.15).select("group", "split")
    writers.write_splits(corpus.with_split(df, a.group, assigned), a.output, order=a.order)
    writers.write_manifest(spark, f"{a.output.rstrip('/')}.manifest.txt", writers.file_hashes(spark, a.output), seed1=best["seed1"], seed2=best["seed2"], method="grouped, best of the searched seeds")


def evaluate(spark, a) -> None:
    df = table(spark, a.input)
    row = stats.recognition_summary(df, F.col(a.pred), F.col(a.gold)).join(df.agg(F.round(F.avg(metrics.wer(F.col(a.pred), F.col(a.gold))), 6).alias("mean_wer"))).first()
    print(json.dumps(row.asDict()))


def export_tei(spark, a) -> None:
    df = entities.analyze(table(spark, a.input), a.text)
    writers.write_tei(tei.tei_documents(df, "normalized", "entities", a.group), a.output, a.id)


def preprocess(spark, a) -> None:
    images.preprocess_images(readers.read_gray_images(spark, a.input, a.glob), sauvola_k=a.k).write.mode("overwrite").parquet(a.output)


def unavailable(spark, a) -> None:
    raise SystemExit(f"{a.command} needs a recognition model; pass predictions to evaluate instead")


COMMANDS = {"normalise": normalise, "analyze": analyze, "split": split, "evaluate": evaluate, "tei": export_tei, "preprocess": preprocess, "segment": unavailable, "transcribe": unavailable}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="vellumflow", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("input")
    p.add_argument("output", nargs="?", default="")
    for name, default in (("text", "text"), ("group", "shelfmark"), ("stratum", None), ("strata", None), ("order", "image_path"), ("pred", "pred"), ("gold", "gt"), ("id", "id"), ("glob", "*.png")):
        p.add_argument(f"--{name}", default=default)
    p.add_argument("--seeds", type=int, default=60)
    p.add_argument("--k", type=float, default=0.2)
    a = p.parse_args(args)
    COMMANDS[a.command](SparkSession.builder.appName("vellumflow").getOrCreate(), a)


if __name__ == "__main__":
    main()
