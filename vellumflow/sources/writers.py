"""Writers: tables, journals, manifests, TEI, line pairs, crops as PNG, Arrow files."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.operators.corpus import dense_index
from vellumflow.sources.arrow_source import opened, qualified, write_arrow  # noqa: F401  a writer like the others


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Header, quotes doubled; ``one_file`` only for tables that one task may hold."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_splits(df: DataFrame, path: str, split: str = "split", order: str = "image_path") -> None:
    """Parquet, a folder per split, rows sorted within files; readers of one split prune the others."""
    df.repartitionByRange(F.col(split), F.col(order)).sortWithinPartitions(split, order).write.mode("overwrite").partitionBy(split).parquet(path)


def append_journal(spark: SparkSession, path: str, entry: dict) -> None:
    """One more line; letters beyond ASCII stay as they are."""
    spark.createDataFrame([(json.dumps(entry, ensure_ascii=False),)], "value string").coalesce(1).write.mode("append").text(path)


def _hadoop_text(spark: SparkSession, path: str, text: str) -> None:
    _hadoop_bytes(spark, path, text.encode())


def _hadoop_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_json_document(spark: SparkSession, path: str, document: dict) -> None:
    _hadoop_text(spark, path, json.dumps(document, indent=2, ensure_ascii=False))


def file_hashes(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """path, sha256 of the files' bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str, hashes: DataFrame, *, seed1: int, seed2: int, method: str) -> None:
    """The seeds that were found, the method, and a line ``name : sha256`` per file (few, by contract)."""
    rows = hashes.orderBy("path").collect()
    lines = [f"seeds: {seed1}, {seed2}", f"method: {method}", *(f"{r['path'].rsplit('/', 1)[-1]} : {r['sha256']}" for r in rows)]
    _hadoop_text(spark, path, "\n".join(lines) + "\n")


def write_tei(df: DataFrame, path: str, id_col: str, tei_col: str = "tei") -> None:
    """id, tei as Parquet in files of Spark's sizes: documents as they are, line breaks included."""
    df.select(F.col(id_col).cast("string").alias("id"), F.col(tei_col).alias("tei")).write.mode("overwrite").parquet(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> int:
    """One file for each row, of its text or bytes as they are (null: empty); the number of rows.

    Tasks write their rows' files, so names are to be unique; a task that runs again
    writes the same files again. The folder is in a store that pyarrow.fs opens.
    """
    to = qualified(df.sparkSession, folder)

    def write(batches):
        store, at = opened(to)
        store.create_dir(at, recursive=True)
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{at}/{file}") as out:
                    out.write(body or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = df.select(F.col(name).cast("string").alias("n"), F.col(content).cast("binary").alias("c"))
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_tei_files(df: DataFrame, folder: str, id_col: str, tei_col: str = "tei") -> int:
    """``id.xml`` for each document, UTF-8; the number of files."""
    return write_files(df.withColumn("_name", F.concat(F.col(id_col).cast("string"), F.lit(".xml"))), folder, "_name", tei_col)


def png(image: Column) -> Column:
    """A grey image (height, width, data) as the bytes of a PNG file; null for null or an empty image."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    @F.pandas_udf("binary")
    def encode(images: pd.DataFrame) -> pd.Series:
        out = []
        for h, w, data in images[["height", "width", "data"]].itertuples(index=False):
            if data is None or not h or not w:
                out.append(None)
                continue
            h, w = int(h), int(w)
            lines = np.zeros((h, w + 1), np.uint8)  # each line begins with its filter, none
            lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(h, w)
            head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
            out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b""))
        return pd.Series(out, dtype=object)

    return encode(image)


def numbered_crops(df: DataFrame, order: list[str], *, image: str = "image", box: str = "box", pattern: str = "line_%05d.png") -> DataFrame:
    """``df`` with name, png: the crops numbered from 0 in an order; empty crops have null."""
    numbered = dense_index(df, order, out="_number")
    return crops(numbered, image, box).withColumn("name", F.format_string(pattern, "_number")).withColumn("png", png(F.col("crop"))).drop("_number", "crop")


def write_pairs(df: DataFrame, path: str, *, image_path: str = "image_path", text: str = "text", files: DataFrame | None = None) -> int:
    """Name, image and text of each line as Parquet, in place of a folder of links; the number of rows.

    With ``files`` (a column path, as of ``list_files``), lines whose image isn't among them are left out.
    """
    from vellumflow.functions.text import basename
    from vellumflow.sources.readers import existing

    there = existing(df, image_path, files)[0] if files is not None else df
    there.select(basename(F.col(image_path)).alias("name"), F.col(image_path).alias("image_path"), F.col(text).alias("gt")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_compiled(df: DataFrame, path: str, split: str, metadata: dict) -> None:
    """Rows flagged for one split, beside a JSON of their metadata."""
    flags = {s: F.lit(s == split) for s in ("train", "validation", "test")}
    df.withColumns(flags).write.mode("overwrite").parquet(path)
    write_json_document(df.sparkSession, f"{path}.json", metadata)


def arrow_bytes(df: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """content: an Arrow IPC file for each partition, with schema metadata."""

    def pack(batches):
        sink, writer = pa.BufferOutputStream(), None
        for batch in batches:
            schema = batch.schema.with_metadata(metadata or {})
            writer = writer or pa.ipc.new_file(sink, schema)
            writer.write_batch(batch.replace_schema_metadata(metadata or {}))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])

    return df.mapInArrow(pack, "content binary")


def crops(df: DataFrame, image: str = "image", box: str = "box") -> DataFrame:
    """``df`` and crop: the part of the image within the clipped box."""
    @F.pandas_udf("struct<height:int,width:int,data:binary>")
    def cut(images: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (h, w, data), (x0, y0, x1, y1) in zip(images[["height", "width", "data"]].itertuples(index=False), boxes[["x0", "y0", "x1", "y1"]].itertuples(index=False), strict=True):
            part = np.frombuffer(data, np.uint8).reshape(int(h), int(w))[max(0, int(y0)) : int(y1), max(0, int(x0)) : int(x1)]
            out.append((part.shape[0], part.shape[1], part.tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "data"])

    return df.withColumn("crop", cut(F.col(image), F.col(box)))
