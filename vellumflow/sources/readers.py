"""Readers: tables, PAGE-XML, images, journals, Arrow files. Every path may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions.metrics import bbox
from vellumflow.functions.text import collapse_spaces, is_blank, polygon, strip
from vellumflow.operators.corpus import SCHEMA, shelfmark_of

PAGE_NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"


def read_corpus_csv(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, line breaks within quotes; the schema is given."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, **equal: object) -> DataFrame:
    """Columns and equality filters reach the scan."""
    df = spark.read.parquet(path)
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    return df.select(*columns) if columns else df


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of a compiled store whose boolean column ``split`` is true."""
    return spark.read.parquet(path).filter(F.col(split))


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, modificationTime, length of the files with this suffix; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select("path", "modificationTime", "length").orderBy("path")


def latest_file(spark: SparkSession, path: str, suffix: str) -> str | None:
    """The last file by name."""
    row = list_files(spark, path, suffix).agg(F.max("path").alias("path")).first()
    return row["path"]


def existing(df: DataFrame, path_col: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose file, by name, is among ``files``, and the others."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    names = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("_name")).distinct()
    return df.join(names, name == F.col("_name"), "left_semi"), df.join(names, name == F.col("_name"), "left_anti")


def read_page_xml(spark: SparkSession, path: str) -> DataFrame:
    """file, image, position, text, points, box, shelfmark: a row per text line that isn't blank.

    A line's text is its first one; ``index`` isn't given here, see ``corpus.dense_index``.
    """
    unicode_text = T.StructType([T.StructField("Unicode", T.StringType())])
    line = T.StructType([T.StructField("_id", T.StringType()), T.StructField("Coords", T.StructType([T.StructField("_points", T.StringType()), T.StructField("_VALUE", T.StringType())])), T.StructField("TextEquiv", T.ArrayType(unicode_text))])
    region = T.StructType([T.StructField("TextLine", T.ArrayType(line))])
    page = T.StructType([T.StructField("_imageFilename", T.StringType()), T.StructField("TextRegion", T.ArrayType(region)), T.StructField("TextLine", T.ArrayType(line))])
    pages = spark.read.format("xml").option("rowTag", "Page").option("ignoreNamespace", "true").schema(page).load(path).withColumn("file", F.input_file_name())
    nested = F.flatten(F.transform(F.coalesce(F.col("TextRegion"), F.array().cast(T.ArrayType(region))), lambda r: F.coalesce(r["TextLine"], F.array().cast(T.ArrayType(line)))))
    every = F.concat(nested, F.coalesce(F.col("TextLine"), F.array().cast(T.ArrayType(line))))
    rows = pages.select("file", F.col("_imageFilename").alias("image"), F.posexplode(every).alias("position", "line"))
    text = F.col("line.TextEquiv")[0]["Unicode"]
    out = rows.filter(~is_blank(text)).select("file", "image", "position", strip(text).alias("text"), polygon(F.col("line.Coords._points")).alias("points"))
    return out.withColumn("box", bbox(F.col("points"))).withColumn("shelfmark", shelfmark_of(F.col("image")))


# Fixed value: names of the line images cut from pages.
LINE_IMAGE = "himanis_%05d.png"


def page_lines(pages: DataFrame, *, pattern: str = LINE_IMAGE, project: str, source_corpus: str, century: str = "15", language: str = "French") -> DataFrame:
    """PAGE-XML lines as corpus rows, with the page they come from."""
    from vellumflow.operators.corpus import dense_index

    numbered = dense_index(pages, ["file", "position"])
    return numbered.select("text", F.format_string(pattern, "index").alias("image_path"), F.lit(language).alias("language"), F.lit(century).alias("century"), "shelfmark", F.lit(project).alias("project"), F.lit(source_corpus).alias("source_corpus"), F.col("image").alias("source_page"))


def read_gray_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, image (height, width, data); needs Pillow on the workers, and null marks what can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def decode(batches):
        import io

        import pandas as pd

        try:
            from PIL import Image
        except ImportError:
            Image = None

        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                try:
                    im = Image.open(io.BytesIO(raw)).convert("L")
                    out.append({"height": im.height, "width": im.width, "data": im.tobytes()})
                except Exception:  # noqa: BLE001  any undecodable file
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "image": pd.Series(out, dtype=object)})

    return files.mapInPandas(decode, "path string, image struct<height:int,width:int,data:binary>")


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A document over many lines, as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_journal(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A line per entry; without a schema, the union of the keys."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_journal_variant(spark: SparkSession, path: str) -> DataFrame:
    """line, entry: each entry as a variant, so entries of unlike keys need no common schema; null where it is no JSON."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").filter(~is_blank(F.col("line")))
    return lines.withColumn("entry", F.try_parse_json("line"))


def typed(entries: DataFrame, **wanted: str) -> DataFrame:
    """Columns of ``name="$.path type"``; null where an entry lacks the path or holds what isn't of the type."""
    return entries.select(*[F.try_variant_get("entry", *spec.split(" ", 1)).alias(name) for name, spec in wanted.items()])


def decoded_metadata(spark: SparkSession, path: str, key: str, glob: str = "*.arrow") -> DataFrame:
    """path, entry: one key of the files' schema metadata, decoded as a variant."""
    return arrow_metadata(spark, path, glob).filter(F.col("key") == key).select("path", F.try_parse_json("value").alias("entry"))


def read_arrow_files(spark: SparkSession, path: str, schema: str, glob: str = "*.arrow") -> DataFrame:
    """Rows of Arrow IPC files, a task for each share of files, a file read batch by batch."""
    names = [f.name for f in T._parse_datatype_string(schema)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                reader = pa.ipc.open_file(pa.py_buffer(raw.as_py()))
                for k in range(reader.num_record_batches):
                    yield reader.get_batch(k).select(names)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content").mapInArrow(read, schema)


def arrow_metadata(spark: SparkSession, path: str, glob: str = "*.arrow") -> DataFrame:
    """path, key, value of the files' schema metadata."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                meta = pa.ipc.open_file(pa.py_buffer(raw.as_py())).schema.metadata or {}
                keys = [k.decode() for k in meta]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([v.decode("utf-8", "replace") for v in meta.values()], pa.string())], names=["path", "key", "value"])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(read, "path string, key string, value string")


def requests(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A table of given texts, for a handful of requests."""
    return spark.createDataFrame([(t,) for t in texts], "text string")


def tidy(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, collapse_spaces(F.col(col)))
