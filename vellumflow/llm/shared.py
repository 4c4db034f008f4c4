"""Shared plumbing: tables in the cluster's shared folder and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a table that may be broadcast; beyond it a shuffled join is used.
BROADCAST_BYTES = 16 << 20
#: Whether a query's shuffle files go when it ends, not only when the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A temporary folder stands in only where that is unset and the master is
    ``local``, ``local[*]`` and the like, whose executor is the driver. Anywhere else
    each executor would write to its own disk, so an unset folder raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    folder = local_folder(context.master)
    context.setCheckpointDir(folder)
    return f"file://{folder}"


def local_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is unset; with master {master} it must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="vellumflow-")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/vellumflow/{spark.sparkContext.applicationId}"
    if path not in _announced:
        _announced.add(path)
        at, files = _path(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
    return path


_announced: set[str] = set()


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{own_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    return written_at(df, kind)[0]


def written_at(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, kind)
    with setting(df.sparkSession, SHUFFLES_END, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`written_at` that nothing reads any more."""
    for path in paths:
        at, files = _path(spark, path)
        files.delete(at, True)


class Scratch:
    """Tables of one step: deleted together when the block ends, so what outlives it must be written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, kind: str) -> DataFrame:
        table, path = written_at(df, kind)
        self.paths.append(path)
        return table

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        forget(self.spark, *self.paths)


def forget_all(spark: SparkSession) -> None:
    """Delete every table that this application wrote; results that read them are of no use afterwards."""
    path = own_folder(spark)
    _announced.discard(path)
    forget(spark, path)


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows for what is written within, whose rows hold whole texts; the session's own size after."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs within; its own value after."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, row_bytes, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size is under ``most`` bytes, else unmarked.

    ``row_bytes``: most bytes of a row, or a Column with its size; ``df`` should be
    cheap to read, such as a written table.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a worker process keeps between tasks: one thing at a time, so what one stage has kept goes when the next keeps its own."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def column_name(df: DataFrame, stem: str) -> str:
    """``stem``, or ``stem_``, ``stem__`` ... : a name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
