"""Arrow IPC files as a data source: read by shares of record batches, written by tasks, committed as a whole.

A folder holds the files and, once a write is committed, ``_files.jsonl``: a line per
file with its name, size, batches, rows and flags. Files that the list lacks (of tasks that
failed or ran twice) are never read; a folder without a list is read by its names.
Paths are in any store that pyarrow.fs opens (file, hdfs, viewfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

LIST = "_files.jsonl"
#: Columns that say which split a row is of; a file holds rows of one combination.
FLAGS = ("train", "validation", "test")
SHARE = 128 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark gives it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(at).toString()


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Share(InputPartition):
    path: str
    first: int
    last: int


def listed(store: fs.FileSystem, folder: str) -> list[dict]:
    """The committed files, or those that are there by name; ``bytes`` and ``batches`` may be unknown."""
    at = f"{folder}/{LIST}"
    if store.get_file_info(at).type == fs.FileType.File:
        with store.open_input_stream(at) as f:
            return [json.loads(line) for line in f.read().splitlines()]
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return []
    there = store.get_file_info(fs.FileSelector(folder))
    return [{"name": i.base_name, "bytes": i.size} for i in sorted(there, key=lambda i: i.path) if i.base_name.endswith(".arrow")]


class ShareReader(DataSourceReader):
    """``filter("train")`` drops whole files by their flags, then batches, then rows."""

    def __init__(self, folder: str, schema: T.StructType, share: int) -> None:
        self.folder, self.schema, self.share, self.flags = folder, schema, share, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        flags = {f.name for f in self.schema if f.dataType == T.BooleanType()}
        is_true = {id(f): f.attribute[0] for f in filters if isinstance(f, EqualTo) and f.value is True and len(f.attribute) == 1 and f.attribute[0] in flags}
        self.flags = list(dict.fromkeys(is_true.values()))
        for f in filters:
            implied = isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.flags
            if id(f) not in is_true and not implied:
                yield f

    def partitions(self) -> list[Share]:
        store, folder = opened(self.folder)
        out = []
        for file in listed(store, folder):
            path, flags = f"{folder}/{file['name']}", file.get("flags")
            if "batches" not in file:
                with store.open_input_file(path) as f:
                    footer = pa.ipc.open_file(f)
                    file["batches"], flags = footer.num_record_batches, json.loads((footer.schema.metadata or {}).get(b"split_flags", b"null"))
            if any((flags or {}).get(name, True) is not True for name in self.flags):
                continue
            step = max(1, file["batches"] * self.share // max(1, file["bytes"]))
            out += [Share(path, k, min(k + step, file["batches"])) for k in range(0, file["batches"], step)]
        return out or [Share("", 0, 0)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = opened(self.folder)
        want = to_arrow_schema(self.schema)
        with store.open_input_file(partition.path) as f:
            there = pa.ipc.open_file(f).schema

            def only(names: list[str]) -> pa.ipc.RecordBatchFileReader:
                return pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[there.get_field_index(n) for n in names if n in there.names]))

            flags, rows = only(self.flags), only(want.names)
            for k in range(partition.first, partition.last):
                keep = None
                if self.flags:
                    seen = flags.get_batch(k)
                    for name in self.flags:
                        one = pc.fill_null(seen[name], False) if name in there.names else pa.array([False] * seen.num_rows)
                        keep = one if keep is None else pc.and_(keep, one)
                    if not pc.any(keep).as_py():
                        continue
                batch = rows.get_batch(k)
                columns = [batch[f.name].cast(f.type) if f.name in there.names else pa.nulls(batch.num_rows, f.type) for f in want]
                batch = pa.RecordBatch.from_arrays(columns, schema=want)
                yield batch if keep is None else batch.filter(keep)


class FileWriter(DataSourceArrowWriter):
    """A task keeps one file open for each combination of flags it meets, at most 27; a batch is in memory at a time."""

    def __init__(self, folder: str, schema: T.StructType, metadata: dict[str, str], overwrite: bool) -> None:
        self.folder, self.metadata, self.overwrite = folder, metadata, overwrite
        self.flags = [f.name for f in schema if f.name in FLAGS and f.dataType == T.BooleanType()]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.folder)
        store.create_dir(folder, recursive=True)
        task, sinks, files = uuid.uuid4().hex, {}, {}
        for batch in iterator:
            for flags, part in self.parted(batch):
                if flags not in sinks:
                    known = dict(zip(self.flags, flags, strict=True))
                    files[flags] = {"name": f"part-{task}-{len(files)}.arrow", "batches": 0, "rows": 0, "flags": known}
                    meta = self.metadata | ({"split_flags": json.dumps(known)} if known else {})
                    out = store.open_output_stream(f"{folder}/{files[flags]['name']}")
                    sinks[flags] = out, pa.ipc.new_file(out, part.schema.with_metadata(meta)), meta
                sinks[flags][1].write_batch(part.replace_schema_metadata(sinks[flags][2]))
                files[flags]["batches"] += 1
                files[flags]["rows"] += part.num_rows
        for flags, (out, writer, _) in sinks.items():
            writer.close()
            files[flags]["bytes"] = out.tell()
            out.close()
        return Written(list(files.values()))

    def parted(self, batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        if not batch.num_rows:
            return
        if not self.flags:
            yield (), batch
            return
        rows = pa.Table.from_batches([batch.select(self.flags)]).group_by(self.flags).aggregate([]).to_pylist()
        for row in rows:
            keep = None
            for name in self.flags:
                same = pc.is_null(batch[name]) if row[name] is None else pc.fill_null(pc.equal(batch[name], row[name]), False)
                keep = same if keep is None else pc.and_(keep, same)
            yield tuple(row[name] for name in self.flags), batch.filter(keep)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.folder)
        store.create_dir(folder, recursive=True)
        before = listed(store, folder)
        new = [f for m in messages if m for f in m.files]
        names = {f["name"] for f in new}
        kept = [] if self.overwrite else [f for f in before if f["name"] not in names and "batches" in f]
        with store.open_output_stream(f"{folder}/{LIST}.new") as out:
            out.write("".join(json.dumps(f) + "\n" for f in kept + new).encode())
        store.move(f"{folder}/{LIST}.new", f"{folder}/{LIST}")
        if self.overwrite:
            for f in before:
                if f["name"] not in names:
                    store.delete_file(f"{folder}/{f['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.folder)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{f['name']}")


class ArrowFiles(DataSource):
    """Format ``arrow_files``; options: path, share (bytes of a task), metadata (JSON of texts, for writing)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        store, folder = opened(self.options["path"])
        for file in listed(store, folder):
            with store.open_input_file(f"{folder}/{file['name']}") as f:
                return from_arrow_schema(pa.ipc.open_file(f).schema)
        raise ValueError(f"no Arrow files in {self.options['path']}: give a schema")

    def reader(self, schema: T.StructType) -> ShareReader:
        return ShareReader(self.options["path"], schema, int(self.options.get("share", SHARE)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema, json.loads(self.options.get("metadata", "{}")), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, which may then push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowFiles)


def read_arrow(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, share: int = SHARE) -> DataFrame:
    """Rows of a folder of Arrow files; with a schema, only its columns, those a file lacks null.

    A task reads a run of record batches, of about ``share`` bytes by the file's mean.
    """
    register(spark)
    reader = spark.read.format("arrow_files").option("share", share)
    return (reader if schema is None else reader.schema(schema)).load(qualified(spark, path))


def write_arrow(df: DataFrame, path: str, metadata: dict[str, str] | None = None, *, mode: str = "overwrite") -> int:
    """Files with the schema metadata, written by tasks; the number of files that were committed in all.

    Where ``df`` has boolean columns train, validation or test, a file holds rows of one
    combination, so that a reader of one split opens no others. A task without rows
    writes no file; an empty table leaves an empty list.
    """
    register(df.sparkSession)
    to = qualified(df.sparkSession, path)
    df.write.format("arrow_files").mode(mode).option("metadata", json.dumps(metadata or {})).save(to)
    return len(listed(*opened(to)))


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """flag, n_files, n_rows of the committed files: rows of each split, ``all`` included, without reading any."""
    files = listed(*opened(qualified(spark, path)))
    known = [f for f in files if "rows" in f]
    rows = [(name, sum(f["rows"] > 0 for f in some), sum(f["rows"] for f in some)) for name in ("all", *FLAGS) for some in [[f for f in known if name == "all" or f["flags"].get(name)]]]
    return spark.createDataFrame(rows, "flag string, n_files long, n_rows long")
