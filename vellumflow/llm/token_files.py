"""Token-id files: whole texts to ids, in ascending document order, and back.

Documents are range-partitioned and sorted by id; each partition becomes one
file of self-contained segments (see ``rans``), so that files and segments
follow the order of ids and any segment is decoded without the others. The
first id of a document is stored relative to its file; the files' own sums, one
short row each, give the rest when they are read. Files are Parquet, written and
read by Spark, since the folder may be in a store that only Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumflow.llm.rans import SCALE, Segment, encode_segment
from vellumflow.llm.shared import small, text_batches
from vellumflow.llm.tokens import as_text, piece_cache

#: Ids after which a segment is closed, at the end of a document.
SEGMENT = 4_000_000
STORED = "file int, segment int, n_ids long, body binary"
DECODED = "file int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def encoder(path: str, end_id: int, segment: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = piece_cache(path, cache)
        if (most := tokens.tokenizer.get_vocab_size()) > 1 << SCALE:
            raise ValueError(f"{most} ids; a frequency table holds {1 << SCALE}")
        end, file, number, at = tokens.packed([end_id]), TaskContext.get().partitionId(), 0, 0
        last, ids = None, b""
        docs: list[tuple[int | None, int, int]] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, parts, held, number
            held_ids = np.frombuffer(b"".join(parts), f"<u{tokens.width}")
            body = encode_segment([d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], held_ids)
            row = [pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([len(held_ids)], pa.int64()), pa.array([body], pa.binary())]
            docs, parts, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(row, names=["file", "segment", "n_ids", "body"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (text := as_text(raw.as_py())) != last:
                    last, ids = text, tokens.encode(text)
                n = len(ids) // tokens.width + 1
                docs.append((doc_id, at, n))
                parts += ids, end
                at, held = at + n, held + n
                if held >= segment:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, segment: int = SEGMENT, cache: int = 600_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents to ``folder``, which must not exist yet.

    Order: ascending id, null ids first, ties by the text's hash and the text. A null
    text is an empty one, of its end id only. Repeated rows are written as often as
    they occur. Further columns are ignored. An empty table gives files without
    segments. A vocabulary of more than 2^20 ids, the sum of a table's frequencies,
    raises.

    Ranges are of id and text hash, so rows that share an id, or have none, go to
    many files; only rows equal in both go to one, which encodes their text once.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    hashed = given.withColumn("hash", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    with text_batches(docs.sparkSession):
        ordered.mapInArrow(encoder(tokenizer, end_id, segment, cache), STORED).write.parquet(folder)


def decoded(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(body.as_py())
                raw, d = s.ids().astype("<u4").tobytes(), s.docs
                n = d["n"].astype(np.int64)
                ends = np.cumsum(n) * 4
                view = memoryview(raw)
                each = [view[e - k : e] for e, k in zip(ends.tolist(), (n * 4).tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(n), file, np.int32)),
                    pa.array(d["doc_id"].astype(np.int64), mask=d["known"] == 0),
                    pa.array(d["start"].astype(np.int64)),
                    pa.array(n),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ]
                names = ["file", "doc_id", "local_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tobytes() for x in each], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    ``with_ids`` adds ids, little-endian unsigned 32-bit. A damaged segment
    raises, since heads and blocks carry checksums.
    """
    files = spark.read.schema(STORED).parquet(folder)
    sums = files.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = files.select("file", "body").mapInArrow(decoded(with_ids), DECODED + (", ids binary" if with_ids else ""))
    joined = docs.join(small(bases, 16), "file")
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
