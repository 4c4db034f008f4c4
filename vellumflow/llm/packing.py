"""Packing of token ids into windows: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's pieces go to
the open window that they fill best; if none has room, the fullest is topped up
with the head of the piece (or left with a few ids of padding, when the cut
would make a scrap) and emitted. What stays open at the end of a partition is
merged in rounds, each task taking the leftovers of ``FAN_IN`` groups, so that
no task ever sees more than a bounded number of windows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.shared import new_path, text_batches
from vellumflow.llm.tokens import as_text, piece_cache

#: Groups of leftovers that one task of a merging round takes.
FAN_IN = 64
#: Pieces that are turned into one Arrow batch.
BATCH = 20_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STORED = f"{PIECE}, ids binary, group int, open boolean"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray  # uint32

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:at]), Piece(self.doc_id, self.start + at, self.doc_tokens, self.ids[at:])


@dataclass
class Window:
    used: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece.ids)


class Packer:
    """Best fit over at most ``keep`` open windows of ``size`` ids."""

    def __init__(self, size: int, keep: int, scrap: int):
        self.size, self.keep, self.scrap = size, max(1, keep), scrap
        self.open: list[tuple[int, int]] = []  # (free ids, number), ascending
        self.windows: dict[int, Window] = {}
        self.number = 0

    def put(self, piece: Piece) -> Iterator[Window]:
        while len(piece.ids) >= self.size:
            head, piece = piece.cut(self.size)
            full = Window()
            full.add(head)
            yield full
        while n := len(piece.ids):
            at = bisect_left(self.open, (n, -1))
            if at < len(self.open):
                free, k = self.open.pop(at)
                self.windows[k].add(piece)
                if free == n:
                    yield self.windows.pop(k)
                else:
                    insort(self.open, (free - n, k))
                return
            if len(self.open) < self.keep:
                self.windows[self.number] = w = Window()
                w.add(piece)
                insort(self.open, (self.size - n, self.number))
                self.number += 1
                return
            free, k = self.open.pop(0)
            w = self.windows.pop(k)
            if free >= self.scrap and n - free >= self.scrap:
                head, piece = piece.cut(free)
                w.add(head)
            yield w

    def rest(self) -> list[Window]:
        """The open windows, the fullest first; the packer is empty afterwards."""
        out = [self.windows[k] for _, k in self.open]
        self.open, self.windows = [], {}
        return out


def joined(windows: list[Window], size: int) -> Iterator[Window]:
    """The pieces of some windows laid end to end and cut every ``size`` ids."""
    w = Window()
    for piece in (p for x in windows for p in x.pieces):
        while len(piece.ids):
            head, piece = piece.cut(min(size - w.used, len(piece.ids)))
            w.add(head)
            if w.used == size:
                yield w
                w = Window()
    if w.used:
        yield w


class Out:
    """Rows of STORED as Arrow batches; a window's number tells its round and group."""

    def __init__(self, number: int, group: int, with_ids: bool):
        self.base, self.group, self.number, self.with_ids = number << 58 | group << 33, group, 0, with_ids
        self.rows: list[tuple] = []

    def add(self, w: Window, is_open: bool) -> None:
        at = 0
        for p in w.pieces:
            raw = p.ids.astype("<u4").tobytes()
            self.rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, self.base + self.number, at, raw if is_open or self.with_ids else None, self.group, is_open))
            at += len(p.ids)
        self.number += 1

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            kinds = [pa.int64()] * 7 + [pa.binary(), pa.int32(), pa.bool_()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "group", "open"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], names=names)
            self.rows = []


def first_round(path: str, end_id: int, size: int, keep: int, scrap: int, with_ids: bool, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = piece_cache(path, cache)
        packer, out = Packer(size, keep, scrap), Out(0, TaskContext.get().partitionId(), with_ids)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(tokens.encode(as_text(raw.as_py())), f"<u{tokens.width}")
                ids = np.append(ids, end_id).astype(np.uint32)
                for w in packer.put(Piece(doc_id, 0, len(ids), ids)):
                    out.add(w, False)
                yield from out.batches(BATCH)
        for w in packer.rest():
            out.add(w, True)
        yield from out.batches()

    return run


def merging_round(number: int, size: int, keep: int, scrap: int, last: bool, with_ids: bool):
    """Leftovers of FAN_IN groups, best fit again, the longest piece first; the last round joins what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        packer, out = Packer(size, keep, scrap), Out(number, rows[0]["target"], with_ids)
        pieces = [Piece(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in sorted(rows, key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))]
        for piece in pieces:
            for w in packer.put(piece):
                out.add(w, False)
        left = packer.rest()
        for w in joined(left, size) if last else left:
            out.add(w, not last)
        yield from out.batches()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 1, size: int = 2048, keep: int = 16, scrap: int = 16, with_ids: bool = False, cache: int = 600_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in windows of at most ``size`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with ``with_ids``, ids (little-endian unsigned 32-bit). Each id of each
    row of ``docs`` is in exactly one piece. A document over ``size`` ids is cut
    into full windows and a rest. No cut leaves fewer than ``scrap`` ids, save
    those that fill whole windows and those of the last merge. ``keep`` windows
    are open at a time in a partition.

    Nulls: a null text is an empty one (its end id only); a null id is kept. A
    repeated row is packed as often as it occurs. An empty table gives no row.
    Further columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    path = new_path(spark, "packed")
    with text_batches(spark):
        given.mapInArrow(first_round(tokenizer, end_id, size, keep, scrap, with_ids, cache), STORED).write.parquet(f"{path}/round=0")
    table = lambda n: spark.read.schema(STORED).parquet(f"{path}/round={n}")
    done, number = [table(0).filter(~F.col("open"))], 0
    while True:
        left = table(number).filter("open")
        groups = left.agg(F.max("group").alias("g")).first()["g"]
        if groups is None:
            break
        number, last = number + 1, groups < FAN_IN
        gathered = left.withColumn("target", F.expr(f"group div {FAN_IN}").cast("int"))
        gathered.groupBy("target").applyInArrow(whole_group(merging_round(number, size, keep, scrap, last, with_ids)), STORED).write.parquet(f"{path}/round={number}")
        done.append(table(number).filter(~F.col("open")))
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def whole_group(run):
    def one(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(iter(rows.to_batches()))))

    return one
