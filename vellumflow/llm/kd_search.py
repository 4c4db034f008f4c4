"""Exact top-k inner products by a k-d tree per shard.

Points are dealt into shards by median cuts of a bounded sample, so that a shard is
a cell of space; a cell of too many points, such as one vector's many copies, is
dealt into several by the id's hash. Each shard builds a tree: median splits of the
widest side, with tight bounding boxes. A query's largest possible inner product
with a box bounds what the box holds. Nodes are visited best first: of all nodes
that a query has met but not opened, the one with the largest bound is next, until
that is under the query's k-th score; so a subtree that can't matter is never opened.

Every query searches its own shard first. Its k-th score goes with it and drops the
shards whose boxes can't reach it, before anything is sent, and prunes in those that
are left. There a task builds a shard's tree once and then takes its queries a batch
at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.shared import small, written

FOUND = "query_id long, vec_id long, score long"
NONE = -np.iinfo(np.int64).max
_TOGETHER = 4096  # queries that are searched side by side
_SPLIT = 512  # queries whose candidates are merged at once
_SALT = 1 << 20  # most shards of a cell


@dataclass
class Tree:
    points: np.ndarray  # in the order of leaves
    ids: np.ndarray
    low: np.ndarray  # boxes of all nodes
    high: np.ndarray
    child: np.ndarray  # left child; the right one follows it; 0 for a leaf
    span: np.ndarray  # first and last row (exclusive) of each node

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int) -> Tree:
        order, low, high, child, span = np.arange(len(points)), [], [], [], []

        def node(a: int, b: int) -> None:
            part = points[order[a:b]]
            low.append(part.min(0)), high.append(part.max(0)), child.append(0), span.append((a, b))

        node(0, len(points))
        k = 0
        while k < len(span):
            a, b = span[k]
            if b - a > leaf:
                mid = (a + b) // 2
                side = int(np.argmax(high[k] - low[k])) if points.shape[1] else 0
                if points.shape[1]:
                    order[a:b] = order[a:b][np.argpartition(points[order[a:b], side], mid - a)]
                child[k] = len(span)
                node(a, mid), node(mid, b)
            k += 1
        return cls(points[order], ids[order], np.array(low), np.array(high), np.array(child), np.array(span))


def exact_kind(*arrays: np.ndarray) -> type:
    """The fastest number type in which inner products of whole numbers are exact."""
    most = [max(1.0, float(np.abs(a.astype(np.float64)).max(initial=0))) for a in arrays]
    bound = most[0] * most[-1] * max(1, arrays[0].shape[1])
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: larger scores, then smaller ids."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids [queries, k] of the best points that score ``bound`` or more; NONE fills the rest.

    own: the id that each query leaves out. bound: the least score of use, NONE for any.
    """
    kind = exact_kind(queries, tree.points)
    points, low, high = (a.astype(kind) for a in (tree.points, tree.low, tree.high))
    parts = [best_first(tree, points, low, high, queries[i : i + _TOGETHER].astype(kind), own[i : i + _TOGETHER], bound[i : i + _TOGETHER], k)[:2] for i in range(0, len(queries), _TOGETHER)]
    if not parts:
        return np.zeros((0, k), np.int64), np.zeros((0, k), np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def best_first(tree: Tree, points: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores, ids, and the number of nodes opened, of some queries side by side.

    ``waiting`` holds each query's bound of every node that it has met and not opened.
    """
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    best, best_id = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    kth = np.maximum(bound.astype(np.int64), NONE + 1)
    waiting = np.full((len(q), len(tree.child)), NONE)
    waiting[:, 0] = up @ high[0] + down @ low[0]
    active, opened = np.arange(len(q)), 0
    while len(active):
        node = waiting[active].argmax(1)
        can = waiting[active, node] >= kth[active]
        active, node = active[can], node[can]
        waiting[active, node] = NONE
        opened += len(active)
        left = tree.child[node]
        inner = left > 0
        rows, left = active[inner], left[inner]
        for child in (left, left + 1):
            waiting[rows, child] = (np.einsum("ij,ij->i", up[rows], high[child]) + np.einsum("ij,ij->i", down[rows], low[child])).astype(np.int64)
        rows, leaf = active[~inner], node[~inner]
        order = np.argsort(leaf, kind="stable")
        rows, leaf = rows[order], leaf[order]
        edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)] if len(leaf) else [0]
        for e, f in zip(edges, edges[1:], strict=False):
            some, (a, b) = rows[e:f], tree.span[leaf[e]]
            for part in [some[i : i + _SPLIT] for i in range(0, len(some), _SPLIT)]:
                score = (q[part] @ points[a:b].T).astype(np.int64)
                score[own[part][:, None] == tree.ids[None, a:b]] = NONE
                useful = (score >= kth[part][:, None]).any(1)
                part, score = part[useful], score[useful]
                if len(part):
                    ids = np.broadcast_to(tree.ids[a:b], score.shape)
                    best[part], best_id[part] = merge(np.hstack([best[part], score]), np.hstack([best_id[part], ids]), k)
                    kth[part] = np.maximum(kth[part], best[part, -1])
    best[best < bound[:, None]] = NONE
    return best, best_id, opened


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    lengths = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width), np.int64)
    values = flat.flatten().to_numpy()
    row = np.repeat(np.arange(len(flat)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class Cells:
    """Median cuts of a sample, as many cells as asked for or fewer; a point on a cut goes left."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.side, self.cut, self.child, self.cell = [], [], [], []
        self.cells = 0
        waiting = [(sample, max(1, cells))]
        while waiting:  # breadth first, so that a node's children are numbered in turn
            following = []
            for points, want in waiting:
                side = int(np.argmax(points.max(0) - points.min(0))) if len(points) and points.shape[1] else 0
                cut = np.sort(points[:, side])[(len(points) - 1) // 2] if len(points) and points.shape[1] else 0
                left = points[:, side] <= cut if points.shape[1] else np.ones(len(points), bool)
                splits = want > 1 and not left.all()
                self.side.append(side), self.cut.append(int(cut))
                self.child.append(-1 if not splits else len(self.child))  # set below
                self.cell.append(-1 if splits else self.cells)
                self.cells += not splits
                if splits:
                    following += [(points[left], want // 2), (points[~left], want - want // 2)]
            waiting = following
        at = 1
        for n, c in enumerate(self.child):
            if c >= 0:
                self.child[n], at = at, at + 2
        self.side, self.cut, self.child, self.cell = (np.array(a, np.int64) for a in (self.side, self.cut, self.child, self.cell))

    def of(self, points: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(rows := rows[self.child[at[rows]] >= 0]):
            n = at[rows]
            at[rows] = self.child[n] + (points[rows, self.side[n]] > self.cut[n])
        return self.cell[at]


def points_of(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    return matrix(table["q"], width), table["vec_id"].to_numpy()


def rows_of(query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.Table:
    got = scores != NONE
    which = np.broadcast_to(query_ids[:, None], scores.shape)
    return pa.table({"query_id": which[got], "vec_id": ids[got], "score": scores[got]}, schema=pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")]))


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def sharded_points(points: DataFrame, n: int, width: int, shards: int, shard_rows: int) -> DataFrame:
    """vec_id, q, shard of a written table vec_id, q: cells of a sample of 64 points a shard, large ones dealt by id, written."""
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(64 * shards).toArrow()
    cells = Cells(matrix(sample["q"], width), shards)

    def cell(q: pa.Array) -> pa.Array:
        return pa.array(cells.of(matrix(pa.chunked_array([q]), width)))

    celled = written(points.withColumn("cell", F.arrow_udf(cell, "long")("q")), "cells")
    salts = celled.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).alias("salts"))
    dealt = celled.join(small(written(salts, "salts"), 16), "cell")
    return written(dealt.select("vec_id", "q", (F.col("cell") * _SALT + F.pmod(F.xxhash64("vec_id"), F.least("salts", F.lit(_SALT)))).alias("shard")), "shards")


def own_shard(width: int, every: int, k: int, leaf: int):
    """The shard's box (shard, low, high), and what its queries find in it (FOUND)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p, ids = points_of(table, width)
        tree, mine = Tree.build(p, ids, leaf), ids % every == 0
        found = rows_of(ids[mine], *search(tree, p[mine], ids[mine], np.full(mine.sum(), NONE), k))
        box = {"shard": pa.array([key[0].as_py()], pa.int64()), "low": pa.array([tree.low[0].tolist()], pa.list_(pa.int64())), "high": pa.array([tree.high[0].tolist()], pa.list_(pa.int64()))}
        return pa.concat_tables([found, pa.table(box)], promote_options="default")

    return run


def reached(shards: np.ndarray, low: np.ndarray, high: np.ndarray, width: int):
    """Beside each query the shards other than its own whose boxes can reach its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at in range(0, len(table), _TOGETHER):
                part = table.slice(at, _TOGETHER)
                q = matrix(part["q"], width)
                kind = exact_kind(q, np.concatenate([low, high]))
                most = (np.maximum(q, 0).astype(kind) @ high.T.astype(kind) + np.minimum(q, 0).astype(kind) @ low.T.astype(kind)).astype(np.int64)
                can = (most >= part["bound"].fill_null(NONE).to_numpy()[:, None]) & (part["shard"].to_numpy()[:, None] != shards)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(can.sum(1))]).astype(np.int32)), pa.array(shards[np.nonzero(can)[1]]))
                yield pa.RecordBatch.from_arrays([part["vec_id"].combine_chunks(), part["q"].combine_chunks(), part["bound"].combine_chunks(), lists], names=["vec_id", "q", "bound", "shards"])

    return run


def other_shards(width: int, k: int, leaf: int):
    """What queries find in shards that aren't theirs; the input is sorted by shard, points (query false) before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, at = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard, is_query = table["shard"].to_numpy(), table["query"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (is_query[1:] != is_query[:-1])]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(table)], strict=True):
                part = table.slice(a, b - a)
                if shard[a] != at:
                    tree, held, at = None, [], shard[a]
                if not is_query[a]:
                    held.append(part)
                    continue
                if tree is None:
                    tree, held = Tree.build(*points_of(pa.concat_tables(held), width), leaf), []
                q, ids = points_of(part, width)
                yield from rows_of(ids, *search(tree, q, ids, part["bound"].fill_null(NONE).to_numpy(), k)).to_batches()

    return run


def asked_shards(sharded: DataFrame, at_home: DataFrame, width: int, every: int, k: int) -> DataFrame:
    """vec_id, q, bound, shard: a row for each query and each other shard that it must search.

    The boxes that go to the tasks are one for each shard, whose number is bounded.
    """
    boxes = at_home.filter("shard is not null").select("shard", "low", "high").toArrow()
    bounds = at_home.filter("shard is null").groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    queries = sharded.filter(F.col("vec_id") % every == 0).join(bounds, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "q", "bound", "shard")
    pruned = queries.mapInArrow(reached(boxes["shard"].to_numpy(), matrix(boxes["low"], width), matrix(boxes["high"], width), width), "vec_id long, q array<long>, bound long, shards array<long>")
    return pruned.select("vec_id", "q", "bound", F.explode("shards").alias("shard"))


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64, shard_rows: int = 16_384, least_shards: int = 32, most_shards: int = 8192, leaf: int = 128, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products.

    Queries are the rows whose id is divisible by ``every``; candidates all rows
    but the query's own; ties go to smaller ids. Components are floor(scale * x).
    Rows with a null id, a null vector, or null or non-finite components take no
    part. A repeated id counts once, with its smallest vector. Vectors of unequal
    length are filled with zeros; scores beyond a long wrap. A query without
    candidates and an empty table give no rows; further columns are ignored.

    A shard has about ``shard_rows`` points, more where that would make more than
    ``most_shards``; so the sample (64 points a shard) and the boxes, which the
    driver sees, are bounded.
    """
    vector = F.col(vector_col)
    given = vectors.filter(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector, scale).alias("q"))
    points = written(given.groupBy("vec_id").agg(F.min("q").alias("q")), "points")
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    shard_rows = max(shard_rows, -(-n // most_shards))
    leaf = max(leaf, shard_rows // 128)
    sharded = sharded_points(points, n, width, max(1, -(-n // shard_rows), min(least_shards, n // (4 * leaf))), shard_rows)
    at_home = written(sharded.groupBy("shard").applyInArrow(own_shard(width, every, k, leaf), f"{FOUND}, shard long, low array<long>, high array<long>"), "own-shard")
    asked = asked_shards(sharded, at_home, width, every, k)
    held = sharded.select("shard", F.lit(False).alias("query"), "vec_id", "q", F.lit(None).cast("long").alias("bound"))
    both = held.unionByName(asked.select("shard", F.lit(True).alias("query"), "vec_id", "q", "bound"))
    elsewhere = both.repartition("shard").sortWithinPartitions("shard", "query").mapInArrow(other_shards(width, k, leaf), FOUND)
    found = at_home.filter("shard is null").select("query_id", "vec_id", "score").unionByName(elsewhere)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
