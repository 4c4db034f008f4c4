"""All links of texts whose word n-grams have a Jaccard coefficient of 0.8 or more.

The incidence of texts (rows) and n-grams (columns) is a sparse matrix, and its
product with itself holds the overlap of every pair. It is computed in blocks: the
leading columns of all rows first, dealt by column, so that Spark's partitions
multiply theirs apart; then, for each pair that is left, the count over its whole
rows. Bounds from the sizes discard pairs in between, and none of them loses a link:

- Two sets of n and m n-grams with coefficient 0.8 share 4 (n + m) / 9 of them.
- With the columns in one order, such sets share one of the first
  n - ceil(0.8 n) + 1 of each, and where the first shared one stands bounds what can
  follow it.
- They differ in at most (n + m) / 9 n-grams. Of each set the parities of its n-grams
  on 512 places are kept, and where these differ the sets do. For the pairs that
  this leaves, parities on a place or two for each n-gram say more before whole rows meet.

The order puts columns first that a sample of the texts shows to be rare; it decides
how many pairs are looked at, never which are linked.

Texts of one set are one row. To keep groups of near copies from costing their
square, every row is multiplied with the lead of each of its columns first; after that only pairs in different components are looked at, in columns that still
have several beside their leads, whose pairs are decided: whoever is outside a column's largest component, with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.components import component_of_nodes, components
from vellumflow.llm.shared import Scratch, kept, small, text_batches, written

WIDTH = 5  # words of an n-gram
_SAMPLE = 1 / 16  # share of the texts whose n-grams are counted for their order
_OFTEN = 3  # texts of the sample that make an n-gram a frequent one
_KNOWN = 1 << 20  # most frequent n-grams that the order tells apart
_PLACES = 9  # logarithm of the bits of a set's parities
PARITY = [f"b{k}" for k in range((1 << _PLACES) // 64)]
_WORDS = 1 << 18  # words whose hashes a worker keeps
_FACTORS = [np.uint64(xxhash.xxh64_intdigest(bytes([k]), 42) | 1) for k in range(WIDTH + 1)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


def ngrams(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the n-grams, A-Z lower-cased, sorted; a text of fewer words is one n-gram."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(kept(("word hashes",), WordHashes).__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(each))
    n = len(each) - width + 1
    out = np.full(n, width, np.uint64) * _FACTORS[WIDTH]
    for k in range(width):
        out += each[k : k + n] * _FACTORS[k]
    out ^= out >> np.uint64(29)
    out *= _FACTORS[0]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def node(found: np.ndarray) -> int:
    """A number for a set; equal sets have equal numbers."""
    return xxhash.xxh64_intdigest(found.tobytes(), 42)


def simhash(found: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the distinct n-grams."""
    counts = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0])


def parities(found: np.ndarray) -> np.ndarray:
    """PARITY words of bits: a bit is 1 if an odd number of n-grams falls on it."""
    counts = np.bincount((found >> np.uint64(64 - _PLACES)).astype(np.int64), minlength=1 << _PLACES)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8").astype(np.uint64)


def wide_parities(found: np.ndarray) -> bytes:
    """Parities on as many places as the least power of two that is 64 or more and no less than the n-grams."""
    places = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    counts = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Places where the wide parities of two sets differ, at most the n-grams that only one of them has."""
    few, many = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
    while len(many) > len(few):  # half the places: those that are alike but for their highest bit fall together
        many = many[: len(many) // 2] ^ many[len(many) // 2 :]
    return int(np.bitwise_count(few ^ many).sum())


def frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that several texts of a sample have, the most frequent ones, sorted, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found = [ngrams(t.as_py() or b"") for t in batch.column(0)[k : k + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    texts = docs.select(F.col(text_col).cast("binary").alias("text")).sample(_SAMPLE, 1)
    counted = texts.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= _OFTEN)
    with text_batches(docs.sparkSession):
        found = counted.orderBy(F.desc("n"), "key").limit(_KNOWN).toArrow()
    known, counts = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


def leading(found: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first columns of a set, of which every similar set has at least one among its own, rare ones first."""
    n = len(found)
    if not n:
        return found
    weight = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        weight = np.where(known[at] == found, counts[at], 0)
    return found[np.argsort(weight, kind="stable")[: n - (4 * n + 4) // 5 + 1]]


def lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(v) for v in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def measured_column(text: Column, known: np.ndarray, counts: np.ndarray) -> Column:
    """Array of node, number of n-grams, fingerprint, parities and leading columns of a text column; null counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found = ngrams(t.as_py() or b"")
            out.append(np.concatenate([np.array([node(found), len(found), simhash(found)], np.uint64), parities(found), leading(found, known, counts)]).view(np.int64))
        return lists(out)

    return F.arrow_udf(run, "array<long>")(text.cast("binary"))


WHOLE = "node long, n int, wide binary, keys array<long>"


def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WHOLE of a node and its text."""
    for batch in batches:
        found = [ngrams(t.as_py() or b"") for t in batch.column("text")]
        columns = [pa.array([len(f) for f in found], pa.int32()), pa.array([wide_parities(f) for f in found], pa.binary()), lists([f.view(np.int64) for f in found])]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], names=["node", "n", "wide", "keys"])


def least_apart_column(x: Column, y: Column) -> Column:
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([least_apart(a.as_py(), b.as_py()) for a, b in zip(left, right, strict=True)], pa.int32())

    return F.arrow_udf(run, "int")(x, y)


def with_row_hash(docs: DataFrame, row: str, *columns: Column) -> DataFrame:
    """``docs`` with 128 bits that tell rows apart."""
    return docs.withColumn(row, F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(7), *columns).alias("k")))


def measured(rows: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, node, n, print, PARITY, prefix (the leading columns) for every row, a written table."""
    made = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row).alias("row"), measured_column(F.col(text_col), *frequent(rows, text_col)).alias("_m"))
    parts = [F.get("_m", F.lit(k)).alias(c) for k, c in enumerate(("node", "n", "print", *PARITY))]
    with text_batches(rows.sparkSession):
        return written(made.select("doc_id", "row", *parts, F.slice("_m", F.lit(len(parts) + 1), F.size("_m")).alias("prefix")), "sets")


def incidence(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """key, node, n, place: the leading columns that several nodes have, each node once, a written table.

    Columns are many, so they meet their rows by shuffles, which Spark can split, at every size: broadcast,
    each executor would hold them all, and long after their join.
    """
    copies = scratch.written(sets.groupBy("node").agg(F.min("row").alias("first_row"), F.count("*").alias("c")).filter("c > 1").drop("c"), "copies")
    marked = sets.select("row", "node", "n", "prefix").join(small(copies, 48), "node", "left")
    firsts = marked.filter(F.col("row") == F.col("first_row")).dropDuplicates(["node"])  # rows that are alike in all
    once = marked.filter(F.col("first_row").isNull()).unionByName(firsts)
    places = once.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "key"))
    columns = scratch.written(places.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "columns")
    return scratch.written(places.join(columns, "key", "left_semi").select("key", "node", "n", "place"), "incidence")


def column_leads(met: DataFrame, scratch: Scratch) -> DataFrame:
    """key, nodes, place, node, n, a written table: of each column its nodes and the one with the fewest n-grams before it, so most in common with its group."""
    return scratch.written(met.groupBy("key").agg(F.count("*").alias("nodes"), F.min(F.struct("place", "node", "n")).alias("y")).select("key", "nodes", "y.*"), "leads")


def enough(overlap: Column, total: Column) -> Column:
    return 9 * overlap >= 4 * total


def rest_enough(x: str, y: str) -> Column:
    """Bound of two rows at a column, if it is the first they share: they share at most what follows there in the smaller rest."""
    rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
    return enough(rest, F.col(f"{x}.n") + F.col(f"{y}.n"))


def parities_near(x: str, y: str) -> Column:
    """Bound of two rows: each bit in which their parities differ is an n-gram that only one of them has."""
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in PARITY])
    return 9 * apart <= F.col(f"{x}.n") + F.col(f"{y}.n")


def pair_of(x: str, y: str) -> list[Column]:
    return [F.greatest(f"{x}.node", f"{y}.node").alias("a"), F.least(f"{x}.node", f"{y}.node").alias("b")]


def star_pairs(met: DataFrame, leads: DataFrame, parities: DataFrame, scratch: Scratch) -> DataFrame:
    """a > b: nodes and the lead of each of their columns, if they may link; parities: node, n, PARITY."""
    x, y = met.alias("x"), leads.alias("y")
    product = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & rest_enough("x", "y"))
    pairs = scratch.written(product.select(*pair_of("x", "y")).distinct(), "met-pairs")
    x, y = parities.alias("x"), parities.alias("y")
    near = pairs.join(y, F.col("b") == F.col("y.node")).join(x, F.col("a") == F.col("x.node")).filter(parities_near("x", "y"))
    return scratch.written(near.select("a", "b"), "pairs")


def cross_pairs(met: DataFrame, leads: DataFrame, parities: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """a > b: nodes of different components that meet in a column, if they may link and neither leads it: pairs with the lead are decided."""
    crowded = leads.filter("nodes > 2").select("key", F.col("node").alias("lead"))
    others = scratch.written(met.join(crowded, "key").filter("node <> lead").drop("lead"), "others")
    placed = scratch.written(others.join(small(roots, 32), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("roots"))
    mains = scratch.written(parts.filter("roots > 1").select("key", F.col("most.root").alias("main")), "mains")
    mixed = scratch.written(placed.join(mains, "key").join(parities.drop("n"), "node"), "mixed")
    x, y = mixed.filter("root <> main").alias("x"), mixed.alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") > F.col("y.node"))  # outside the largest, a pair is met from both ends
    product = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & once & rest_enough("x", "y") & parities_near("x", "y"))
    return scratch.written(product.select(*pair_of("x", "y")).distinct(), "pairs")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def links_of(pairs: DataFrame, rows: DataFrame, sets: DataFrame, row: str, text_col: str) -> DataFrame:
    """The pairs a, b, a written table, whose whole rows overlap enough, written.

    rows: texts and a hash ``row`` of each; sets: row, node. Whole rows are computed
    anew for the nodes needed; of the pairs that their wide parities leave, one's row
    is fetched to the other.
    """
    with Scratch(pairs.sparkSession) as scratch:
        needed = scratch.written(nodes_of(pairs), "needed")
        first = scratch.written(sets.join(small(needed, 24), "node", "left_semi").groupBy("node").agg(F.min("row").alias("first_row")), "rows")
        texts = rows.join(small(first, 48), F.col(row) == F.col("first_row")).select("node", F.col(text_col).cast("binary").alias("text"))
        with text_batches(pairs.sparkSession):
            whole = scratch.written(texts.mapInArrow(whole_rows, WHOLE), "whole-rows")
        if whole.count() > first.count():  # rows that are alike in all
            whole = scratch.written(whole.dropDuplicates(["node"]), "whole-rows")
        a, b = (whole.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("wide").alias(f"{k}_wide")) for k in "ab")
        near = pairs.join(b, "b").join(a, "a").filter(9 * least_apart_column(F.col("a_wide"), F.col("b_wide")) <= F.col("a_n") + F.col("b_n"))
        near = scratch.written(near.select("a", "b"), "near-pairs")
        left = scratch.written(nodes_of(near), "left")
        kept = whole.select("node", "keys").join(small(left, 24), "node", "left_semi")
        x, y = (kept.select(F.col("node").alias(n), F.col("keys").alias(k)) for n, k in (("a", "x"), ("b", "y")))
        overlap = F.size(F.array_intersect("x", "y"))
        return written(near.join(y, "b").join(x, "a").filter(enough(overlap, F.size("x") + F.size("y"))).select("a", "b"), "links")


def linked_nodes(rows: DataFrame, sets: DataFrame, row: str, text_col: str, candidates: DataFrame | None = None) -> DataFrame:
    """node, root of the nodes that are linked to others, a written table.

    rows: texts and a hash ``row`` of each; sets: see :func:`measured`; candidates:
    pairs a, b of nodes to look at first, if any are known.
    """
    with Scratch(rows.sparkSession) as scratch:
        links = None
        if candidates is not None:
            links = links_of(scratch.written(candidates, "pairs"), rows, sets, row, text_col)
        met = incidence(sets, scratch)
        leads = column_leads(met, scratch)
        parities = scratch.written(sets.select("node", F.col("n").cast("int").alias("n"), *PARITY).dropDuplicates(["node"]), "parities")
        found = links_of(star_pairs(met, leads, parities, scratch), rows, sets, row, text_col)
        links = found if links is None else links.unionByName(found)
        roots = scratch.written(components(links), "roots")
        found = links_of(cross_pairs(met, leads, parities, roots, scratch), rows, sets, row, text_col)
        if found.isEmpty():
            return written(roots, "roots")
        return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)), "roots")


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Texts link when their sets of five-word shingles have a coefficient of 0.8 or
    more; component_id is the smallest doc_id reachable by links, itself included.
    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of
    fewer than five words is one shingle. A text without words, a null one too, has
    no shingles and is linked with nothing. Null ids are kept and name a component
    only where it has no other id. Repeated rows are kept; further columns are left
    out; an empty table gives none. Texts are taken whole, whatever their length.
    Sets are told apart by 64-bit hashes.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_row_hash(texts, "row_hash", F.col("doc_id"), F.col("text"))
    sets = measured(rows, "row_hash", "doc_id", "text")
    rooted = linked_nodes(rows, sets, "row_hash", "text")
    first = written(sets.groupBy("node").agg(F.min("doc_id").alias("first_id")), "distinct-nodes")
    named = component_of_nodes(first, rooted)
    out = sets.select("doc_id", "node", F.col("n").alias("n_shingles")).join(small(named, 48), "node")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
