"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into six parts, and six unions of three parts, 31 to
33 bits each, are looked at apart. On each union the anchors are a covering code of
radius 1: a perfect Hamming code of length 31 beside the remaining bits as they are.
A fingerprint has a home anchor within distance 1, and is replicated to all anchors
within 1 + 1; so two fingerprints with at most one differing bit in the union meet
at the home of either, and are linked if they differ in at most four bits in all.
Any four bits leave some union at most one of them (the tests try every spread), so
no pair is missed. An anchor that is nobody's home yields nothing, so copies go only to
anchors whose bit is among those that the homes mark. Equal fingerprints are one before that, and an anchor yields
links that connect what its pairs connect, never all pairs.

An anchor of very many fingerprints is linked in runs of bounded length; what then
still lies outside its largest component is compared with all of it in a join,
whose hot keys Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.components import component_of_nodes, components
from vellumflow.llm.ngram_join import linked_nodes, measured, with_row_hash
from vellumflow.llm.shared import column_name, small, text_batches, written

_SHINGLES = 1 << 14  # shingles whose bits are held side by side
_CHUNK = 1 << 18  # pairs that are held side by side
_ALL_PAIRS = 1 << 9  # pairs of an anchor up to which all are compared side by side
_RUN = 1 << 18  # fingerprints of an anchor that a task links at once
_MARKS, _PART = 27, 15  # logarithms of the most bits that homes mark, and of those that a task gathers at once
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

# First bit and bits of each part, and the parts of each union; length of the Hamming code, and the most bits of a link.
PARTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
UNIONS = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
CODE, MOST, WIDTH = 31, 4, 4


def bits_of(union: int) -> int:
    return sum(PARTS[p][1] for p in UNIONS[union])


def fingerprint(text: bytes) -> int:
    """SimHash of the text's four-word shingles, A-Z lower-cased, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - WIDTH + 1)
    last = ends[WIDTH - 1 :] if len(words) >= WIDTH else ends[-1:]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _SHINGLES):
        spans = zip(starts[k : min(n, k + _SHINGLES)], last[k : k + _SHINGLES], strict=True)
        h = np.array([digest(flat[s:e], 42) for s, e in spans], "<u8").view(np.uint8)
        counts += np.unpackbits(h.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    """Fingerprint of a text column as a signed long; null counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64))

    return F.arrow_udf(run, "long")(text.cast("binary"))


def _syndromes() -> np.ndarray:
    """Per byte place and byte, the XOR of the places (from 1) of its bits in the code."""
    out = np.zeros((4, 256), np.uint64)
    for place in range(4):
        for byte in range(256):
            for bit in range(8):
                if byte >> bit & 1 and place * 8 + bit < CODE:
                    out[place, byte] ^= np.uint64(place * 8 + bit + 1)
    return out


def _pairs() -> np.ndarray:
    """Per syndrome (a row each), the pairs of places whose flips lead to a code word."""
    places = range(1, CODE + 1)
    return np.array([[1 << (a - 1) | 1 << (b - 1) for a, b in combinations(places, 2) if a ^ b == s] if s else [0] * (CODE // 2) for s in range(CODE + 1)], np.uint64)


SYNDROMES, PAIRS = _syndromes(), _pairs()


def projected(prints: np.ndarray, union: int) -> np.ndarray:
    out, at = np.zeros(len(prints), np.uint64), 0
    for first, bits in (PARTS[p] for p in UNIONS[union]):
        out |= (prints >> np.uint64(first) & np.uint64((1 << bits) - 1)) << np.uint64(at)
        at += bits
    return out


def anchors(prints: np.ndarray, union: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, anchors, home): the anchors within 2 of each fingerprint on the union, each once, the home first."""
    x, bits = projected(prints, union), bits_of(union)
    rows = np.arange(len(x))
    syndrome = np.zeros(len(x), np.uint64)
    for place in range(4):
        syndrome ^= SYNDROMES[place][(x >> np.uint64(8 * place) & np.uint64(0xFF)).astype(np.int64)]
    off = syndrome > 0
    home = np.where(off, x ^ (np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1))), x)
    yield rows, home, True
    extra = range(CODE, bits)
    for b in extra:
        yield rows, home ^ np.uint64(1 << b), False
    on = rows[~off]
    for a, b in combinations(extra, 2):
        yield on, home[on] ^ np.uint64(1 << a | 1 << b), False
    far = rows[off]
    for k in range(PAIRS.shape[1]):
        yield far, x[far] ^ PAIRS[syndrome[far].astype(np.int64), k], False


def place_of(union: int, anchor: np.ndarray, home: bool) -> np.ndarray:
    """Union, anchor and, last bit, 0 for home."""
    return np.uint64(union) << np.uint64(40) | anchor << np.uint64(1) | np.uint64(not home)


def mark_of(place: np.ndarray, bits: int) -> np.ndarray:
    """The bit, of 2^bits, that stands for the anchor of a place."""
    return ((place >> np.uint64(1)) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


def home_marks(prints: DataFrame, bits: int) -> np.ndarray:
    """The bits of all homes, 2^bits of them in bytes: at most 16 MB, whatever the number of fingerprints."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for union in range(len(UNIONS)):
                _, home, _ = next(anchors(batch.column(0).to_numpy().view(np.uint64), union))
                at = np.unique(mark_of(place_of(union, home, True), bits))
                yield pa.RecordBatch.from_arrays([pa.array((at >> _PART).astype(np.int32)), pa.array((at & (1 << _PART) - 1).astype(np.int32))], names=["part", "at"])

    def gathered(rows: pa.Table) -> pa.Table:
        marked = np.zeros(1 << _PART, np.uint8)
        marked[rows.column("at").to_numpy()] = 1
        return pa.table({"part": rows.column("part")[:1], "bits": [np.packbits(marked, bitorder="little").tobytes()]})

    found = prints.select("print").mapInArrow(marks, "part int, at int").groupBy("part").applyInArrow(gathered, "part int, bits binary").toArrow()
    out = np.zeros((1 << bits - _PART, 1 << _PART - 3), np.uint8)
    for part, marked in zip(found.column("part").to_pylist(), found.column("bits"), strict=True):
        out[part] = np.frombuffer(marked.as_py(), np.uint8)
    return out.ravel()


def replicated(prints: DataFrame) -> DataFrame:
    """place, print: each fingerprint at its home of each union, and at its other anchors that may be homes."""
    bits = min(_MARKS, max(_PART, (16 * len(UNIONS) * prints.count()).bit_length()))
    shared = prints.sparkSession.sparkContext.broadcast(home_marks(prints, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for union in range(len(UNIONS)):
                for rows, anchor, home in anchors(x, union):
                    place = place_of(union, anchor, home)
                    if not home:
                        at = mark_of(place, bits)
                        met = (marked[at >> 3] >> (at & 7) & 1).astype(bool)
                        rows, place = rows[met], place[met]
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(x[rows].view(np.int64))], names=["place", "print"])

    return prints.select("print").mapInArrow(run, "place long, print long")


def forest(homes: int, members: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Places of links that connect what the pairs of one of the first ``homes`` members and any other connect.

    members: distinct fingerprints. A home of the largest component so
    far is compared with what lies outside it only, so a dense group of copies
    costs about its size, not its square.
    """
    a, b, label = [], [], np.arange(len(members))
    everything = outside = np.arange(len(members))
    main = -1
    for at in range(homes):
        look = outside if label[at] == main else everything
        near = look[np.bitwise_count(members[look] ^ members[at]) <= most]
        parts, first = np.unique(label[near], return_index=True)
        new = parts != label[at]
        if new.any():
            a += [at] * int(new.sum())
            b += near[first[new]].tolist()
            label[np.isin(label, parts)] = label[at]
            main = int(np.bincount(label).argmax())
            outside = np.flatnonzero(label != main)
    return a, b


def linked(place: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a > b of the fingerprints of whole anchors; sorted by place, so homes come first."""
    key = place >> 1
    edge = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    size = np.diff(edge, append=len(key))
    home = np.add.reduceat((place & 1 == 0).astype(np.int64), edge) if len(edge) else edge
    keep = (home > 0) & (size > 1)
    edge, size, home = edge[keep], size[keep], home[keep]
    big = home * size > _ALL_PAIRS
    left, right = [], []
    for e, n, h in zip(edge[big].tolist(), size[big].tolist(), home[big].tolist(), strict=True):
        x, y = forest(h, prints[e : e + n], MOST)
        left.append(e + np.array(x, np.int64)), right.append(e + np.array(y, np.int64))
    edge, size, home = edge[~big], size[~big], home[~big]
    for at in range(0, len(edge), _CHUNK // _ALL_PAIRS):  # the others: their pairs side by side, a bounded number at a time
        e, n, h = (v[at : at + _CHUNK // _ALL_PAIRS] for v in (edge, size, home))
        pairs = n * h
        group = np.repeat(np.arange(len(e)), pairs)
        k = np.arange(len(group)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        x, y = e[group] + k // n[group], e[group] + k % n[group]
        near = (x != y) & (np.bitwise_count(prints[x] ^ prints[y]) <= MOST)
        left.append(x[near]), right.append(y[near])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    a, b = prints[x].view(np.int64), prints[y].view(np.int64)
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
    return both[:, 0], both[:, 1]


def anchor_links(run_length: int):
    """a, b: links of the fingerprints that meet at an anchor; the input is sorted by place.

    An anchor of more than ``run_length`` is linked run by run, its first home
    beside every run, and its rows come again as place, a for the rest of its pairs.
    """

    def rows(a: np.ndarray, b: np.ndarray | None, place: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if place is None else pa.array(place)], names=["a", "b", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        number, key = 0, None  # rows held, the anchor of the last one
        first: tuple[np.ndarray, np.ndarray] | None = None  # that anchor's first row, once it is linked run by run

        def add(place: np.ndarray, prints: np.ndarray) -> None:
            nonlocal number
            held.append((place, prints))
            number += len(place)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if number:
                place, prints = (np.concatenate(c) for c in zip(*held, strict=True))
                if first:
                    yield rows(prints.view(np.int64), None, place)
                    place, prints = np.concatenate([first[0], place]), np.concatenate([first[1], prints])
                yield rows(*linked(place, prints), None)
            held.clear()
            number = 0

        for batch in batches:
            place, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(place):
                continue
            keys = place >> 1
            if keys[-1] == key:
                add(place, prints)
            else:
                own = 0 if key is None else int(np.searchsorted(keys, key, side="right"))  # goes on with the last anchor
                upto = int(np.searchsorted(keys, keys[-1]))  # what follows may go on in the next batch
                add(place[:own], prints[:own])
                if first:
                    yield from out()
                    first = None
                add(place[own:upto], prints[own:upto])
                yield from out()
                add(place[upto:], prints[upto:])
                key = keys[-1]
            if number > run_length:
                first = first or (held[0][0][:1], held[0][1][:1])
                yield from out()
        yield from out()

    return run


def print_links(prints: DataFrame, *, run_length: int = _RUN) -> DataFrame:
    """Links a, b that connect the distinct fingerprints (column print) that meet and differ in few bits, a written table."""
    met = replicated(prints).repartition(F.shiftright("place", 1)).sortWithinPartitions("place")
    found = written(met.mapInArrow(anchor_links(run_length), "a long, b long, place long"), "anchor-links")
    links = found.filter("b is not null").select("a", "b")
    dense = found.filter("b is null").select("place", F.col("a").alias("print"))
    return links if dense.isEmpty() else written(links.unionByName(dense_links(dense, links)), "anchor-links")


def dense_links(dense: DataFrame, links: DataFrame) -> DataFrame:
    """Links at anchors that were linked run by run, of what lies outside their largest component with everything."""
    roots = written(components(links).select(F.col("node").alias("print"), "root"), "roots")
    placed = dense.select(F.shiftright("place", 1).alias("anchor"), (F.col("place") % 2 == 0).alias("home"), "print")
    rooted = written(placed.join(small(roots, 32), "print", "left").withColumn("root", F.coalesce("root", "print")), "dense")
    largest = rooted.groupBy("anchor", "root").agg(F.count("*").alias("size")).groupBy("anchor").agg(F.max(F.struct("size", "root")).alias("most"))
    outside = rooted.join(largest.select("anchor", F.col("most.root").alias("main")), "anchor").filter("root <> main").drop("main")
    x, y = outside.alias("x"), rooted.alias("y")
    near = (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.home") | F.col("y.home")) & (F.bit_count(F.col("x.print").bitwiseXOR(F.col("y.print"))) <= MOST)
    return x.join(y, near).select(F.greatest("x.print", "y.print").alias("a"), F.least("x.print", "y.print").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, a row per row of ``docs``.

    component_id is the smallest id of the documents reached by links of at most
    four differing bits, itself included. Texts without words, null ones too, have
    fingerprint zero and are linked like others. Null ids are kept and never name a
    component unless it has no other id. Repeated rows are kept; further columns are
    left out; an empty table gives none.
    """
    with text_batches(docs.sparkSession):
        printed = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col)).alias("print")), "prints")
    first = written(printed.groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    named = component_of_nodes(first, written(components(print_links(first.select(F.col("node").alias("print")))), "roots"))
    out = printed.join(small(named.withColumnRenamed("node", "print"), 40), "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def close_nodes(printed: DataFrame) -> DataFrame:
    """Candidates a > b: nodes whose fingerprints are equal or linked, each with its component's leading node."""
    nodes = written(printed.select("node", "print").distinct(), "node-prints")
    first = written(nodes.groupBy("print").agg(F.min("node").alias("first")), "distinct-prints")
    rooted = written(components(print_links(first.select("print"))).select(F.col("node").alias("print"), "root"), "roots")
    named = written(first.join(small(rooted, 32), "print").select("print", "first", "root"), "named")
    leads = written(named.groupBy("root").agg(F.min("first").alias("lead")), "leads")
    led = written(named.join(small(leads, 32), "root").select("print", "lead"), "led")
    every = first.join(small(led, 32), "print", "left").select("print", F.coalesce("lead", "first").alias("lead"))
    return nodes.join(every, "print").filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates, with the columns of ``docs``.

    Links are the pairs whose five-word shingles have a Jaccard coefficient of 0.8 or
    more: candidates by fingerprints of the shingles and their anchors, completed and
    decided by exact coefficients (``ngram_join``). The row with the smallest id of
    the group stays; of rows of the group that share it, one stays. A group without
    any id keeps a row of each of its sets of shingles. Texts without words are one
    group; an empty table gives no rows.
    """
    row = column_name(docs, "row_hash")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = [F.col(id_col), F.col(text_col), *[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in (id_col, text_col)]]
    hashed = with_row_hash(docs, row, *whole)
    printed = measured(hashed, row, id_col, text_col)
    rooted = linked_nodes(hashed, printed, row, text_col, close_nodes(printed))
    first = written(printed.groupBy("node").agg(F.min("doc_id").alias("first_id")), "distinct-nodes")
    placed = printed.select("doc_id", "row", "node").join(small(component_of_nodes(first, rooted), 48), "node")
    # rows that may stay are those with the component's id; where there is none, every node is a group
    may = F.col("doc_id").eqNullSafe(F.col("component_id"))
    grouped = written(placed.select("row", may.alias("may"), F.when(F.col("component_id").isNull(), F.col("node")).otherwise(F.col("root")).alias("group")), "groups")
    several = written(grouped.groupBy("group").agg(F.min(F.when(F.col("may"), F.col("row"))).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"), "several")
    decided = written(grouped.join(small(several, 64), "group").groupBy("row").agg(F.first(F.col("row") == F.col("kept")).alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "decided")
    gone, repeated = decided.select(F.col("row").alias("_row")), decided.filter("stays").select(F.col("row").alias("_row"))
    out = hashed.join(small(gone, 40), F.col(row) == F.col("_row"), "left_anti")
    if not repeated.isEmpty():
        out = out.unionByName(hashed.join(small(repeated, 40), F.col(row) == F.col("_row"), "left_semi").dropDuplicates([row]))
    return out.select(*columns)
