"""Stupid-backoff scores from n-gram count tables, partitioned and joined by hash.

Documents are dealt into buckets. A bucket explodes its n-grams and asks for the
counts of the distinct ones, one packed row for each hash partition of the count
table; a partition sums what the buckets report, which is its part of the table,
and joins the counts to what each bucket asked; the answers meet the bucket's
documents again, whose shuffle is the one already made, and are summed per
document. N-grams travel as sorted 56-bit hashes, so a common one is one entry per
bucket, no partition sees its occurrences, and nothing reaches the driver.

A document is scored by the others: from every count its own occurrences are taken,
as otherwise no n-gram of the corpus would ever be unseen and nothing back off. With
w the words (A-Z lower-cased) and c those counts, a word after k - 1 others has
S = c(w1 .. wk) / c(w1 .. wk-1) for the longest n-gram of at most ``order`` words
that is seen, times ``backoff`` for each length above it. A single word has
c(w) / n, n being the words of the others; a word that only the document has is one
step below, 1 / n. A document's score is the sum of log10 S.

Unigrams and bigrams are asked for at once, longer n-grams in a round each and only
where both n-grams within are there twice or more: any other occurs once, which
needs no asking.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASKED = "part int, bucket int, kind int, hashes binary, counts binary"
ANSWERED = "bucket int, part int, kind int, counts binary"
SCORED = "doc_id long, n_words long, log_score double"
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd number with well spread bits
_KEPT = np.uint64(0xFFFFFFFFFFFFFF00)  # bits of a hash that tell n-grams apart


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    known: dict[bytes, int] = {}
    out, sizes = [], []
    for text in texts:
        words = text.lower().split()
        sizes.append(len(words))
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that ends one place before each word, and of the word; the first has none before it."""
    h = np.concatenate([grams[:1], grams[:-1]]) * _MIX
    h ^= h >> np.uint64(29)
    h += words
    h *= _MIX
    return (h ^ (h >> np.uint64(32))) & _KEPT


class Grams:
    """The n-grams of some texts, each at the place of its last word, of one length at a time.

    ``kind`` is the number of words, ``hashes`` are those of the n-grams that end at
    each word, valid where ``place``, the number of words before it in its text, is
    ``kind`` - 1 or more.
    """

    def __init__(self, texts: list[bytes]):
        self.words, self.sizes = hashed_words(texts)
        self.row = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.place = (np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)
        self.kind, self.hashes = 1, self.words & _KEPT
        self.often: np.ndarray | None = None

    def lengthen(self, totals: np.ndarray | None = None) -> None:
        """Go on to the n-grams of one word more; ``totals`` are the counts of those before."""
        self.often = None if totals is None or self.kind == 1 else totals >= 2
        self.kind, self.hashes = self.kind + 1, longer(self.hashes, self.words)

    def asked(self) -> np.ndarray:
        """Places whose n-grams are asked for: where those one word shorter occur twice or more, if that is known."""
        valid = self.place >= self.kind - 1
        if self.often is not None:
            valid &= self.often
            valid[1:] &= self.often[:-1]
        return np.flatnonzero(valid)

    def totals(self, got: dict[int, np.ndarray]) -> np.ndarray:
        """Count at each place by the answers; what wasn't asked for occurs once."""
        at, reply = self.asked(), got.get(self.kind, np.zeros(0, np.int64))
        distinct, inverse = np.unique(self.hashes[at], return_inverse=True)
        if len(reply) != len(distinct):
            raise ValueError("a bucket's documents aren't those that asked; its input isn't stable")
        out = np.ones(len(self.words), np.int64)
        out[at] = reply[inverse]
        return out

    def own(self) -> np.ndarray:
        """How often the n-gram at each place occurs in its text."""
        at = np.flatnonzero(self.place >= self.kind - 1)
        key = self.hashes[at] ^ (self.row[at] + 1).astype(np.uint64) * _MIX
        order = np.argsort(key)
        key = key[order]
        edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        size = np.diff(edge, append=len(key))
        out = np.zeros(len(self.words), np.int64)
        out[at[order]] = np.repeat(size, size)
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hashes[self.asked()], return_counts=True)


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def packed_hashes(hashes: np.ndarray) -> bytes:
    """The kept bytes of the differences of ascending hashes, byte by byte, so that the high ones are runs of zeros."""
    return np.ascontiguousarray(np.diff(hashes.astype("<u8"), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T[1:]).tobytes()


def unpacked_hashes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(7, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, 1:] = planes.T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition, ascending with the hash."""
    return (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def replies(answers: pa.Table) -> dict[int, np.ndarray]:
    """Totals of a bucket's distinct n-grams by kind, in ascending order of their hashes."""
    got: dict[int, list[tuple[int, bytes]]] = {}
    for kind, part, raw in zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), answers["counts"].to_pylist(), strict=True):
        got.setdefault(kind, []).append((part, raw))
    return {kind: np.concatenate([_unpacked(raw, "<u8") for _, raw in sorted(rows)]).astype(np.int64) for kind, rows in got.items()}


def packed_rows(bucket: int, parts: int, counted: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """ASKED of a bucket: distinct hashes, ascending, and their counts in it, by kind."""
    rows = []
    for kind, (distinct, counts) in counted.items():
        cuts = np.searchsorted(part_of(distinct, parts), np.arange(parts + 1)).tolist()
        rows += [(p, bucket, kind, packed_hashes(distinct[a:b]), _packed(counts[a:b], "<u8")) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["part", "bucket", "kind", "hashes", "counts"])


def texts_of(docs: pa.Table) -> list[bytes]:
    return [t or b"" for t in docs["text"].to_pylist()]


def first_asks(parts: int, upto: int):
    """The empty n-gram, whose count is the number of words, and all of up to so many words."""

    def run(docs: pa.Table) -> pa.Table:
        grams = Grams(texts_of(docs))
        counted = {0: (np.zeros(1, np.uint64), np.array([len(grams.words)])), 1: grams.distinct()}
        for kind in range(2, upto + 1):
            grams.lengthen()
            counted[kind] = grams.distinct()
        return packed_rows(docs["bucket"][0].as_py(), parts, counted)

    return run


def more_asks(parts: int, kind: int):
    """Those of ``kind`` words whose parts are answered with two or more."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        grams, got = Grams(texts_of(docs)), replies(answers)
        grams.lengthen()
        while grams.kind < kind:
            grams.lengthen(grams.totals(got))
        return packed_rows(docs["bucket"][0].as_py() if len(docs) else 0, parts, {kind: grams.distinct()})

    return run


def summed(table: pa.Table) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of a partition: rows, distinct hashes, totals, where each row's hashes are among them, and the rows' ends."""
    kinds = np.array(table["kind"].to_pylist(), np.int64)
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind).tolist()
        hashes = [unpacked_hashes(table["hashes"][i].as_py()) for i in own]
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate([_unpacked(table["counts"][i].as_py(), "<u8") for i in own])
        totals = np.bincount(inverse, counts.astype(np.float64), len(distinct)).astype(np.int64)
        yield kind, own, distinct, totals, inverse, np.cumsum([len(h) for h in hashes])


def answer(table: pa.Table) -> pa.Table:
    """Total counts of a partition's n-grams, in the order in which each bucket asked."""
    out: list[bytes] = [b""] * len(table)
    for _, own, _, totals, inverse, ends in summed(table):
        for i, each in zip(own, np.split(totals[inverse], ends[:-1]), strict=True):
            out[i] = _packed(each, "<u8")
    return pa.table({"bucket": table["bucket"], "part": table["part"], "kind": table["kind"], "counts": pa.array(out, pa.binary())})


def counted(table: pa.Table) -> pa.Table:
    """Rows kind, hash, n of a partition of the count table."""
    made = [(np.full(len(h), kind), h, n) for kind, _, h, n, _, _ in summed(table)]
    kind, h, n = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*made, strict=True) if made else ([], [], [])))
    return pa.table({"kind": pa.array(kind, pa.int32()), "hash": pa.array(h.astype(np.uint64).view(np.int64)), "n": pa.array(n, pa.int64())})


def scores(order: int, backoff: float, own: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        grams, got = Grams(texts_of(docs)), replies(answers)
        sizes, row, step = grams.sizes, grams.row, np.log10(backoff)
        words = (int(got[0][0]) if 0 in got else 0) - (0 if own else sizes)
        before = np.log10(np.maximum(1, np.broadcast_to(words, sizes.shape)))[row]  # log count of the context
        most = np.minimum(order, grams.place + 1)
        each = most * step - before
        while True:
            totals = grams.totals(got)
            left = totals if own else totals - grams.own()
            seen = (grams.place >= grams.kind - 1) & (left > 0)
            logs = np.log10(np.maximum(1, left))
            each = np.where(seen, logs - before + (most - grams.kind) * step, each)
            if grams.kind == order:
                break
            before = np.concatenate([logs[:1], logs[:-1]])
            grams.lengthen(totals)
        total = np.bincount(row, each, len(sizes)) if len(sizes) else np.zeros(0)
        return pa.table({"doc_id": docs["doc_id"].cast(pa.int64()), "n_words": pa.array(sizes), "log_score": pa.array(total, pa.float64())})

    return run


def dealt(docs: DataFrame, bucket_bytes: int, least_buckets: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, text, bucket, and the number of buckets. Copies of a row are spread by the partition that they come from."""
    text = F.col(text_col).cast("binary")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(least_buckets, -(-size // bucket_bytes))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(id_col, text_col, F.spark_partition_id()), F.lit(buckets)).cast("int").alias("bucket")), buckets


def answers_of(rows: DataFrame, buckets: int, order: int) -> DataFrame:
    asked = rows.groupBy("bucket").applyInArrow(first_asks(buckets, min(order, 2)), ASKED)
    answered = asked.groupBy("part").applyInArrow(answer, ANSWERED)
    for kind in range(3, order + 1):
        asked = rows.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(more_asks(buckets, kind), ASKED)
        answered = answered.unionByName(asked.groupBy("part").applyInArrow(answer, ANSWERED))
    return answered


def ngram_counts(docs: DataFrame, *, order: int = 2, bucket_bytes: int = 16 << 20, least_buckets: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kind, hash, n: the count table of all n-grams of up to ``order`` words, partitioned by hash; kind 0 counts words."""
    rows, buckets = dealt(docs, bucket_bytes, least_buckets, id_col, text_col)
    first = rows.groupBy("bucket").applyInArrow(first_asks(buckets, order), ASKED)
    return first.groupBy("part").applyInArrow(counted, "kind int, hash long, n long")


def lm_scores(docs: DataFrame, *, order: int = 3, backoff: float = 0.4, own: bool = False, bucket_bytes: int = 16 << 20, least_buckets: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score, a row per row of ``docs``.

    ``order``: words of the longest n-gram, 1 or more. ``own``: whether a row's own
    n-grams count for it too. A null or empty text has no words and score 0. Null ids
    and repeated rows are kept; repeated rows count as often as they occur, and each
    is another document to the others. Further columns are left out; an empty table
    gives none. Equal 56-bit hashes count as equal n-grams: with 10^12 of them, 14 in a million.
    """
    rows, buckets = dealt(docs, bucket_bytes, least_buckets, id_col, text_col)
    answered = answers_of(rows, buckets, order)
    return rows.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(scores(order, backoff, own), SCORED)
