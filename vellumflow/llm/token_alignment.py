"""Tokens of two tokenizers over the same text, aligned by a dangling-suffix transducer.

Both token sequences spell the same bytes. The transducer's state is which side
leads and the bytes it is ahead by; the next token is taken from the other side and
cancels against them. A transition depends on the state and the token's id alone,
so it is computed once and kept. Where nothing is left over, both sides end together:
a group closes, and its last two tokens are linked.

The aligned texts are a written table: ids of both sides and the sizes of the
groups, packed, so that Spark passes on a row's numbers as one value each. Counts of linked id pairs over the corpus are summed by task before they
are shuffled; there are at most as many pairs as the product of both vocabularies.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.shared import Scratch, setting, small, text_batches, written
from vellumflow.llm.tokens import WORD, WS, PieceCache, byte_signs, default_piece_model, default_tokenizer

_STEP = 256  # rows whose arrays are built side by side
_TRANSITIONS = 1 << 20  # transitions that a worker keeps
_PIECES = 100_000  # other pieces than words that a worker keeps
_CHARS = 8 << 20  # characters, and a hundred for each, of the segments that a worker keeps
MARK = "\u2581"  # a space in the SentencePiece model
_MIXED = re.compile(f"[{WS}] ")  # a space that follows white space is no cut
_CUT = re.compile(f"(?<=[^{WS}])(?= )")
_PAIRS = 1 << 19  # counted pairs that a task holds before it merges them
PAIR_BYTES = 32 << 20  # most bytes of the counted pairs that are sent to all tasks
NOTHING = b"\xff"  # stands for a token without bytes: no text has it
NUMBERS = ["a_ids", "b_ids", "a_sizes", "b_sizes"]
PACKED = "uid long, doc_id long, " + ", ".join(f"{c} binary" for c in NUMBERS)
ALIGNED = "uid long, doc_id long, " + ", ".join(f"{c} array<int>" for c in NUMBERS)
_DENSE = ("spark.sql.parquet.compression.codec", "zstd")  # of packed numbers, half of whose bytes are zero
_READ = ("spark.sql.parquet.columnarReaderBatchSize", "256")  # rows whose numbers a reader holds side by side


class State(dict):
    """Bytes by which a side is ahead; the items are the transitions by the other side's next token."""

    def __init__(self, machine: Transducer, from_b: bool, rest: bytes):
        super().__init__()
        self.machine, self.from_b, self.rest = machine, from_b, rest  # from_b: the next token is B's

    def __missing__(self, token: int) -> State | None:
        self[token] = out = self.machine.transition(self, token)
        return out


class Transducer:
    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.reset()

    def reset(self) -> None:
        self.known, self.states = 0, {}
        self.start = self.state(False, b"")

    def state(self, from_b: bool, rest: bytes) -> State:
        if (from_b, rest) not in self.states:
            self.states[from_b, rest] = State(self, from_b, rest)
        return self.states[from_b, rest]

    def transition(self, state: State, token: int) -> State | None:
        """The state after a token; None where the bytes of both sides differ."""
        self.known += 1
        new, rest = self.bytes[state.from_b][token], state.rest
        if new == rest:
            return self.start
        if rest.startswith(new):
            return self.state(state.from_b, rest[len(new) :])
        if new.startswith(rest):
            return self.state(not state.from_b, new[len(rest) :])
        return None

    def align(self, a, b) -> tuple[list[int], list[int]] | None:
        """How many tokens of a and of b are before the end of each group; None if they don't spell the same bytes."""
        if self.known > _TRANSITIONS:
            self.reset()
        a_cuts, b_cuts, state, start, i, j, n = [], [], self.start, self.start, 0, 0, len(b)
        for token in a:
            state = state[token]
            i += 1
            while state is not None and state.from_b and j < n:
                state = state[b[j]]
                j += 1
            if state is start:
                a_cuts.append(i)
                b_cuts.append(j)
            elif state is None or state.from_b:  # the bytes differ, or b has ended
                return None
        return (a_cuts, b_cuts) if state is start and j == n else None


def a_token_bytes(tokenizer) -> list[bytes]:
    signs = {s: b for b, s in byte_signs().items()}
    out = []
    for k in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(k) or ""
        out.append(bytes(signs[c] for c in token) if token and all(c in signs for c in token) else token.encode() or NOTHING)
    return out


def b_token_bytes(model) -> list[bytes]:
    out = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(NOTHING if model.is_control(k) or model.is_unknown(k) else piece.replace(MARK, " ").encode())
    return out


class PlainPieces(PieceCache):
    """Ids of a byte-level tokenizer file that takes special tokens' strings for ordinary text.

    A word is merged by its ranks, where the file's merges are in the order of their ids.
    """

    def __init__(self, path: str):
        super().__init__(path, _PIECES)
        self.tokenizer.encode_special_tokens, self.added = True, []
        self.merge = None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(self.tokenizer.to_str())["model"]["merges"]]
        made = [vocab.get("".join(m)) for m in merges]
        back = {s: b for b, s in byte_signs().items()}
        if self.cuts and None not in made and made == sorted(set(made)) and all(c in back for t in vocab for c in t):
            from tiktoken import Encoding

            ranks = {bytes(back[c] for c in t): k for t, k in vocab.items()}
            self.merge = Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if self.merge and WORD.fullmatch(piece):
            return array(self.kind, self.merge(piece.encode())).tobytes()
        return super().__missing__(piece)


class Aligner(dict):
    """Two tokenizers and, for each segment met, the packed ids of both sides and the groups' sizes, or None.

    A segment is a space and what follows up to a space after something visible.
    Both tokenizers cut there (checked for the model), so a text's tokens are those of
    its segments, and the transducer is at its start between them. The items are
    put aside when they hold too many characters, and those met again come back. Where a tokenizer may reach over such
    cuts, a text is one segment.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.a, self.b = PlainPieces(a_path), SentencePieceProcessor(model_file=b_path)
        self.machine = Transducer(a_token_bytes(self.a.tokenizer), b_token_bytes(self.b))
        self.alone = [self.b.piece_to_id(MARK)]  # what the model's own space is, alone
        self.held, self.sizes, self.old = 0, {}, {}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        sample = "a  b c "
        kept = "".join(self.b.encode(sample, out_type=str)) == MARK + sample.replace(" ", MARK)  # spaces stay as they are
        self.cuts = self.a.cuts and kept and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """The segments of a space and the text, each without its first space."""
        if not self.cuts:
            return [text]
        if text[:1] == " " or _MIXED.search(text):
            return [p[1:] for p in _CUT.split(" " + text)]
        return text.split(" ")

    def learn(self, parts: set[str]) -> None:
        """Items of all these segments; those met before the items were last put aside come back."""
        if self.held > _CHARS:  # before it is asked which are missing: others of these texts may be among the items
            self.old = self.copy()
            self.clear()
            self.held = 0
        missing = parts.difference(self)
        if not missing:
            return
        again = self.old.keys() & missing
        self.update((p, self.old[p]) for p in again)
        new = list(missing - again)
        a_bytes, align, merge, kind = self.machine.bytes[0], self.machine.align, self.a.merge, self.a.kind
        for part, b in zip(new, self.b.encode(new, num_threads=1), strict=True):
            text = " " + part
            if merge and WORD.fullmatch(text):  # merges keep the bytes
                a, same = merge(text.encode()), True
            else:
                a = array(kind, self.a.encode(text))
                same = b"".join([a_bytes[k] for k in a]) == text.encode()
            cuts = align(a, b if part else self.alone) if same else None
            self[part] = None if cuts is None else (array("I", a).tobytes(), array("I", b or self.alone).tobytes(), *self.packed_sizes(cuts))
        self.held += sum(map(len, missing)) + 100 * len(missing)

    def packed_sizes(self, cuts: tuple[list[int], list[int]]) -> tuple[bytes, bytes]:
        """Most segments have one of a few forms, kept once."""
        key = (*cuts[0], *cuts[1])
        made = self.sizes.get(key)
        if made is None:
            made = tuple(array("I", map(sub, c, [0, *c])).tobytes() for c in cuts)
            if len(key) <= 8:
                self.sizes[key] = made
        return made

    def release(self) -> None:
        """Drop what is kept of the texts, for a stage that aligns none."""
        self.clear(), self.old.clear(), self.sizes.clear(), self.a.clear(), self.a.old.clear(), self.machine.reset()
        self.held = 0

    def align(self, texts: list[str | None]) -> list[tuple[bytes, bytes, bytes, bytes]]:
        """Packed ids of both sides and the groups' sizes, empty for texts without tokens."""
        cut = [self.parts(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        out = []
        for parts in cut:
            found = list(map(self.__getitem__, parts))
            out.append(tuple(map(b"".join, zip(*found, strict=True))) if found and None not in found else (b"",) * 4)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's own, kept between tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def readable(raw: bytes | None) -> str | None:
    """The text; None where the bytes are no UTF-8, which no tokens spell."""
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def packed_texts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`align_texts`, a written table with packed numbers (little-endian, 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for k in range(0, batch.num_rows, _STEP):
                rows = batch.slice(k, _STEP)
                found = own.align([readable(t.as_py()) for t in rows.column("text")])
                yield pa.RecordBatch.from_arrays([rows.column("uid"), rows.column("doc_id"), *(pa.array(c, pa.binary()) for c in zip(*found, strict=True))], names=["uid", "doc_id", *NUMBERS])

    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    with text_batches(docs.sparkSession), setting(docs.sparkSession, *_DENSE):
        return written(texts.mapInArrow(run, PACKED), "aligned")


def align_texts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, a_ids, b_ids, a_sizes, b_sizes for every row of ``docs``.

    a_ids are the ids of a space and the text by the byte-level tokenizer file, b_ids
    those of the text by the SentencePiece model, which adds the space; special
    tokens' strings in a text are ordinary text. The sizes say how many of either
    make each group. A text that is null or empty, or that either side doesn't spell
    byte for byte, has empty arrays. Texts are taken whole, whatever their length.
    uid tells rows apart, as ids may be null or repeated. Further columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _STEP):
                rows = batch.slice(k, _STEP)
                yield pa.RecordBatch.from_arrays([rows.column("uid"), rows.column("doc_id"), *(_lists(rows.column(c).to_pylist()) for c in NUMBERS)], names=["uid", "doc_id", *NUMBERS])

    return packed_texts(docs, a_path, b_path, id_col=id_col, text_col=text_col).mapInArrow(run, ALIGNED)


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of few rows, as several arrays are as long as all of a run's tokens.

    The texts are aligned by then, so a worker that aligned some lets go of their segments.
    """
    for own in _aligners.values():
        own.release()
    for batch in batches:
        for k in range(0, batch.num_rows, _STEP // 4):
            yield batch.slice(k, _STEP // 4)


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a column of packed numbers, or of lists, and where each row's begin."""
    if pa.types.is_list(column.type):
        offsets = column.offsets.to_numpy()
        return column.flatten().to_numpy(), offsets - offsets[0]
    _, places, raw = column.buffers()
    offsets = np.frombuffer(places, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(raw or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.int32), (offsets - offsets[0]) // 4


def links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes (A's id, then B's in the lower half) of all links, and where each row's begin."""
    (a, _), (b, _), (a_sizes, first), (b_sizes, _) = (values(batch.column(c)) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    return a[np.cumsum(a_sizes, dtype=np.int64) - 1].astype(np.int64) << 32 | b[np.cumsum(b_sizes, dtype=np.int64) - 1], first


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(np.concatenate(codes), return_inverse=True)
    return known, np.bincount(at, np.concatenate(counts), len(known)).astype(np.int64)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code, n: how often the links of a task's rows hold an id pair."""
    codes, counts, held = [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(counts[0])], names=["code", "n"])

    for batch in steps(batches):
        found, n = np.unique(links(batch)[0], return_counts=True)
        codes.append(found), counts.append(n)
        held += len(found)
        if held > _PAIRS:
            codes[:], counts[:] = ([v] for v in merged(codes, counts))
            held = len(codes[0])
            if 2 * held > _PAIRS:
                yield out()
                codes, counts, held = [], [], 0
    if codes:
        codes[:], counts[:] = ([v] for v in merged(codes, counts))
        yield out()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code, n, best: linked id pairs, their links in the corpus, and whether no pair of the same B id has more; a written table."""
    with Scratch(aligned.sparkSession) as scratch, text_batches(aligned.sparkSession), setting(aligned.sparkSession, *_READ):
        parts = aligned.select(*NUMBERS).mapInArrow(count_pairs, "code long, n long")
        counts = scratch.written(parts.groupBy("code").agg(F.sum("n").alias("n")).withColumn("b", F.col("code").bitwiseAND((1 << 32) - 1)), "pairs")
        most = scratch.written(counts.groupBy("b").agg(F.max("n").alias("most")), "most")
        return written(counts.join(small(most, 24), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def row_sums(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])[first])


def group_digests(batch: pa.RecordBatch, numbers: pa.Array) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each row, '' without tokens; numbers: ids in decimal with , | and ; after them."""
    (a, a_first), (b, b_first), (a_sizes, _), (b_sizes, _) = (values(batch.column(c)) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    a_upto, b_upto = np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64)
    codes = np.empty(len(a) + len(b), np.int64)
    a_sep, b_sep = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_sep[a_upto - 1], b_sep[b_upto - 1] = 1, 2
    codes[np.arange(len(a)) + np.repeat(b_upto - b_sizes, a_sizes)] = 3 * a.astype(np.int64) + a_sep
    codes[np.arange(len(b)) + np.repeat(a_upto, b_sizes)] = 3 * b.astype(np.int64) + b_sep
    spelt = numbers.take(pa.array(codes))
    places = np.frombuffer(spelt.buffers()[1], np.int64)[: len(codes) + 1]
    text, ends = memoryview(spelt.buffers()[2] or b""), places[a_first + b_first].tolist()
    return [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:], strict=False)]


DIGEST = ["uid long", "doc_id long", "n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string"]


def digests(aligned: DataFrame, counts: DataFrame, most: int, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """DIGEST, n_best, count_sum for every row of :func:`align_texts`; counts: see :func:`pair_counts`, most: ids of the larger vocabulary.

    The counts go to all tasks if they are at most ``pair_bytes``; else each row's
    distinct links are joined to them.
    """
    sent = counts.count() * 17 <= pair_bytes
    table = counts.orderBy("code").toArrow() if sent else None
    codes, n, best = (table.column(c).to_numpy() for c in ("code", "n", "best")) if sent else (None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.array([f"{k}{sep}" for k in range(most) for sep in ",|;"], pa.large_string())
        for batch in steps(batches):
            sizes = [pa.array(np.diff(values(batch.column(c))[1]).astype(np.int64)) for c in ("a_ids", "b_ids", "a_sizes", "a_sizes")]
            out = [batch.column("uid"), batch.column("doc_id"), *sizes, pa.array(group_digests(batch, numbers))]
            if sent:
                found, first = links(batch)
                at = np.searchsorted(codes, found)
                out += [pa.array(row_sums(v[at], first)) for v in (best, n)]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in DIGEST] + ["n_best", "count_sum"][: 2 * sent])

    def distinct_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found, first = links(batch)
            uids = np.repeat(batch.column("uid").to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(found)], names=["uid", "code"])

    if sent:
        return aligned.mapInArrow(run, ", ".join([*DIGEST, "n_best long", "count_sum long"]))
    each = aligned.mapInArrow(distinct_links, "uid long, code long").groupBy("uid", "code").agg(F.count("*").alias("m"))
    sums = each.join(counts, "code").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    return aligned.mapInArrow(run, ", ".join(DIGEST)).join(sums, "uid", "left").fillna(0, ["n_best", "count_sum"])


def alignment_digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    Null ids and repeated rows are kept, and a repeated row's links count again. For
    texts without tokens see :func:`align_texts`: their numbers are 0 and their
    digest is ''. An empty table gives no rows.
    """
    a_path, b_path = a_path or default_tokenizer(), b_path or default_piece_model()
    aligned = packed_texts(docs, a_path, b_path, id_col=id_col, text_col=text_col)
    own = aligner(a_path, b_path)
    with text_batches(docs.sparkSession), setting(docs.sparkSession, *_READ):
        out = written(digests(aligned, pair_counts(aligned), max(map(len, own.machine.bytes)), pair_bytes), "digests")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
