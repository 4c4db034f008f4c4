"""Interleaved range asymmetric numeral system for token ids, in numpy.

A segment holds the ids of some whole documents: a header, a directory of the
documents, one frequency table, and blocks that share the table. A block has
``LANES`` interleaved states, is decoded without the others, stores all states
every ``CHECKPOINT`` steps, so that a reader can start there, and a CRC of its
ids. States are in [2^31, 2^63), and are refilled by 32-bit words.

Layout, little-endian: magic ``VFR1``; u32 documents, u32 blocks, u64 ids, u32
distinct ids, u32 bytes of the head, u32 CRC of the head; the head, a zlib
stream of columns: documents' i64 id, u8 id present, u64 first id, u32 ids;
distinct ids' u32 difference from the one before, u32 frequency; blocks' u32
ids, u32 words, u32 checkpoints, u32 CRC of ids. Then the blocks' bodies: per
checkpoint u32 word position and LANES u64 states, then the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"VFR1"
SCALE = 20  # frequencies sum to 2^SCALE
LANES, STEPS, CHECKPOINT = 256, 512, 256
BLOCK = LANES * STEPS
LOW = np.uint64(1 << 31)
_32, _S = np.uint64(32), np.uint64(SCALE)
_HEAD = struct.Struct("<4sIIQIII")
DOC = {"doc_id": "<i8", "known": "u1", "start": "<u8", "n": "<u4"}
ENTRY = {"id": "<u4", "freq": "<u4"}
INFO = {"ids": "<u4", "words": "<u4", "marks": "<u4", "crc": "<u4"}


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 in proportion to positive counts, summing to 2^SCALE."""
    total, want = int(counts.sum()), 1 << SCALE
    if len(counts) > want:
        raise ValueError(f"more than {want} distinct ids")
    freq = np.maximum(1, (counts.astype(np.float64) * (want / total)).astype(np.int64))
    over = int(freq.sum()) - want
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # take from the largest, never below 1
        can = np.minimum(freq[order] - 1, np.maximum(1, freq[order] >> 4))
        upto = np.minimum(np.cumsum(can), over)
        freq[order] -= np.diff(upto, prepend=0)
        over = int(freq.sum()) - want
    freq[order[0]] -= over
    return freq.astype(np.uint64)


class Table:
    """Frequencies of a sorted list of distinct ids."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.low = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        seen = np.flatnonzero(counts)
        return cls(seen, scaled(counts[seen]))

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id in the table."""
        place = np.zeros(int(self.ids[-1]) + 1, np.uint32)
        place[self.ids] = np.arange(len(self.ids), dtype=np.uint32)
        return place[ids]

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))


def encode_blocks(symbols: np.ndarray, table: Table, together: int = 16) -> list[tuple[tuple[int, ...], bytes]]:
    """INFO and body of each block of BLOCK symbols (places in the table)."""
    out = []
    limit = table.freq << np.uint64(63 - SCALE)
    for at in range(0, len(symbols), BLOCK * together):
        part = symbols[at : at + BLOCK * together]
        blocks = -(-len(part) // BLOCK)
        steps = STEPS if len(part) > BLOCK else -(-len(part) // LANES)
        grid = np.full(blocks * steps * LANES, part[-1], np.uint32)
        grid[: len(part)] = part
        grid = np.ascontiguousarray(grid.reshape(blocks, steps, LANES).swapaxes(0, 1)).reshape(steps, blocks * LANES)
        state = np.full(blocks * LANES, LOW, np.uint64)
        words = np.empty((steps, blocks * LANES), np.uint32)
        sent = np.empty((steps, blocks * LANES), bool)
        marks = {}
        for s in range(steps - 1, -1, -1):
            sym = grid[s]
            f = table.freq.take(sym)
            full = state >= limit.take(sym)
            sent[s] = full
            words[s] = state  # the low 32 bits
            state >>= full.astype(np.uint64) << np.uint64(5)
            q = state // f
            f *= q
            state -= f
            q <<= _S
            state += q
            state += table.low.take(sym)
            if s % CHECKPOINT == 0:
                marks[s] = state.reshape(blocks, LANES).astype("<u8")
        words, sent = words.reshape(steps, blocks, LANES), sent.reshape(steps, blocks, LANES)
        for b in range(blocks):
            n = min(BLOCK, len(part) - b * BLOCK)
            used = sent[:, b]
            upto = np.concatenate(([0], np.cumsum(used.sum(1))))
            body = b"".join(struct.pack("<I", int(upto[s])) + marks[s][b].tobytes() for s in sorted(marks))
            crc = zlib.crc32(table.ids[part[b * BLOCK : b * BLOCK + n]].astype("<u4").tobytes())
            out.append(((n, int(upto[-1]), len(marks), crc), body + words[:, b][used].astype("<u4").tobytes()))
    return out


_MARK, _LANE_BITS = 4 + 8 * LANES, LANES.bit_length() - 1


def decode_steps(states: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, table: Table, slots: np.ndarray) -> np.ndarray:
    """Symbols [runs, steps, LANES]: runs are decoded side by side, each from its states and place in ``words``."""
    runs = len(states)
    out = np.empty((steps, runs * LANES), np.uint32)
    state, at = states.reshape(-1), at.copy()
    mask = np.uint64((1 << SCALE) - 1)
    words = np.append(words, np.uint32(0))
    for s in range(steps):
        slot = state & mask
        sym = slots.take(slot)
        out[s] = sym
        state >>= _S
        state *= table.freq.take(sym)
        slot -= table.low.take(sym)
        state += slot
        need = np.flatnonzero(state < LOW)
        run = need >> _LANE_BITS
        counts = np.bincount(run, minlength=runs)
        ends = np.cumsum(counts)
        where = np.arange(len(need)) + (at - ends + counts)[run]
        state[need] = (state[need] << _32) | words.take(where, mode="clip")
        at += counts
    return out.reshape(steps, runs, LANES).swapaxes(0, 1)


def encode_segment(doc_ids: list[int | None], starts: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    """Bytes of a segment; ``ids`` are those of its documents, end to end."""
    if len(ids):
        table = Table.of(ids)
        blocks = encode_blocks(table.symbols(ids), table)
    else:
        table, blocks = Table(np.zeros(0, np.uint32), np.zeros(0, np.uint64)), []
    infos = np.array([i for i, _ in blocks], np.int64).reshape(-1, len(INFO))
    columns = [
        *zip(DOC.values(), ([d or 0 for d in doc_ids], [d is not None for d in doc_ids], starts, lengths), strict=True),
        *zip(ENTRY.values(), (np.diff(table.ids.astype(np.int64), prepend=0), table.freq), strict=True),
        *zip(INFO.values(), infos.T, strict=True),
    ]
    head = zlib.compress(b"".join(np.asarray(v).astype(kind).tobytes() for kind, v in columns))
    return b"".join([_HEAD.pack(MAGIC, len(doc_ids), len(blocks), len(ids), len(table.ids), len(head), zlib.crc32(head)), head, *(b for _, b in blocks)])


class Segment:
    """Directory, table and blocks of an encoded segment; ids are decoded on demand."""

    def __init__(self, raw: bytes):
        magic, n_docs, n_blocks, self.n_ids, n_entries, size, crc = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a segment")
        head = raw[_HEAD.size : _HEAD.size + size]
        if zlib.crc32(head) != crc:
            raise ValueError("the segment's head is damaged")
        head, at, parts = zlib.decompress(head), 0, []
        for kinds, n in ((DOC, n_docs), (ENTRY, n_entries), (INFO, n_blocks)):
            parts.append({})
            for name, kind in kinds.items():
                parts[-1][name] = np.frombuffer(head, kind, n, at)
                at += np.dtype(kind).itemsize * n
        self.docs, entries, self.info = parts
        self.table = Table(np.cumsum(entries["id"]), entries["freq"])
        sizes = self.info["marks"].astype(np.int64) * _MARK + self.info["words"].astype(np.int64) * 4
        self.raw, self.slots = raw, self.table.slots()
        self.at = _HEAD.size + size + np.concatenate(([0], np.cumsum(sizes)))

    def block(self, k: int) -> np.ndarray:
        """Ids of block ``k``, all its checkpoints side by side; its CRC is checked."""
        return self.several(k, k + 1)

    def several(self, k: int, end: int) -> np.ndarray:
        """Ids of blocks ``k`` to ``end``, decoded side by side from all their checkpoints."""
        states, places, streams, counts, base = [], [], [], [], 0
        for b in range(k, end):
            at, marks = int(self.at[b]), int(self.info["marks"][b])
            for m in range(marks):
                places.append(base + struct.unpack_from("<I", self.raw, at + m * _MARK)[0])
                states.append(np.frombuffer(self.raw, "<u8", LANES, at + m * _MARK + 4))
            streams.append(np.frombuffer(self.raw, "<u4", int(self.info["words"][b]), at + marks * _MARK))
            counts.append(marks)
            base += len(streams[-1])
        got = decode_steps(np.array(states, np.uint64), np.concatenate(streams), np.array(places, np.int64), min(CHECKPOINT, -(-int(self.info["ids"][k:end].max()) // LANES)), self.table, self.slots)
        out, first = [], 0
        for b, marks in zip(range(k, end), counts, strict=True):
            ids = self.table.ids[got[first : first + marks].reshape(-1)[: self.info["ids"][b]]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != self.info["crc"][b]:
                raise ValueError(f"block {b} is damaged")
            out.append(ids)
            first += marks
        return np.concatenate(out)

    def ids(self, together: int = 8) -> np.ndarray:
        """Ids of the whole segment."""
        n = len(self.info["ids"])
        return np.concatenate([self.several(k, min(n, k + together)) for k in range(0, n, together)]) if n else np.zeros(0, np.uint32)
