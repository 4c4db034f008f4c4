"""Edit distance of arrays: by their lengths where one is within the other, by diagonals for few edits, by bits for many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ROUNDS = 4  # signs by which all diagonals are extended side by side before the rest go on alone
_NEVER = -(1 << 40)
_EDIT, _WIDE = 70, 1500  # a round of diagonals takes as long as some 70 signs by bits, which take twice as long per 1,500 bits


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), 2 * step
    return n


def _within(short: list[int], long: list[int]) -> bool:
    """Whether some of the longer list's codes, in their order, are the shorter list."""
    rest = iter(long)
    return all(code in rest for code in short)


def _by_bits(a: list[int], b: list[int]) -> int:
    """Edit distance column by column, a column's steps up and down as the bits of two whole numbers (Myers, Hyyrö)."""
    at: dict[int, int] = {}
    for k, code in enumerate(a):
        at[code] = at.get(code, 0) | 1 << k
    every, last, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for code in b:
        same = at.get(code, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(across | up)), up & across
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more, stay = (more << 1 | 1) & every, same | down
        up, down = (less << 1 | ~(stay | more)) & every, more & stay
    return score


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Fewest insertions, deletions and replacements from one array of codes to the other.

    An array within the other is as far from it as their lengths. Else, for each number of edits and each diagonal, how far into ``a`` one can get: one
    more edit reaches a diagonal from itself or from its neighbours, and equal codes
    go on for nothing. Where the edits become more than columns of bits would cost,
    those are taken.
    """
    first = _same(a, b)
    a, b = a[first:], b[first:]
    last = _same(a[::-1], b[::-1])
    a, b = a[: len(a) - last], b[: len(b) - last]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)
    short, long = sorted((a.tolist(), b.tolist()), key=len)
    if n != m and _within(short, long):
        return abs(n - m)
    few = len(long) * (1 + len(short) / _WIDE) / _EDIT
    if abs(m - n) > few:
        return _by_bits(short, long)
    reached, edits = np.zeros(1, np.int64), 0
    while abs(m - n) > edits or reached[m - n + edits] < n:
        edits += 1
        if edits > few:
            return _by_bits(short, long)
        before = np.full(2 * edits + 3, _NEVER)
        before[2:-2] = reached
        diagonal = np.arange(-edits, edits + 1)
        most = np.minimum(n, m - diagonal)
        reached = np.minimum(np.maximum(np.maximum(before[1:-1] + 1, before[2:] + 1), before[:-2]), most)
        open_ = np.flatnonzero((reached >= 0) & (reached < most))
        for _ in range(_ROUNDS):
            x = reached[open_]
            open_ = open_[a[x] == b[x + diagonal[open_]]]
            reached[open_] += 1
            open_ = open_[reached[open_] < most[open_]]
        for k in open_.tolist():
            x = int(reached[k])
            reached[k] += _same(a[x:], b[x + int(diagonal[k]) :])
    return edits


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances in code points; null where either is."""
    pairs = ((x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True))
    return pa.array([None if x is None or y is None else distance(codes(x), codes(y)) for x, y in pairs], pa.int32())


def list_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances of lists of texts, whose items get numbers first; null where either is."""
    items = pa.concat_arrays([a.flatten(), b.flatten()])
    known = pc.dictionary_encode(items, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    sizes = [np.array([0 if n is None else n for n in pc.list_value_length(v).to_pylist()], np.int64) for v in (a, b)]
    ends = [np.cumsum(s) for s in sizes]
    second = len(a.flatten())
    out = []
    for k, missing in enumerate(pc.or_(a.is_null(), b.is_null()).to_pylist()):
        x, y = (known[base + e[k] - s[k] : base + e[k]] for base, e, s in ((0, ends[0], sizes[0]), (second, ends[1], sizes[1])))
        out.append(None if missing else distance(x, y))
    return pa.array(out, pa.int32())
