"""Edit distances against the plain table, and how many steps they take."""

import random

import numpy as np

from vellumflow.functions import distances


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_distances_by_every_way():
    rng = random.Random(5)
    for k in range(600):
        a = "".join(rng.choice("abcé𝒳"[: 2 + k % 4]) for _ in range(rng.randint(0, 70)))
        b = [a.replace("ab", "a"), a.replace("b", "xy"), a[::-1], "".join(rng.choice("abc") for _ in range(rng.randint(0, 70)))][k % 4]
        want = table(a, b)
        assert distances.distance(distances.codes(a), distances.codes(b)) == want
        if a and b:
            assert distances._by_bits([*map(ord, a)], [*map(ord, b)]) == want


def test_deletions_take_no_rounds(monkeypatch):
    """Each round of diagonals makes an array by np.full."""
    monkeypatch.setattr(distances.np, "full", lambda *_: 1 / 0)
    a = np.arange(30_000) % 7
    assert distances.distance(a, a[a != 3]) == int((a == 3).sum())
