"""Pages of few pairs walked by one task, crowded ones in rounds: the same pairs."""

import random

import pytest

from vellumflow.operators import matching


@pytest.mark.parametrize("crowded", [0, 40, 10_000])
def test_walk_and_rounds_agree(spark, monkeypatch, crowded):
    rng, written = random.Random(9), []
    rows = list({(p, f"t{rng.randrange(12)}", f"q{rng.randrange(12)}"): rng.choice([0.25, 0.5, 0.5, 0.75]) for p in ("a", "b", "c") for _ in range(20 if p == "a" else 70)}.items())
    pairs = spark.createDataFrame([(*k, v) for k, v in rows], "page string, truth string, pred string, iou double").repartition(3)
    used, want = set(), set()
    from hashlib import md5

    for (p, t, q), v in sorted(rows, key=lambda r: (-r[1], md5(f"{r[0][1]}:{r[0][2]}".encode()).hexdigest(), r[0][1:])):
        if not {(p, "t", t), (p, "q", q)} & used:
            used |= {(p, "t", t), (p, "q", q)}
            want.add((p, t, q, v))
    cut = matching.cut
    monkeypatch.setattr(matching, "cut", lambda df, kind: (written.append(kind), cut(df, kind))[1])
    assert set(map(tuple, matching.one_to_one(pairs, crowded=crowded).collect())) == want
    assert written == ["pairs", "crowded", "matched"] if crowded == 10_000 else len(written) > 4
