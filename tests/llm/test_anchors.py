"""Fingerprints at their anchors."""

import random

from vellumflow.llm import near_duplicates


def test_copies_go_to_homes_only(spark):
    rng = random.Random(4)
    far = [rng.getrandbits(64) for _ in range(3000)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), k % 5)) for k, x in enumerate(far[:600])]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in far + near})
    prints = spark.createDataFrame([(x,) for x in signed], "print long")
    assert near_duplicates.replicated(prints).count() < 15 * len(signed)  # 100 each with the anchors that are nobody's home
    links = {(r["a"], r["b"]) for r in near_duplicates.print_links(prints).collect()}
    want = {(max(p), min(p)) for x, y in zip(far, near) if x != y for p in [[v - (1 << 64) if v >> 63 else v for v in (x, y)]]}
    assert want <= links and all((a ^ b).bit_count() <= 4 or ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)


def test_no_fingerprints(spark):
    assert near_duplicates.print_links(spark.createDataFrame([], "print long")).isEmpty()
