"""What the n-gram join sends between tasks: pairs once, rows without parities, shuffles that end with their query."""

import random

import numpy as np

from vellumflow.llm import ngram_join, shared


def test_wide_parities_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(3)
    for n, m, both in [(0, 0, 0), (1, 0, 0), (1, 1, 1), (64, 65, 60), (500, 610, 480), (3000, 2600, 2500), (9000, 300, 300), (40_000, 40_000, 39_900)]:
        found = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        x, y = found[:n], found[n - both :]
        apart = ngram_join.least_apart(*map(ngram_join.wide_parities, (x, y)))
        assert apart <= n + m - 2 * both and apart == ngram_join.least_apart(*map(ngram_join.wide_parities, (y, x)))
    found = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)  # nothing in common: beyond what links may differ in
    assert 9 * ngram_join.least_apart(*map(ngram_join.wide_parities, (found[:20_000], found[20_000:]))) > 40_000


def test_pairs_with_a_column_s_lead_are_looked_at_once(spark, monkeypatch):
    rng, found, real = random.Random(8), [], ngram_join.cross_pairs
    rows = []
    for k in range(30):  # two texts with a coefficient just under 0.8, so that bounds leave the pair
        text = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[:88], *(f"n{rng.randrange(10**6)}" for _ in range(12))]))]
    monkeypatch.setattr(ngram_join, "cross_pairs", lambda *a: [found.append(out := real(*a)), found.append(out.count())] and out)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d for d, _ in rows}
    assert found[1] == 0


def test_shuffle_files_go_with_their_query(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = shuffled()
    table = shared.written(spark.range(10_000).selectExpr("id % 700 AS k").groupBy("k").count(), "sums")
    assert not shuffled() - before
    assert table.count() == 700 and spark.conf.get(shared.SHUFFLES_END) == "false"
