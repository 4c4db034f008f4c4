"""op1 and op4 against brute force."""

import random
from itertools import product

import numpy as np
import pytest
import xxhash

from vellumflow.llm import kd_search, near_duplicates
from vellumflow.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def brute_top_k(rows, k, every):
    out = []
    for q, a in rows:
        if q % every:
            continue
        scores = sorted((-sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_top_k_matches_brute_force_with_ties(spark, shards):
    rng = np.random.default_rng(1)
    vectors = np.vstack([rng.normal(size=(150, 8)), np.repeat(rng.normal(size=(1, 8)), 80, 0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 1.0) for i, v in enumerate(vectors)], VECTORS)
    got = kd_search.top_k(df, k=7, every=10, leaf=8, shard_rows=-(-len(vectors) // shards))
    rows = [(i, np.floor(64 * v.astype(np.float64)).astype(int)) for i, v in enumerate(vectors)]
    assert sorted(map(tuple, got.collect())) == brute_top_k(rows, 7, 10)


def clustered(rng, clusters, each, width):
    centres = rng.normal(size=(clusters, width))
    centres *= 8 / np.linalg.norm(centres, axis=1)[:, None]
    return (np.repeat(centres, each, 0) + 0.05 * rng.normal(size=(clusters * each, width))).astype(np.float32)


def test_boxes_drop_shards_before_anything_is_sent(spark):
    """On clustered vectors a query goes to few of the other shards, and the result is still exact."""
    vectors = clustered(np.random.default_rng(4), 16, 60, 12)
    df = spark.createDataFrame([(i, v.tolist(), 0, 1.0) for i, v in enumerate(vectors)], VECTORS)
    sent = {}
    real = kd_search.asked_shards
    try:
        kd_search.asked_shards = lambda *a: sent.setdefault("asked", real(*a))
        got = kd_search.top_k(df, k=5, every=10, leaf=8, shard_rows=60)
        rows = [(i, np.floor(64 * v.astype(np.float64)).astype(int)) for i, v in enumerate(vectors)]
        assert sorted(map(tuple, got.collect())) == brute_top_k(rows, 5, 10)
    finally:
        kd_search.asked_shards = real
    queries, shards = len(vectors) // 10, 16
    assert sent["asked"].count() < 0.2 * queries * (shards - 1)


def test_kth_score_prunes_subtrees():
    """Best first opens a small part of the nodes and finds the same as a look at all; a score from elsewhere prunes from the start."""
    rng = np.random.default_rng(6)
    points = np.floor(64 * clustered(rng, 32, 100, 10).astype(np.float64)).astype(np.int64)
    tree = kd_search.Tree.build(points, np.arange(len(points)), 16)
    assert (tree.span[tree.child == 0][:, 1] - tree.span[tree.child == 0][:, 0]).max() <= 16
    q, own = points[::50], np.arange(len(points))[::50]
    args = tree, tree.points, tree.low, tree.high, q, own
    best, ids, opened = kd_search.best_first(*args, np.full(len(q), kd_search.NONE), 10)
    score = q @ points.T
    score[np.arange(len(q)), own] = kd_search.NONE
    order = np.lexsort((np.broadcast_to(np.arange(len(points)), score.shape), -score), axis=1)[:, :10]
    assert (ids == order).all() and (best == np.take_along_axis(score, order, 1)).all()
    assert opened < 0.25 * len(q) * len(tree.child)
    again = kd_search.best_first(*args, best[:, -1], 10)
    assert (again[1] == ids).all() and again[2] <= opened
    beyond = kd_search.best_first(*args, best[:, 0] + 1, 10)
    assert (beyond[0] == kd_search.NONE).all() and beyond[2] < opened


def test_copies_of_one_vector_and_id_are_dealt_out(spark):
    """A third of the rows have one vector, another third one id."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(5000, [float(i), 0.0]) for i in range(400)] + [(1000 + i, rng.normal(size=2).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], VECTORS)
    seen = {}
    real = kd_search.sharded_points
    try:
        kd_search.sharded_points = lambda *a: seen.setdefault("s", real(*a))
        got = kd_search.top_k(df, k=3, every=100, shard_rows=50, leaf=8)
    finally:
        kd_search.sharded_points = real
    once = {i: np.floor(64 * np.float32(v).astype(np.float64)).astype(int) for i, v in reversed(rows)}
    assert sorted(map(tuple, got.collect())) == brute_top_k(sorted(once.items()), 3, 100)
    assert max(r["count"] for r in seen["s"].groupBy("shard").count().collect()) < 150


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (20, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (6, [])]
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], VECTORS)
    got = sorted(map(tuple, kd_search.top_k(df, k=20, every=20).collect()))
    # a short vector counts as filled with zeros, a repeated id once
    assert got == [(0, 1, 20, 4096), (0, 2, 1, 2048), (0, 3, 6, 0), (20, 1, 0, 4096), (20, 2, 1, 2048), (20, 3, 6, 0)]
    assert kd_search.top_k(df.limit(0)).collect() == []
    assert kd_search.top_k(df.filter("vec_id = 0")).collect() == []


def test_unions_cover_every_spread_of_four_bits():
    for spread in product(range(5), repeat=6):
        if sum(spread) <= 4:
            assert min(sum(spread[p] for p in u) for u in near_duplicates.UNIONS) <= 1


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", "   \n", "one", "A b C", "a b c d", "Été ÉTÉ " * 9, "x y z w " * 40 + "end"])
def test_fingerprint(text):
    assert near_duplicates.fingerprint(text.encode()) == brute_fingerprint(text)


def prints_with_copies(rng):
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:30]:
        for _ in range(6):  # chains too: each copy from the last one
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.append(p)
    hot = rng.getrandbits(64)
    prints += [hot ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(400)]
    hot = rng.getrandbits(64)  # a dense anchor of texts that are linked to few of the others
    prints += [hot ^ sum(1 << b for b in rng.sample(range(33, 64), 12)) for _ in range(300)]
    return sorted(set(prints))


@pytest.mark.parametrize("run_length", [near_duplicates._RUN, 40, 3])
def test_links_lose_nothing(spark, run_length):
    prints = prints_with_copies(random.Random(3))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "print long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if run_length > 40 else 25)
    links = near_duplicates.print_links(df, run_length=run_length)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in links.collect())
    found = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components(prints)
    got = [found.get(s, s) for s in signed]
    names = {}
    for w, g in zip(want, got, strict=True):
        assert names.setdefault(w, g) == g
    assert len(set(names.values())) == len(names)


def test_near_duplicates_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    want = [(r["doc_id"], f"{p:016x}", rows[c]["doc_id"]) for r, p, c in zip(rows, prints, brute_components(prints), strict=True)]
    assert sorted(map(tuple, near_duplicates.near_duplicates(docs).collect())) == want


def test_anchors_cover():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for u in range(len(near_duplicates.UNIONS)):
        x, near, homes = near_duplicates.projected(prints, u), [set() for _ in prints], {}
        for rows, anchor, home in near_duplicates.anchors(prints, u):
            for r, a in zip(rows.tolist(), anchor.tolist(), strict=True):
                assert a not in near[r] and (int(x[r]) ^ a).bit_count() <= (1 if home else 2)
                near[r].add(a)
                if home:
                    homes[r] = a
        places = [f + k for p in near_duplicates.UNIONS[u] for f, n in [near_duplicates.PARTS[p]] for k in range(n)]
        for r in range(0, 200, 20):  # every text one flip away has this home among its anchors
            for place in places:
                other = prints[r : r + 1] ^ np.uint64(1 << place)
                assert homes[r] in {int(a[0]) for _, a, _ in near_duplicates.anchors(other, u) if len(a)}


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, print long, component_id long"
    rows = [(5, None), (3, ""), (3, ""), (None, "alpha beta gamma delta"), (9, "ALPHA beta gamma delta"), (None, "lonely words here now"), (7, "word " * 30000)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, 2) for i, t in rows], schema)
    got = sorted(map(str, [tuple(r) for r in near_duplicates.near_duplicates(df).select("doc_id", "component_id").collect()]))
    assert got == sorted(map(str, [(5, 3), (3, 3), (3, 3), (None, 9), (9, 9), (None, None), (7, 7)]))
    kept = near_duplicates.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == sorted(map(str, [3, 9, None, 7]))
    assert near_duplicates.near_duplicates(df.limit(0)).collect() == []
    assert near_duplicates.drop_near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (5, 5)], "a long, b long")
    got = dict(map(tuple, components(df).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
