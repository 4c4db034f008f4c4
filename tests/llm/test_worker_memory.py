"""What the near-duplicate stage holds in executors and workers: no columns broadcast, one stage's caches at a time."""

import random

from vellumflow.llm import ngram_join, shared
from vellumflow.llm.tokens import default_tokenizer, piece_cache


def test_columns_are_shuffled_not_broadcast(spark, monkeypatch):
    rng, plans = random.Random(4), {}
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    rows = [(k, " ".join([*t[: 60 - c], *(f"n{k}" for _ in range(c))])) for k, (t, c) in enumerate((t, c) for t in texts for c in (0, 1, 2))]
    rows += [(0, rows[0][1])] * 3 + [(99, rows[3][1]), (100, None)]  # rows that are alike in all, a copy, no words
    real = shared.Scratch.written
    monkeypatch.setattr(shared.Scratch, "written", lambda self, df, kind: [plans.setdefault(kind, df._jdf.queryExecution().executedPlan().toString()), real(self, df, kind)][1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - k % 3 for k in range(60)} | {99: 3, 100: 100}
    assert "LeftSemi" in plans["incidence"] and "BroadcastHashJoin [key" not in plans["incidence"] and "BroadcastHashJoin [key" not in plans["others"]


def test_incidence_has_a_node_once(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g i"), (3, "a b c d e f g i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = ngram_join.with_row_hash(docs, "row_hash", *docs.columns)
    sets = ngram_join.measured(hashed, "row_hash", "doc_id", "text")
    with shared.Scratch(spark) as scratch:
        met = ngram_join.incidence(sets, scratch).collect()
    pairs = [(r["key"], r["node"]) for r in met]
    assert pairs and len(pairs) == len(set(pairs)) and len({n for _, n in pairs}) == 2


def test_a_worker_keeps_one_stage_s_caches():
    tokens = piece_cache(default_tokenizer(), 1000)
    tokens.encode("some words")
    assert piece_cache(default_tokenizer(), 1000) is tokens
    found = ngram_join.ngrams(b"some more words")
    assert list(shared._kept) == [("word hashes",)]
    assert piece_cache(default_tokenizer(), 1000) is not tokens and list(shared._kept) == [("pieces", default_tokenizer(), 1000)]
    assert ngram_join.ngrams(b"SOME more  words").tolist() == found.tolist()
