"""The join by n-grams, and the pipeline's near-duplicate stage that rests on it, against all pairs of texts."""

import random

import corpus_pipeline
import pytest
from vellumflow.llm import near_duplicates, ngram_join, shared


def sets_of(text):
    words = (text or "").encode().lower().split()  # A-Z alone, ASCII white space
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """For each row the smallest id of its component by all pairs with a coefficient of 0.8 or more; texts without words are alike."""
    sets, parent = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        lowest[find(i)] = min(lowest.get(find(i), d), d)
    return [lowest[find(i)] for i in range(len(rows))]


def brute_kept(rows):
    return sorted(set(brute_components(rows)))


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, ngram_join.ngram_components(df).collect()), key=str)


def brute_joined(rows):
    found = zip(rows, brute_components(rows), strict=True)
    return sorted(((d, len(sets_of(t)), c if sets_of(t) else d) for (d, t), c in found), key=str)


def copies(rng, n, rate, words):
    """Texts and their copies near the threshold, on both sides."""
    out = []
    for _ in range(n):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(*words))]
        for r in (0, rate, rate / 2):
            out.append(" ".join(f"n{rng.randrange(10**6)}" if rng.random() < r else w for w in text))
    rng.shuffle(out)
    return list(enumerate(out))


def stage_kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in corpus_pipeline.deduplicate(spark, df, "").collect())


def test_links_all_pairs_near_the_threshold(spark):
    rows = copies(random.Random(4), 150, 0.025, (4, 300))
    assert stage_kept(spark, rows) == brute_kept(rows)


def test_join_links_all_pairs_near_the_threshold(spark):
    rows = copies(random.Random(6), 120, 0.03, (1, 200))
    assert joined(spark, rows) == brute_joined(rows)


def frequent_rows(rng):
    """A group of near copies, few of which link, and texts that share a passage with all of them."""
    text = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(f"n{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in text)) for k in range(200)]
    rows += [(1000 + k, " ".join([*text[:60], *(f"n{rng.randrange(10**6)}" for _ in range(40))])) for k in range(100)]
    return rows + [(2000 + k, " ".join([*text[:20], f"m{k}", *text[21:30]])) for k in range(60)]


def test_links_all_pairs_at_frequent_ngrams(spark):
    rows = frequent_rows(random.Random(5))
    assert stage_kept(spark, rows) == brute_kept(rows)
    assert joined(spark, rows) == brute_joined(rows)


def test_join_is_the_same_when_every_join_is_shuffled(spark, monkeypatch):
    rows = frequent_rows(random.Random(7)) + [(5000 + k, "the same words in each of these rows") for k in range(50)]
    monkeypatch.setattr(ngram_join, "small", lambda df, row_bytes, most=0: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert joined(spark, rows) == brute_joined(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_edges(spark):
    """Null and repeated ids, null, empty and short texts, ties, a very long text, upper case."""
    long = " ".join(f"w{k % 5000}x{k // 7}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " end"), (9, "\xc4 b c d e f"), (10, "\xe4 b c d e f"), (11, "one two"), (11, "one two"), (12, None)]
    assert joined(spark, rows) == brute_joined(rows)
    got = joined(spark, [*rows, (None, "one two"), (None, "nobody else says this")])
    assert (None, 1, 4) in got and (None, 1, None) in got
    assert joined(spark, []) == []


def test_join_ignores_further_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 8), (2, "a b c", 9, 10)], "doc_id long, text string, node long, row_hash long")
    assert sorted(map(tuple, ngram_join.ngram_components(df).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_join_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert joined(spark, rows) == brute_joined(rows)


def test_scratch_tables_are_deleted(spark):
    with pytest.raises(RuntimeError), shared.Scratch(spark) as scratch:
        table = scratch.written(spark.range(3), "some")
        assert table.count() == 3
        raise RuntimeError
    at, files = shared._path(spark, scratch.paths[0])
    assert not files.exists(at)


def test_unrelated_groups_with_one_smallest_id_both_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[0] + " end"), (3, texts[1] + " end")], "doc_id long, text string")
    assert sorted(r["text"] for r in near_duplicates.drop_near_duplicates(df).collect()) == texts


def test_of_repeated_rows_one_stays(spark):
    """10^4 rows that are alike, near copies of them, and a repeated row that nothing is like."""
    text = " ".join(f"w{k}" for k in range(60))
    many = spark.range(10_000).selectExpr("7L AS doc_id", f"'{text}' AS text", "'x' AS more")
    rest = spark.createDataFrame([(8, text + " end", "y"), (9, "alone here", None), (9, "alone here", None), (None, text + " end now", "z")], "doc_id long, text string, more string")
    got = near_duplicates.drop_near_duplicates(many.unionByName(rest)).collect()
    assert sorted(map(tuple, got)) == [(7, text, "x"), (9, "alone here", None)]


def test_fingerprints_only_propose(spark):
    """Texts with one fingerprint and nothing in common stay apart; equal prints are candidates."""
    printed = spark.createDataFrame([(1, 5), (2, 5), (9, 5), (3, 7), (4, 0x0F0F0F0F0F0F0F0F)], "node long, print long")
    assert sorted(map(tuple, near_duplicates.close_nodes(printed).collect())) == [(2, 1), (3, 1), (9, 1)]


def test_stage_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert stage_kept(spark, rows) == brute_kept(rows)
