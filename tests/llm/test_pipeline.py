"""The pipeline's stages against their operators' verdicts, in plain Python."""

from collections import Counter

import pytest
from test_ngram_join import brute_kept

import corpus_pipeline
from vellumflow.llm import mixing, quality_classifier, quality_rules
from vellumflow.llm.tokens import PieceCache, default_tokenizer


def test_stages(spark, sf_dir, monkeypatch):
    """What ``run`` hands from stage to stage, each held against plain Python on the stage's own input."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "near-duplicates", "mixing", "packing"]
    given = {}

    def watched(name, stage):
        return name, lambda spark, at, sf: (given.update({name: at}), stage(spark, at, sf))[1]

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, sf_dir)
    scores = {r["doc_id"]: r["predicted"] for r in quality_classifier.score_documents(docs, quality_classifier.fit_quality(docs, labels)).collect()}
    keeps = [
        lambda d: {r["doc_id"]: 1 for r in d.collect() if scores[r["doc_id"]]},
        lambda d: {r["doc_id"]: 1 for r in quality_rules.rule_ledger(d).filter(quality_rules.passes("v1")).collect()},
        lambda d: dict.fromkeys(brute_kept([(r["doc_id"], r["text"]) for r in d.collect()]), 1),  # all pairs of five-word shingles
        lambda d: {r["doc_id"]: r["copies"] for r in mixing.mix_ledger(d).collect() if r["copies"]},
    ]
    for name, following, keep in zip(names, names[1:], keeps, strict=False):
        assert given[following].columns == docs.columns, name
        assert Counter(r["doc_id"] for r in given[following].collect()) == Counter(keep(given[name])), name
    tokens, want, got = PieceCache(default_tokenizer()), Counter(), Counter()
    for r in given["packing"].collect():
        want[r["doc_id"]] += len(tokens.encode(r["text"])) // 2 + 1
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


LONG, PLAIN = "long text " * 20000, " ".join(f"word{i} of it" for i in range(80))


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_extra_columns_and_all_kinds_of_rows(spark, sf_dir, k):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, names that clash."""
    name, stage = corpus_pipeline.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, measured string, quality_score double, copy int, row_hash long, rule_ledger int, sequence_id int, mix_rate int"
    rest = ("m", 0.1, 2, 3, 4, 5, 6)
    rows = [(1, PLAIN, "en", None, 1, *rest), (None,) * 12, (4, LONG, "en", "s", 5, *(None,) * 7), (5, "", "en", "s", 0, *rest)] * 2
    df = spark.createDataFrame(rows, schema)
    assert stage(spark, df.limit(0), sf_dir).collect() == []
    out = stage(spark, df, sf_dir)
    if name == "packing":
        tokens, want = PieceCache(default_tokenizer()), Counter()
        for r in rows:
            want[r[0]] += len(tokens.encode(r[1] or "")) // 2 + 1
        got = Counter()
        for r in out.collect():
            got[r["doc_id"]] += r["length"]
        assert got == want
        return
    assert out.columns == df.columns
    kept = Counter(map(tuple, out.collect()))
    assert set(kept) <= set(rows)
    if name == "quality rules":  # the long text repeats itself, the others have too few words
        assert kept == {rows[0]: 2}
    if name == "near-duplicates":  # a null and an empty text are one group, with one id
        assert kept == {rows[0]: 1, rows[2]: 1, rows[3]: 1}
    if name == "mixing":
        ledger = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.mix_ledger(df).collect()}
        assert kept == Counter({r: n for r in rows[:4] if (n := 2 * ledger[r[0], r[3], len((r[1] or "").split())])})
