"""The shared folder, what is left in it, and both sides of the size check of broadcasts."""

from pathlib import Path

import pytest

from vellumflow.llm import components, mixing, near_duplicates, shared, token_files


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_local_masters_may_use_a_temporary_folder(master):
    assert Path(shared.local_folder(master)).is_dir()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_other_masters_must_name_a_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.local_folder(master)


def test_nothing_is_left_behind(spark):
    docs = spark.createDataFrame([(1, "some words here", "a"), (2, "some words here", "b")], "doc_id long, text string, source string")
    assert near_duplicates.near_duplicates(docs).count() == 2 and mixing.mix_ledger(docs).count() == 2
    folder = Path(shared.own_folder(spark).removeprefix("file://"))
    assert list(folder.iterdir())
    shared.forget_all(spark)
    assert not folder.exists()
    assert mixing.mix(docs).count() >= 0  # the folder is made anew


def test_batch_size_is_the_session_s_again(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), shared.text_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        raise RuntimeError
    assert spark.conf.get(key) == before


def test_shuffled_joins_give_the_same_rows(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.new_path(spark, "token-files")

    def results():
        tokens = token_files.read_tokens(spark, folder).collect()
        return [sorted(map(str, r)) for r in (near_duplicates.near_duplicates(docs).collect(), mixing.mix_ledger(docs).collect(), mixing.mix(docs).select("doc_id").collect(), tokens)]

    from vellumflow.llm.tokens import default_tokenizer

    token_files.write_tokens(docs, folder, default_tokenizer())
    want = results()
    real = shared.small
    for module in (near_duplicates, mixing, token_files, components):
        monkeypatch.setattr(module, "small", lambda df, row_bytes, most=0: real(df, row_bytes, 0 if df.count() else 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert results() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
