"""Arrow files as a data source: round trips, pushed flags, commits; variant journals."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumflow.sources import arrow_source, readers, writers


@pytest.fixture
def flagged(spark):
    kind = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(300).select("id", F.when(F.col("id") != 7, F.concat(F.lit("t"), "id")).alias("text"), *[(kind == s).alias(s) for s in arrow_source.FLAGS]).repartition(2)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_round_trip_and_pushed_flag(spark, tmp_path, flagged):
    folder = str(tmp_path / "a")
    assert arrow_source.write_arrow(flagged, folder, {"lines": '{"type": "bbox"}'}) == 6
    assert sorted(map(tuple, arrow_source.read_arrow(spark, folder).collect())) == sorted(map(tuple, flagged.collect()))
    some = arrow_source.read_arrow(spark, folder, "text string, id long, train boolean").filter("train and id > 10")
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(11, 300) if i % 3 == 0]
    assert "EqualTo(train,true)" in plan(some).replace(" ", "")
    assert {tuple(r) for r in arrow_source.file_counts(spark, folder).collect()} == {("all", 6, 300), *((s, 2, 100) for s in arrow_source.FLAGS)}
    kinds = readers.decoded_metadata(spark, folder, "lines").select(F.variant_get("entry", "$.type", "string").alias("t"))
    assert [r["t"] for r in kinds.collect()] == ["bbox"] * 6


def test_only_wanted_files_and_batches_are_planned(tmp_path):
    folder = str(tmp_path)
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("n", pa.int64()), ("train", pa.bool_())])) as w:
        for k in range(6):
            w.write_batch(pa.record_batch({"n": [2 * k, 2 * k + 1], "train": [k == 4, None]}))
    source = arrow_source.ArrowFiles({"path": folder})
    reader = arrow_source.ShareReader(folder, source.schema(), 1)
    other = arrow_source.EqualTo(("n",), 3)
    assert list(reader.pushFilters([other, arrow_source.EqualTo(("train",), True), arrow_source.IsNotNull(("train",))])) == [other]
    shares = reader.partitions()
    assert [(s.first, s.last) for s in shares] == [(k, k + 1) for k in range(6)]
    assert [b.to_pydict() for s in shares for b in reader.read(s)] == [{"n": [8], "train": [True]}]
    (tmp_path / arrow_source.LIST).write_text(json.dumps({"name": "x.arrow", "bytes": 9, "batches": 6, "rows": 12, "flags": {"train": False}}) + "\n")
    assert [s.path for s in reader.partitions()] == [""]  # its flag leaves the file closed


def test_appended_overwritten_and_uncommitted(spark, tmp_path, flagged):
    folder = str(tmp_path / "a")
    arrow_source.write_arrow(flagged, folder)
    assert arrow_source.write_arrow(flagged.filter("id = 0").coalesce(1), folder, mode="append") == 7
    assert arrow_source.read_arrow(spark, folder).count() == 301
    (tmp_path / "a" / "part-lost.arrow").write_bytes(b"half a file of a lost task")
    assert arrow_source.read_arrow(spark, folder).count() == 301
    assert arrow_source.write_arrow(flagged.filter("id < 2").coalesce(1), folder) == 2
    assert sorted(r["id"] for r in arrow_source.read_arrow(spark, folder).collect()) == [0, 1]
    assert len(list((tmp_path / "a").glob("part-*-*.arrow"))) == 2


def test_null_flags_empty_tables_and_failing_tasks(spark, tmp_path):
    rows = [("a", None), ("b", True), (None, False), ("", None)]
    df = spark.createDataFrame(rows, "text string, train boolean").coalesce(1)
    assert arrow_source.write_arrow(df, str(tmp_path / "n")) == 3
    back = arrow_source.read_arrow(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    assert [r["text"] for r in back.filter("train").collect()] == ["b"] and back.filter("train is null").count() == 2 and back.filter("not train").count() == 1
    assert arrow_source.write_arrow(df.filter("text = 'none'"), str(tmp_path / "e")) == 0
    assert arrow_source.read_arrow(spark, str(tmp_path / "e"), "text string").count() == 0
    bad = spark.range(4).repartition(2).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).cast("string").alias("text"))
    with pytest.raises(Exception, match="no"):
        arrow_source.write_arrow(bad, str(tmp_path / "n"))
    assert arrow_source.read_arrow(spark, str(tmp_path / "n")).count() == 4


def test_columns_that_a_file_lacks_are_null(spark, tmp_path):
    arrow_source.write_arrow(spark.range(3).coalesce(1), str(tmp_path / "a"))
    got = arrow_source.read_arrow(spark, str(tmp_path / "a"), "id long, text string, train boolean")
    assert sorted(map(tuple, got.collect())) == [(i, None, None) for i in range(3)] and got.filter("train").count() == 0


def test_files_are_written_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([("a b.xml", "é\n"), ("c.xml", None)], "name string, body string").repartition(2)
    assert writers.write_files(df, str(tmp_path / "a folder"), "name", "body") == 2
    assert (tmp_path / "a folder" / "a b.xml").read_text() == "é\n" and (tmp_path / "a folder" / "c.xml").read_bytes() == b""


def test_variant_journal(spark, tmp_path):
    (tmp_path / "j").write_text('{"step": 1, "note": {"cer": 0.5}}\n\nno json\n{"step": "two"}\n')
    got = readers.typed(readers.read_journal_variant(spark, str(tmp_path / "j")), step="$.step int", cer="$.note.cer double").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0.5), (None, None), (None, None)]
