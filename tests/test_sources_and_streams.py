import json
import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from vellumflow.operators import corpus
from vellumflow.sources import readers, writers
from vellumflow.streaming import normalise

PAGE = """<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15">
  <Page imageFilename="{name}"><TextRegion>
    <TextLine id="a"><Coords points="1,2 30,4 30,20"/><TextEquiv><Unicode> Item </Unicode></TextEquiv></TextLine>
    <TextLine id="b"><Coords points="5,6 7,8"/></TextLine>
    <TextLine id="c"><Coords points="5,6 7,8"/><TextEquiv><Unicode>le roy</Unicode></TextEquiv></TextLine>
  </TextRegion></Page>
</PcGts>"""


def test_page_xml(spark, tmp_path):
    for name in ("FRAN_0021_1.jpg", "FRAN_0200_1.jpg"):
        (tmp_path / f"{name}.xml").write_text(PAGE.format(name=name))
    pages = readers.read_page_xml(spark, str(tmp_path))
    got = [(r["shelfmark"], r["text"], tuple(r["box"])) for r in pages.orderBy("file", "position").collect()]
    assert got == [("JJ207", "Item", (1, 2, 30, 20)), ("JJ207", "le roy", (5, 6, 7, 8)), ("JJ210", "Item", (1, 2, 30, 20)), ("JJ210", "le roy", (5, 6, 7, 8))]
    lines = readers.page_lines(pages, project="p", source_corpus="s")
    assert sorted(r["image_path"] for r in lines.collect()) == [f"himanis_{i:05d}.png" for i in range(4)]
    assert readers.list_files(spark, str(tmp_path), ".xml").count() == 2
    assert readers.latest_file(spark, str(tmp_path), ".xml").endswith("FRAN_0200_1.jpg.xml")


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "quoted", line\nand more', "i.png", "French", "14", "g", "p", "s"), ("b", "j.png", "French", "15", "h", "p", "s")]
    df = spark.createDataFrame(rows, corpus.SCHEMA)
    writers.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert sorted(map(tuple, readers.read_corpus_csv(spark, str(tmp_path / "c")).collect())) == sorted(rows)
    hashes = writers.file_hashes(spark, str(tmp_path / "c"))
    writers.write_manifest(spark, str(tmp_path / "MANIFEST.txt"), hashes, seed1=3, seed2=5, method="grouped")
    text = (tmp_path / "MANIFEST.txt").read_text()
    assert "seeds: 3, 5" in text and hashes.first()["sha256"] in text
    assert writers.write_pairs(df, str(tmp_path / "pairs")) == 2


def test_existing_files(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(b"x")
    df = spark.createDataFrame([("images/i.png",), ("images/j.png",)], "image_path string")
    there, gone = readers.existing(df, "image_path", readers.list_files(spark, str(tmp_path), ".png"))
    assert [r[0] for r in there.collect()] == ["images/i.png"] and [r[0] for r in gone.collect()] == ["images/j.png"]


def test_splits_journal_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "val")], "image_path string, split string")
    writers.write_splits(df, str(tmp_path / "s"))
    assert readers.read_parquet(spark, str(tmp_path / "s"), ["image_path"], split="val").first()[0] == "b"
    writers.write_compiled(df, str(tmp_path / "k"), "train", {"counts": {"all": 2}})
    assert readers.read_split(spark, str(tmp_path / "k"), "train").count() == 2 and readers.read_split(spark, str(tmp_path / "k"), "test").count() == 0
    for k in range(2):
        writers.append_journal(spark, str(tmp_path / "j"), {"step": "é", "k": k, f"only_{k}": 1})
    journal = readers.read_journal(spark, str(tmp_path / "j"))
    assert journal.count() == 2 and {"only_0", "only_1"} <= set(journal.columns) and journal.first()["step"] == "é"
    writers.write_json_document(spark, str(tmp_path / "d.json"), {"progression": {"1": 0.5}})
    assert json.loads((tmp_path / "d.json").read_text())["progression"]["1"] == 0.5
    assert readers.read_json_document(spark, str(tmp_path / "d.json"), None).count() == 1


def test_arrow_files(spark, tmp_path):
    table = pa.table({"text": ["a", "b"], "train": [True, False]}).replace_schema_metadata({"lines": '{"counts": 2}'})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert sorted(map(tuple, readers.read_arrow_files(spark, str(tmp_path), "text string, train boolean").collect())) == [("a", True), ("b", False)]
    assert tuple(readers.arrow_metadata(spark, str(tmp_path)).select("key", "value").first()) == ("lines", '{"counts": 2}')
    raw = writers.arrow_bytes(spark.createDataFrame([("z",)], "t string").coalesce(1), {"k": "v"}).first()["content"]
    assert pa.ipc.open_file(pa.py_buffer(bytes(raw))).read_all().to_pydict() == {"t": ["z"]}


def test_crops_and_tei_files(spark, tmp_path):
    df = spark.createDataFrame([({"height": 2, "width": 3, "data": bytearray(b"abcdef")}, {"x0": 1, "y0": 0, "x1": 9, "y1": 1})], "image struct<height:int,width:int,data:binary>, box struct<x0:int,y0:int,x1:int,y1:int>")
    cut = writers.crops(df).first()["crop"]
    assert (cut["height"], cut["width"], bytes(cut["data"])) == (1, 2, b"bc")
    documents = [("d1", "<TEI>é</TEI>"), ("d2", "<TEI>\n  two lines\n</TEI>\n")]
    made = spark.createDataFrame(documents, "id string, tei string")
    writers.write_tei(made, str(tmp_path / "t"), "id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == documents  # line breaks stay
    assert writers.write_tei_files(made, str(tmp_path / "f"), "id") == 2
    assert [(tmp_path / "f" / f"{i}.xml").read_text() for i, _ in documents] == [d for _, d in documents]


def test_numbered_png_crops(spark, tmp_path):
    schema = "n int, image struct<height:int,width:int,data:binary>, box struct<x0:int,y0:int,x1:int,y1:int>"
    image = {"height": 2, "width": 3, "data": bytearray(b"abcdef")}
    df = spark.createDataFrame([(2, image, {"x0": 1, "y0": 0, "x1": 9, "y1": 2}), (1, image, {"x0": 0, "y0": 1, "x1": 1, "y1": 2}), (3, image, {"x0": 3, "y0": 0, "x1": 3, "y1": 2})], schema)
    rows = writers.numbered_crops(df, ["n"]).orderBy("name").collect()
    assert [(r["n"], r["name"]) for r in rows] == [(1, "line_00000.png"), (2, "line_00001.png"), (3, "line_00002.png")] and rows[2]["png"] is None
    assert writers.write_files(writers.numbered_crops(df, ["n"]).filter("png is not null"), str(tmp_path / "c"), "name", "png") == 2
    raw, at, chunks = (tmp_path / "c" / "line_00001.png").read_bytes(), 8, {}
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        chunks[kind] = raw[at + 8 : at + 8 + size]
        assert struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + chunks[kind])
        at += 12 + size
    assert list(chunks) == [b"IHDR", b"IDAT", b"IEND"] and struct.unpack(">IIBBBBB", chunks[b"IHDR"]) == (2, 2, 8, 0, 0, 0, 0)
    assert zlib.decompress(chunks[b"IDAT"]) == b"\0bc\0ef"


def test_pairs_skip_missing_images(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(b"x")
    df = spark.createDataFrame([("images/i.png", "one"), ("images/j.png", "two")], "image_path string, text string")
    assert writers.write_pairs(df, str(tmp_path / "p"), files=readers.list_files(spark, str(tmp_path), ".png")) == 1
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [("i", "images/i.png", "one")]


def test_arrow_files_are_written(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "concat('t', id) AS text").repartition(2)
    assert writers.write_arrow(df, str(tmp_path / "a"), {"lines": '{"counts": 10}'}) == 2
    assert sorted(map(tuple, readers.read_arrow_files(spark, str(tmp_path / "a"), "id long, text string").collect())) == [(i, f"t{i}") for i in range(10)]
    assert {(r["key"], r["value"]) for r in readers.arrow_metadata(spark, str(tmp_path / "a")).collect()} == {("lines", '{"counts": 10}')}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("uoir", 1), ("  ", 2), ("le roy", 3)]
    df = spark.createDataFrame(rows, "text string, k int").withColumn("ts", F.timestamp_seconds(F.col("k") * 1000))
    df.write.parquet(str(tmp_path / "in"))
    stream = normalise.normalise_stream(readers_stream(spark, tmp_path, df.schema))
    normalise.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("text", "normalized", "changed").collect()))
    assert got == sorted(map(tuple, normalise.normalise_stream(df).select("text", "normalized", "changed").collect())) == [("le roy", "le roy", False), ("uoir", "voir", True)]
    windows = normalise.windowed_changes(normalise.normalise_stream(readers_stream(spark, tmp_path, df.schema)), "ts")
    query = windows.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("n"), F.sum("n_changed")).first()[:] == (2, 1)


def readers_stream(spark, tmp_path, schema):
    return normalise.read_text_stream(spark, str(tmp_path / "in"), schema)
