"""Names paired by blocks, graph documents by tasks, splits by ranks, numbers kept by a filter."""

import hashlib
import math
import xml.etree.ElementTree as ET
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import corpus, entities


def pairs(rows):
    pages = {}
    for page, name in rows:
        if page is not None and name is not None:
            pages.setdefault(page, set()).add(name)
    return Counter(p for names in pages.values() for p in combinations(sorted(names), 2))


@pytest.mark.parametrize("block", [2, 5, 256])
def test_pairs_by_blocks(spark, block):
    rows = [(p, f"n{(p * 7 + k * k) % 23}") for p in range(6) for k in range(3 * p)] + [(1, None), (None, "x"), (9, "alone"), (2, ""), (2, "")]
    got = entities.cooccurrences(spark.createDataFrame(rows, "text_idx int, word string"), block=block)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == pairs(rows)


def test_no_names_no_pairs(spark):
    assert entities.cooccurrences(spark.createDataFrame([], "text_idx int, word string")).count() == 0


def test_one_page_of_many_names(spark):
    names = spark.range(2000).select(F.lit(1).alias("text_idx"), F.format_string("n%05d", "id").alias("word"))
    got = entities.cooccurrences(names).agg(F.count("*"), F.sum("n"), F.count_if(F.col("a") >= F.col("b"))).first()
    assert tuple(got) == (math.comb(2000, 2), math.comb(2000, 2), 0)


def test_graph_document_in_parts(spark, tmp_path):
    edges = spark.createDataFrame([("a & \"b\"", "c<\n>", 2), ("a & \"b\"", "d", 1)], "a string, b string, n long")
    entities.write_gexf(edges, str(tmp_path / "g"))
    whole = "".join(f.read_text() for f in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(whole)
    assert [x.get("label") for x in root.findall(".//{*}node")] == ["a & \"b\"", "c<\n>", "d"]
    assert [(x.get("source"), x.get("target"), x.get("weight")) for x in root.findall(".//{*}edge")] == [("0", "1", "2"), ("0", "2", "1")]
    assert root.find("{*}graph") is not None
    entities.write_gexf(edges.limit(0), str(tmp_path / "e"))
    assert ET.fromstring("".join(f.read_text() for f in sorted((tmp_path / "e").glob("part-*")))).findall(".//{*}node") == []


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize(("n", "test", "val"), [(0, 0.15, 0.15), (1, 0.15, 0.15), (2, 0.15, 0.15), (333, 0.15, 0.15), (40, 0.0, 0.5), (40, 0.5, 0.0), (40, 1.0, 0.0), (40, 0.3, 0.7)])
def test_split_by_ranks(spark, n, test, val):
    names = [f"g{i}" for i in range(n)]
    df = spark.createDataFrame([(g,) for g in names * 2] + [(None,)], "g string")
    got = {r["group"]: r["split"] for r in corpus.group_split(df, "g", test=test, val=val).collect()}
    held = sorted(names, key=lambda g: (md5(42, g), g))[: math.ceil(test * n)]
    rest = sorted(set(names) - set(held), key=lambda g: (md5(42, "val", g), g))
    share = val / (1 - test) if test < 1 else 0
    want = {g: "train" for g in names} | {g: "val" for g in rest[: math.ceil(share * len(rest))]} | {g: "test" for g in held}
    assert got == want


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_rank_over_rounds_and_equal_hashes(spark, few):
    rows = [(md5(i % 60)[:4], f"t{i:03d}") for i in range(300)]
    df, order = spark.createDataFrame(rows, "h string, t string"), sorted(rows)
    for k in (1, 2, 5, 6, 150, 299, 300):
        assert corpus.kth_smallest(df, "h", "t", k, digits=1, few=few) == order[k - 1]
    assert corpus.kth_smallest(df, "h", "t", 301, few=few) is None and corpus.kth_smallest(df, "h", "t", 0, few=few) is None


def test_split_has_no_window(spark):
    df = spark.range(500).select(F.concat(F.lit("g"), "id").alias("g"))
    assert "Window" not in corpus.group_split(df, "g")._jdf.queryExecution().toString()


def test_numbers_outlive_the_filter(spark):
    df = spark.createDataFrame([(3, "fr"), (1, "en"), (2, "fr"), (0, None)], "id int, lang string").repartition(3)
    kept = corpus.with_image_path(corpus.with_source_index(df, ["id"], F.col("lang") == "fr"))
    assert sorted((r["id"], r["source_idx"], r["image_path"]) for r in kept.collect()) == [(2, 2, "images/ligne_2.png"), (3, 3, "images/ligne_3.png")]
