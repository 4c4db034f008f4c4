import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.functions import distances, metrics
from vellumflow.operators import contract, corpus, stats, topics


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("o")).first()["o"]


@pytest.mark.parametrize(("pred", "gold", "want"), [("abc", "", 0.0), ("", "", 0.0), ("é", "e", 1.0), ("abcd", "abc", 1 / 3), ("xxxx", "a", 4.0)])
def test_cer(spark, pred, gold, want):
    assert math.isclose(one(spark, metrics.cer(F.col("p"), F.col("g")), p=pred, g=gold), want)


@pytest.mark.parametrize(("pred", "gold", "want"), [("a b c", "a b c", 0.0), ("", "a b", 1.0), ("a x c d", "a b c", 2 / 3), ("a", "", 0.0), ("b a", "a b", 1.0)])
def test_wer(spark, pred, gold, want):
    assert math.isclose(one(spark, metrics.wer(F.col("p"), F.col("g")), p=pred, g=gold), want)


def test_boxes(spark):
    df = spark.sql("SELECT array(struct(1 AS x, 2 AS y), struct(30 AS x, 4 AS y), struct(30 AS x, 20 AS y)) AS p, 25 AS w, 100 AS h")
    assert tuple(df.select(metrics.bbox(F.col("p")).alias("b")).first()["b"]) == (1, 2, 30, 20)
    assert tuple(df.select(metrics.clip(metrics.bbox(F.col("p")), F.col("w"), F.col("h")).alias("b")).first()["b"]) == (1, 2, 25, 20)
    boxes = spark.sql("SELECT named_struct('x0',0,'y0',0,'x1',10,'y1',10) AS a, named_struct('x0',5,'y0',0,'x1',15,'y1',10) AS b")
    assert math.isclose(boxes.select(metrics.box_iou(F.col("a"), F.col("b")).alias("i")).first()["i"], 1 / 3)


def test_mcnemar(spark):
    df = spark.createDataFrame([(1, 0)] * 12 + [(0, 1)] * 3 + [(1, 1)] * 7, "a int, b int")
    a, b = F.col("a") == 1, F.col("b") == 1
    assert tuple(metrics.mcnemar(df, a, b).first()) == (12, 3, 81 / 15)
    assert tuple(metrics.mcnemar(df, a, b, correction=True).first()) == (12, 3, 64 / 15)
    assert tuple(metrics.mcnemar(df.limit(0), a, b).first()) == (0, 0, 0.0)
    assert metrics.chi2_p(38.25) < 0.001 and metrics.chi2_p(0) == 1.0


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(400)], "i int, v double")
    low, high, n = metrics.bootstrap_ci(df, "v", rounds=300).first()
    assert 0.19 < low < 0.25 < high < 0.31 and n == 300
    assert abs(low - 0.2076) < 0.015 and abs(high - 0.2924) < 0.015  # 0.25 -+ 1.96 standard errors
    one_by_one = metrics.bootstrap_ci(df, "v", rounds=300, few=1000).first()
    assert abs(one_by_one["low"] - low) < 0.015 and abs(one_by_one["high"] - high) < 0.015
    assert metrics.bootstrap_ci(df.limit(0), "v", rounds=10).first()["n_rounds"] == 0
    same = metrics.bootstrap_ci(spark.createDataFrame([(None,), (2.5,), (2.5,)], "v double"), "v", rounds=50).first()
    assert (same["low"], same["high"]) == (2.5, 2.5)


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_of_few_and_many_edits(spark):
    rng, rows = random.Random(3), []
    for n, changes in ((0, 0), (5, 9), (60, 0), (60, 3), (60, 20), (400, 40), (700, 500), (900, 300)):
        a = [rng.choice("abcdé😀́") for _ in range(n)]
        b = list(a)
        for _ in range(changes):
            b.insert(rng.randrange(len(b) + 1), rng.choice("xyzß")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        rows.append(("".join(a), "".join(b)))
    rows.append(("", "abc"))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", metrics.edit_distance(F.col("a"), F.col("b")).alias("d"), metrics.token_distance(F.split("a", ""), F.split("b", "")).alias("t")).collect()
    for r in got:
        assert r["d"] == table_distance(r["a"], r["b"])
        if r["a"] and r["b"]:
            assert r["t"] == r["d"]
    nulls = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in nulls.select(metrics.edit_distance(F.col("a"), F.col("b"))).collect()] == [None, None]


def test_word_distances_against_the_whole_table(spark):
    rng = random.Random(4)
    rows = [("a b c", "a c"), ("", "x y"), ("x x x y", "y x y"), ("one", "two three"), ("p q r s t", "p r q s"), ("same", "same")]
    for _ in range(60):
        rows.append(tuple(" ".join(rng.choice("pqrst") for _ in range(rng.randint(0, 40))) for _ in range(2)))
    df = spark.createDataFrame(rows, "a string, b string").select(metrics.words(F.col("a")).alias("a"), metrics.words(F.col("b")).alias("b"))
    for r in df.select("a", "b", metrics.token_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r["d"] == table_distance(r["a"], r["b"])
    nulls = spark.createDataFrame([(None, ["a"]), (["a"], None), (["a", None], [None]), (["b"], ["c"])], "a array<string>, b array<string>")
    assert [r[0] for r in nulls.select(metrics.token_distance(F.col("a"), F.col("b"))).collect()] == [None, None, 1, 1]


def test_diagonals_against_the_whole_table():
    rng = random.Random(5)
    for _ in range(400):
        signs = rng.choice((2, 4, 30))
        a = [rng.randrange(signs) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() < 0.8] if rng.random() < 0.6 else [rng.randrange(signs) for _ in range(rng.randint(0, 30))]
        assert distances.distance(np.array(a, np.int64), np.array(b, np.int64)) == table_distance(a, b)


def test_a_line_of_thirty_thousand_signs(spark):
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefg ithe") for _ in range(30_000))
    n = line.count("th")
    df = spark.createDataFrame([(line, line.replace("th", "t"))], "a string, b string")
    assert df.select(metrics.edit_distance(F.col("a"), F.col("b"))).first()[0] == n > 200


def test_first_last_and_allowed(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(10)], "i int, source_corpus string")
    assert [r["i"] for r in corpus.first_rows(df, ["i"]).collect()] == [0]
    assert [r["i"] for r in corpus.last_rows(df, ["i"], 3).collect()] == [7, 8, 9]
    assert corpus.last_rows(df.limit(0), ["i"]).collect() == []
    kinds = spark.createDataFrame([("s0", "CC-BY-4.0 "), ("s1", "secret"), (None, "cc0")], "source_corpus string, license string")
    assert {r["i"] for r in corpus.allowed_sources(df, kinds, ["cc-by-4.0", "CC0"]).collect()} == {0, 3, 6, 9}


def test_review(spark):
    assert one(spark, metrics.needs_review(F.col("c"), F.col("t")), c=0.65, t="long enough") is True
    assert one(spark, metrics.needs_review(F.col("c"), F.col("t"), preset="article"), c=0.65, t="long enough") is False
    assert one(spark, metrics.needs_review(F.col("c"), F.col("t"), est_cer=F.lit(0.3)), c=0.9, t="long enough") is True


ROWS = [(f"g{g}", "14" if g % 3 else "15", f"p{g}_{k}") for g in range(40) for k in range(5 + g % 7)]


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(ROWS, "shelfmark string, century string, image_path string")


def test_splits_do_not_leak(groups):
    assigned = corpus.group_split(groups, "shelfmark", seed=7)
    sizes = {r["split"]: r["n"] for r in assigned.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 28, "val": 6, "test": 6}
    rows = corpus.with_split(groups, "shelfmark", assigned)
    assert rows.count() == len(ROWS) and corpus.leaks(rows, "shelfmark").count() == 0
    assert corpus.leaks(groups.withColumn("split", F.expr("image_path like '%_0'")), "shelfmark").count() == 40


def test_split_search_is_best_of_all(groups):
    best = corpus.split_search(groups, "shelfmark", "century", ["14", "15"], seeds=4).first()
    assert 0 <= best["seed1"] < 4 and 0 <= best["seed2"] < 4 and 0 <= best["score"] < 0.5
    alone = corpus.split_search(groups, "shelfmark", seeds=4).first()
    assert alone["score"] <= best["score"]


def test_alignment_and_filters(spark):
    a = spark.createDataFrame([("x", 14)], "text string, century int")
    b = spark.createDataFrame([("y", "15", "French")], "text string, century string, language string")
    both = corpus.union_aligned([a, b])
    assert both.columns == corpus.COLUMNS and [(r["text"], r["century"], r["language"]) for r in both.orderBy("text").collect()] == [("x", "14", None), ("y", "15", "French")]
    assert corpus.filter_members(both, century=[14], language=["French"]).count() == 0
    assert corpus.filter_members(both, century=[14, "15"]).count() == 2
    names = spark.createDataFrame([("FRAN_0021_1.jpg",), ("FRAN_0200_x",), ("other",)], "f string").select(corpus.shelfmark_of(F.col("f")).alias("s"))
    assert sorted(r["s"] for r in names.collect()) == ["JJ207", "JJ210", "unknown"]


def test_lines_index_sample_counts(spark):
    docs = spark.createDataFrame([(1, "a\n \nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["line_no"], r["line"]) for r in corpus.lines(docs).orderBy("line_no").collect()] == [(0, "a"), (2, "b")]
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    indexed = corpus.dense_index(df.repartition(7), ["g", "id"]).orderBy("g", "id").collect()
    assert [r["index"] for r in indexed] == list(range(1000))
    first = {r["id"] for r in corpus.sample_rows(df, "id", 50).collect()}
    assert len(first) == 50 and first == {r["id"] for r in corpus.sample_rows(df.repartition(9), "id", 50).collect()}
    counts = corpus.value_counts(df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), "g", normalize=True).collect()
    assert [(r["g"], r["share"]) for r in counts] == [(1, 0.5), (2, 0.5)]


def test_content_hash_ignores_order(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("b", "x")], "g string, t string")
    once = {r["g"]: r["sha256"] for r in corpus.content_hash(df, "g", F.col("t")).collect()}
    again = {r["g"]: r["sha256"] for r in corpus.content_hash(df.repartition(5).orderBy(F.desc("t")), "g", F.col("t")).collect()}
    other = {r["g"]: r["sha256"] for r in corpus.content_hash(df.union(df.limit(1)), "g", F.col("t")).collect()}
    assert once == again and once["a"] != other["a"] and once["b"] == other["b"]


def test_overlap_groups_updates(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "t string"), spark.createDataFrame([("x",), ("z",)], "t string")
    assert tuple(corpus.overlap(a, b, "t").first()) == (3, 2, 2 / 3)
    docs = corpus.group_documents(spark.createDataFrame([("s", 2, "deux"), ("s", 1, "un")], "s string, k int, t string"), "s", "t", ["k"])
    assert tuple(docs.first()) == ("s", "un deux", 2)
    models = spark.sql("SELECT array(named_struct('id','a','cer',1.0D), named_struct('id','b','cer',2.0D)) AS modeles_htr")
    assert [m["cer"] for m in contract.with_model_metrics(models, "b", cer=0.06).first()["modeles_htr"]] == [1.0, 0.06]


def test_statistics(spark):
    df = spark.createDataFrame([("boñe ꝑ ñ",), ("plain",), (None,)], "text string")
    assert [tuple(r) for r in stats.top_signs(df, F.col("text")).collect()] == [("ñ", 2)]
    row = stats.line_stats(df, F.col("text"), F.lit(0.8), F.lit(False)).first()
    assert (row["n_lines"], row["n_with_signs"], row["n_signs"], row["median_length"]) == (2, 1, 2, 6.5)
    assert {r["sign"]: r["n"] for r in stats.alphabet(df, F.col("text")).collect()}["ñ"] == 2
    impact = {r["original"]: r for r in stats.normalization_impact(df).collect()}
    assert impact["plain"]["changed"] is False and impact["boñe ꝑ ñ"]["normalized"] == "bonne ꝑ nn"
    seen = stats.recognition_summary(spark.createDataFrame([("ab", "ab"), ("a", "ab"), (None, "x")], "p string, g string"), F.col("p"), F.col("g")).first()
    assert tuple(seen) == (2, 1, 0.25, 0.75)


def test_topics(spark):
    docs = spark.createDataFrame([("a", "roy roy chastel le"), ("b", "mer nef nef le")], "c string, t string")
    top = topics.top_terms(topics.class_tfidf(topics.terms(docs, "c", "t"), "c"), "c", 1).orderBy("c").collect()
    assert [r["term"] for r in top] == ["roy", "nef"]
    vectors = spark.createDataFrame([(i, [float(i % 2) * 9 + 0.01 * i, float(i % 2) * 9, 0.5]) for i in range(20)], "id int, v array<double>")
    found = {r["id"]: r["topic"] for r in topics.kmeans_topics(vectors, "id", "v", k=2, reduce_to=2).collect()}
    assert len({found[i] for i in range(0, 20, 2)}) == 1 and found[0] != found[1]


def test_contract_schema(spark):
    df = spark.createDataFrame([(1, "uoir", "JJ207", 10)], "doc_id long, text string, shelfmark string, n long")
    out = contract.contract_lines(df, id_col="doc_id", text_col="text", confidence=F.lit(0.9))
    assert out.schema.names == contract.LINE.names and tuple(out.select("id", "text_normalized", "needs_review", "century").first()) == ("1", "voir", True, None)


def test_polygons(spark):
    df = spark.sql("SELECT array(struct(0 AS x,0 AS y), struct(10 AS x,0 AS y), struct(10 AS x,10 AS y), struct(0 AS x,10 AS y)) AS a, array(struct(5 AS x,0 AS y), struct(15 AS x,0 AS y), struct(15 AS x,10 AS y), struct(5 AS x,10 AS y)) AS b, array(struct(0 AS x,0 AS y), struct(20 AS x,0 AS y), struct(0 AS x,20 AS y)) AS t")
    row = df.select(metrics.polygon_iou(F.col("a"), F.col("b")).alias("i"), metrics.polygon_iou(F.col("a"), F.col("a")).alias("one"), metrics.polygon_iou(F.col("a"), F.col("t")).alias("t"), metrics.polygon_iou(F.col("a"), F.lit(None).cast("array<struct<x:int,y:int>>")).alias("n")).first()
    assert math.isclose(row["i"], 1 / 3) and row["one"] == 1.0 and abs(row["t"] - 0.5) < 0.03 and row["n"] is None


def test_requests_and_commands(spark, tmp_path, capsys):
    from vellumflow import api, cli

    assert api.health() == {"status": "ok", "model": "gazetteer"}
    got = api.analyze_texts(spark, ["uoir Paris", "·"])
    assert [(g["normalized"], g["n_entities"]) for g in got] == [("voir Paris", 1), ("", 0)]
    with pytest.raises(ValueError, match="blank"):
        api.analyze_texts(spark, [" "])
    df = spark.createDataFrame([(f"{i}", f"uoir {i}", f"voir {i}", f"g{i % 9}", f"{i:03}.png") for i in range(60)], "id string, text string, pred string, shelfmark string, image_path string").withColumn("gt", F.col("pred"))
    df.write.parquet(str(tmp_path / "in"))
    cli.main(["normalise", str(tmp_path / "in"), str(tmp_path / "n")])
    assert spark.read.parquet(str(tmp_path / "n")).filter("normalized = pred").count() == 60
    cli.main(["split", str(tmp_path / "in"), str(tmp_path / "s"), "--seeds", "3"])
    assert corpus.leaks(spark.read.parquet(str(tmp_path / "s")), "shelfmark").count() == 0 and "seeds:" in (tmp_path / "s.manifest.txt").read_text()
    cli.main(["evaluate", str(tmp_path / "in")])
    assert '"accuracy": 1.0' in capsys.readouterr().out
    cli.main(["tei", str(tmp_path / "in"), str(tmp_path / "t")])
    assert spark.read.parquet(str(tmp_path / "t")).filter("tei like '<TEI%'").count() == 60
    with pytest.raises(SystemExit):
        cli.main(["transcribe", "x"])
