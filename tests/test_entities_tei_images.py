import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.operators import entities, images, tei

TEXTS = ["Jehan Rousseau demeure a Paris", "Denis du Vergier va a Lyon", "  ", None, "·", "rien ici"]


def test_pipeline_interface():
    made = []

    def make():
        made.append(1)
        return entities.GazetteerPredictor()

    ner = entities.NERPipeline(make)
    assert not made
    assert [e["word"] for e in ner.predict(TEXTS[0])] == ["Jehan Rousseau", "Paris"] and len(made) == 1
    assert [[e["entity_group"] for e in es] for es in ner.predict_batch(TEXTS[:2])] == [["PER", "LOC"], ["PER", "LOC"]]
    for bad in ("", "   "):
        with pytest.raises(ValueError, match="blank"):
            ner.predict(bad)
    with pytest.raises(ValueError, match="no texts"):
        ner.predict_batch([])


def test_evaluate_lists():
    ner = entities.NERPipeline()
    gold = [[{"word": "jehan rousseau", "entity_group": "PER"}], [{"word": "Lyon", "entity_group": "ORG"}]]
    assert ner.evaluate(TEXTS[:2], gold) == {"precision": 0.25, "recall": 0.5, "f1": 0.3333, "n_pred": 4, "n_gold": 2, "n_correct": 1}
    assert ner.evaluate([], []) == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "n_pred": 0, "n_gold": 0, "n_correct": 0}
    with pytest.raises(ValueError, match="2 texts and 1"):
        ner.evaluate(TEXTS[:2], gold[:1])


def test_a_text_s_error_is_its_own(spark):
    class Fails:
        """A predictor that can't take one word."""

        def __call__(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("poison")
            return [[{"word": "w", "entity_group": "MISC", "score": 1.0, "start": 0, "end": 1}] for _ in texts]

    df = spark.createDataFrame([(i, "poison here" if i == 7 else None if i == 8 else f"text {i}") for i in range(40)], "i int, text string").repartition(1)
    rows = {r["i"]: r for r in entities.analyze(df, "text", Fails).collect()}
    assert rows[7]["problem"] == "RuntimeError: poison" and rows[7]["n_entities"] == 0 and rows[8]["problem"] == "blank"
    assert all(rows[i]["n_entities"] == 1 and rows[i]["problem"] is None for i in range(40) if i not in (7, 8))
    assert [tuple(r) for r in entities.entity_errors(df, "i", "text", Fails).collect()] == [(7, "RuntimeError: poison")]
    assert entities.entity_table(df, "i", "text", Fails).count() == 38


def test_a_worker_makes_one_predictor(monkeypatch):
    monkeypatch.setattr(entities, "_made", {})
    made = []
    make = lambda: made.append(1) or len(made)
    assert [entities._predictor(b"a", make), entities._predictor(b"a", make), entities._predictor(b"b", make)] == [1, 1, 2]


def test_only_texts_are_taken(spark):
    from vellumflow import api
    from vellumflow.functions import text
    from vellumflow.operators import stats

    numbers = spark.createDataFrame([(42,)], "text int")
    for call in (lambda: text.with_normalized(numbers), lambda: entities.analyze(numbers), lambda: stats.normalization_impact(numbers), lambda: api.analyze_texts(spark, [42])):
        with pytest.raises(TypeError, match="texts are expected"):
            call()


def test_http_answers(spark):
    import json
    import threading
    import urllib.request

    from vellumflow import serve

    assert serve.answer(spark, "GET", "/health", b"")[1]["status"] == "ok"
    assert [serve.answer(spark, m, p, b)[0] for m, p, b in (("GET", "/x", b""), ("GET", "/analyze", b""), ("POST", "/analyze", b'{"text": "  "}'), ("POST", "/analyze", b"{}"), ("POST", "/analyze", b"["), ("POST", "/analyze", b'{"text": 5}'))] == [404, 405, 422, 422, 422, 422]
    http = serve.server(spark, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        ask = urllib.request.Request(f"http://127.0.0.1:{http.server_port}/analyze", json.dumps({"text": TEXTS[0]}).encode())
        got = json.loads(urllib.request.urlopen(ask).read())
    finally:
        http.shutdown()
    assert got["original"] == TEXTS[0] and [e["word"] for e in got["entities"]] == ["Jehan Rousseau", "Paris"]


def test_analyze(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    rows = entities.analyze(df).orderBy("i").collect()
    assert [r["n_entities"] for r in rows] == [2, 2, 0, 0, 0, 0]
    assert [r["problem"] for r in rows] == [None, None, "blank", "blank", "blank_after_normalize", None]
    for e in rows[0]["entities"]:
        assert rows[0]["normalized"][e["start"] : e["end"]] == e["word"]


def test_entity_tables(spark):
    df = spark.createDataFrame([(0, TEXTS[0], "s"), (1, TEXTS[1], "s"), (2, None, "s")], "i long, text string, source string")
    facts = entities.entity_table(df, "i", "text")
    assert sorted((r["text_idx"], r["word"], r["century"]) for r in facts.collect()) == [(0, "Jehan Rousseau", "?"), (0, "Paris", "?"), (1, "Denis du Vergier", "?"), (1, "Lyon", "?")]
    assert {r["entity"]: (r["n"], r["mean_score"], r["share_high"]) for r in entities.entity_summary(facts).collect()} == {"PER": (2, 0.85, 1.0), "LOC": (2, 0.95, 1.0)}
    assert entities.entities_per_line(facts, df).first()["per_line"] == 4 / 3
    edges = entities.cooccurrences(facts)
    assert sorted(map(tuple, edges.collect())) == [("Denis du Vergier", "Lyon", 1), ("Jehan Rousseau", "Paris", 1)]
    assert len(ET.fromstring(entities.gexf(edges)).findall(".//{*}edge")) == 2
    found = entities.relations(spark.createDataFrame([(1, "Ascanius ala a Rome")], "i int, t string"), "i", "t")
    assert tuple(found.first()) == (1, "Ascanius", "ala", "Rome")


def test_scores(spark):
    schema = "doc_id long, word string, entity_group string"
    pred = spark.createDataFrame([(0, "Jehan", "PER"), (0, "JEHAN", "PER"), (0, "Paris", "ORG"), (1, "Lyon", "LOC")], schema)
    gold = spark.createDataFrame([(0, "jehan", "PER"), (0, "Paris", "LOC"), (2, "Rome", "LOC")], schema)
    assert tuple(entities.evaluate(pred, gold).first()) == (0.3333, 0.3333, 0.3333, 3, 3, 1)
    assert tuple(entities.evaluate(pred.limit(0), gold).first()) == (0.0, 0.0, 0.0, 0, 3, 0)
    assert tuple(entities.evaluate(pred.limit(0), gold.limit(0)).first())[:3] == (0.0, 0.0, 0.0)
    assert sorted(r["doc_id"] for r in entities.check_aligned(pred, gold).collect()) == [1, 2]


def tei_by_hand(text, ents):
    p, at = ET.Element("p"), 0

    def write(s):
        if len(p):
            p[-1].tail = (p[-1].tail or "") + s
        else:
            p.text = (p.text or "") + s

    for e in sorted(ents, key=lambda e: e["start"]):
        if e["start"] > at:
            write(text[at : e["start"]])
        ET.SubElement(p, tei.TAGS.get(e["entity_group"], "name"), {"type": e["entity_group"]}).text = e["word"]
        at = e["end"]
    if at < len(text):
        write(text[at:])
    return ET.tostring(p, encoding="unicode")


CASES = [
    ("Jehan & <Paris>", [("Jehan", "PER", 0, 5), ("Paris", "LOC", 9, 14)]),
    ("abcdef", [("def", "ORG", 3, 6), ("ab", "MISC", 0, 2)]),
    ("abcdefgh", [("abcdef", "PER", 0, 6), ("cd", "LOC", 2, 4)]),
    ("abc", []),
    ("abc", [("x\"'&", "DATE", 0, 3)]),
    ("😀 roi", [("roi", "PER", 2, 5)]),
]


def test_tei_paragraphs(spark):
    rows = [(i, t, [{"word": w, "entity_group": g, "score": 0.5, "start": s, "end": e} for w, g, s, e in es]) for i, (t, es) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, text string, entities array<struct<word:string,entity_group:string,score:double,start:int,end:int>>")
    out = tei.tei_documents(df, "text", "entities").orderBy("i").collect()
    for (_, text, ents), r in zip(rows, out, strict=True):
        doc = ET.fromstring(r["tei"])
        got = ET.tostring(doc.find(".//{*}p"), encoding="unicode").replace("ns0:", "").replace(' xmlns:ns0="http://www.tei-c.org/ns/1.0"', "")
        assert got == tei_by_hand(text, ents)
        assert doc.find(".//{*}title").text == "Manuscrit médiéval" and doc.find(".//{*}msIdentifier").text == "Inconnu"
    named = df.limit(1).select(tei.build_tei(F.lit("x"), F.lit(None), F.lit("JJ207")).alias("t"), tei.pretty(tei.build_tei(F.lit("x"), F.lit(None))).alias("p")).first()
    assert "<title>JJ207</title>" in named["t"] and "\n  <teiHeader>" in named["p"]


@pytest.fixture
def gray():
    image = np.full((200, 400), 240, np.uint8)
    image[80:120, 50:350] = 30
    return image


def test_image_invariants(gray):
    blank = np.full((100, 200), 255, np.uint8)
    for f in (images.deskew, images.apply_clahe, images.binarize_sauvola):
        out = f(gray)
        assert out.shape == gray.shape and out.dtype == np.uint8
        with pytest.raises(ValueError, match="dimensions"):
            f(np.zeros((10, 10, 3), np.uint8))
    assert (images.deskew(blank) == blank).all() and (images.deskew(gray) == gray).all()
    assert set(np.unique(images.binarize_sauvola(gray))) <= {0, 255}
    with pytest.raises(ValueError, match="odd"):
        images.binarize_sauvola(gray, window_size=24)
    done = images.preprocess_page(gray)
    assert set(done) == {"original", "deskewed", "clahe", "binary"} and all(v.shape == gray.shape for v in done.values())


@pytest.mark.parametrize("degrees", [-12.0, -3.0, 5.0, 20.0])
def test_turned_pages_become_straight(gray, degrees):
    turned = images.rotate(gray, degrees)
    assert abs(abs(images.skew_angle(turned)) - abs(degrees)) < 1
    assert abs(images.skew_angle(images.deskew(turned))) < 1


def test_sauvola_by_hand():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (20, 30)).astype(np.uint8)
    padded = np.pad(image.astype(float), 3, mode="reflect")
    got = images.sauvola_threshold(image, 7, 0.2)
    for y, x in ((0, 0), (7, 9), (19, 29)):
        w = padded[y : y + 7, x : x + 7]
        assert np.isclose(got[y, x], w.mean() * (1 + 0.2 * (w.std() / 127.5 - 1)))


def test_images_in_spark(spark, gray):
    df = spark.createDataFrame([(1, {"height": 200, "width": 400, "data": bytearray(gray.tobytes())})], f"id int, image {images.IMAGE}")
    row = images.preprocess_images(df).first()
    want = images.preprocess_page(gray)
    for name in ("deskewed", "clahe", "binary"):
        assert bytes(row[name]["data"]) == want[name].tobytes()
    assert images.crop(gray, (50, 80, 350, 120)).max() == 30
