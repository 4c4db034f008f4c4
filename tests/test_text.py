import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumflow.functions import text as T


def run(spark, function, values):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, t string").select("i", function(F.col("t")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


#: The rules in plain Python, written from their description.
def py_spaces(t):
    return re.sub(r"\s+", " ", t).strip()


def py_uv(t):
    return re.sub(f"\\bu([{T.AFTER_U}])", r"v\1", t, flags=re.IGNORECASE)


def py_ij(t):
    return re.sub(f"\\bj([{T.AFTER_J}])", r"i\1", t, flags=re.IGNORECASE)


def py_abbr(t):
    for k, v in sorted(T.ABBREVIATIONS.items(), key=lambda kv: -len(kv[0])):
        t = t.replace(k, v)
    return t


def py_normalize(t):
    t = py_ij(py_uv(py_spaces(unicodedata.normalize("NFD", py_abbr(t)))))
    return py_spaces(t.replace("·", " ").replace("¶", "."))


PAIRS = [
    (T.normalize_unicode, "le  roy", "le roy"),
    (T.normalize_unicode, "  texte  ", "texte"),
    (T.expand_abbreviations, "доminoꝵ", "доminorum"),
    (T.expand_abbreviations, "boñe", "bonne"),
    (T.expand_abbreviations, "le roi", "le roi"),
    (T.expand_abbreviations, "ñ ñ", "ñ nn"),
    (T.normalize_uv, "uoir", "voir"),
    (T.normalize_uv, "un ami", "un ami"),
    (T.normalize_uv, "avoir", "avoir"),
    (T.normalize_uv, "éua", "éva"),
    (T.normalize_uv, "éua", "éua"),
    (T.normalize_uv, "²ua 2ua _ua ·ua Uoir uı", "²ua 2ua _ua ·va voir vı"),
    (T.normalize_ij, "jour", "iour"),
    (T.normalize_ij, "ajouter", "ajouter"),
    (T.normalize_ij, "jn", "jn"),
    (T.normalize_punctuation, "le·roi", "le roi"),
    (T.normalize_punctuation, "¶ Item", ". Item"),
    (T.collapse_spaces, "le\xa0roi\x1cok x", "le roi ok x"),
    (T.normalize, "uoir le roy auec ses gens", "voir le roy auec ses gens"),
    (T.normalize, "", ""),
    (T.normalize, None, None),
]


@pytest.mark.parametrize("function", sorted({f for f, _, _ in PAIRS}, key=lambda f: f.__name__))
def test_pairs(spark, function):
    cases = [(a, b) for f, a, b in PAIRS if f is function]
    assert run(spark, function, [a for a, _ in cases]) == [b for _, b in cases]


def test_options(spark):
    assert run(spark, lambda c: T.normalize(c, expand_abbr=False), ["boñe"]) == ["boñe"]
    assert run(spark, lambda c: T.normalize(c, uv_ij=False), ["uoir"]) == ["uoir"]
    assert run(spark, lambda c: T.expand_abbreviations(c, compose_first=True), ["boñe"]) == ["bonne"]
    assert run(spark, lambda c: T.expand_abbreviations(c, T.TIRONIAN), ["⁊ ꝯmanda ꝑ ꝓ"]) == ["et conmanda par pro"]
    assert run(spark, T.expand_nasal_tildes, ["sẽssoit õ"]) == ["senssoit on"]
    with pytest.raises(Exception, match="not null"):
        run(spark, lambda c: T.normalize(c, strict=True), [None])


SIGNS = ["u", "U", "j", "J", "a", "o", "é", "e", "́", "ñ", "q̃", "ihu", "xps", "·", "¶", " ", "\xa0", "\x1c", "\n", "1", "²", "_", "-", "ı", "ꝵ", "b", "东"]


def test_against_plain_python(spark):
    import random

    rng = random.Random(11)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 12))) for _ in range(3000)]
    for function, plain in ((T.normalize, py_normalize), (T.normalize_uv, py_uv), (T.normalize_ij, py_ij), (T.collapse_spaces, py_spaces), (T.expand_abbreviations, py_abbr)):
        got = run(spark, function, texts)
        assert got == [plain(t) for t in texts], function.__name__
    for t in run(spark, T.normalize, texts):
        assert t == t.strip() and "  " not in t and unicodedata.is_normalized("NFD", t)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=15), min_size=1, max_size=20))
def test_any_latin_text(spark, texts):
    assert run(spark, T.normalize, texts) == [py_normalize(t) for t in texts]


def test_small_functions(spark):
    assert run(spark, T.basename, ["a/b.c/x.tar.gz", "x", ".hidden", "a/"]) == ["x.tar", "x", ".hidden", ""]
    assert run(spark, T.strip, ["  a b \n"]) == ["a b"]
    assert [[tuple(p) for p in r] for r in run(spark, T.polygon, ["1,2 30,4  30,20", ""])] == [[(1, 2), (30, 4), (30, 20)], []]
    assert run(spark, lambda c: T.prefix(c, 2), ["a😀b"]) == ["a😀"]
    assert run(spark, T.is_blank, [None, " \n", "x"]) == [True, True, False]
