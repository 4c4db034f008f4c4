"""Spelling normalisation of historical French as Column functions.

All take and return Columns; null stays null. With ``strict=True`` a caller gets
an error for null where the rule set is defined on text only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Abbreviations and their expansions.
ABBREVIATIONS = {
    "ꝵ": "rum",
    "ꝭ": "us",
    "q̃": "que",
    "p̃": "par",
    "ñ": "nn",
    "ã": "an",
    "ẽ": "en",
    "ĩ": "in",
    "õ": "on",
    "ũ": "un",
    "ihu": "jésus",
    "xps": "christus",
    "dns": "dominus",
    "snt": "saint",
}
# Further signs that an expansion table may have.
TIRONIAN = {"⁊": "et", "ꝯ": "con", "ꝑ": "par", "ꝓ": "pro"}
# Letters before which an initial u is a v, and an initial j an i.
AFTER_U = "aeiouàâéèêëîïôùûüy"
AFTER_J = "aouàâôùûü"

#: White space as Unicode has it, and the four separators of information units.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: No letter, digit or underscore before; a combining mark is none of them.
WORD_START = r"(?<![\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one space; none at either end."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(collapse_spaces(text) == "", F.lit(True))


def _form(name: str):
    """Spark has no function for Unicode normal forms, so texts go to Python in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(name, t))

    return F.pandas_udf(run, "string")


def decompose(text: Column) -> Column:
    """Canonical decomposition."""
    return _form("NFD")(text)


def compose(text: Column) -> Column:
    return _form("NFC")(text)


def _checked(text: Column, strict: bool) -> Column:
    return F.when(text.isNull(), F.raise_error(F.lit("a text is expected, not null"))).otherwise(text) if strict else text


def normalize_unicode(text: Column, *, strict: bool = False) -> Column:
    """Decomposed text with collapsed white space; diacritics stay as combining marks."""
    return collapse_spaces(decompose(_checked(text, strict)))


def by_length(table: Mapping[str, str]) -> list[tuple[str, str]]:
    """Entries in the order of replacement: longer keys first, else as given."""
    return sorted(table.items(), key=lambda kv: -len(kv[0]))


def expand_abbreviations(text: Column, table: Mapping[str, str] | None = None, *, compose_first: bool = False) -> Column:
    """Replace every key wherever it stands, case-sensitively, longer keys first.

    Keys with composed letters don't match decomposed text; ``compose_first``
    composes the text before.
    """
    out = compose(text) if compose_first else text
    for key, full in by_length(ABBREVIATIONS if table is None else table):
        out = F.replace(out, F.lit(key), F.lit(full))
    return out


def expand_nasal_tildes(text: Column) -> Column:
    """A vowel with a tilde, composed or not, is a vowel and n."""
    return F.regexp_replace(decompose(text), "(?i)([aeiou])̃", "$1n")


def normalize_uv(text: Column) -> Column:
    """A u that begins a word before a vowel becomes a small v."""
    return F.regexp_replace(text, f"(?iu){WORD_START}u([{AFTER_U}])", "v$1")


def normalize_ij(text: Column) -> Column:
    """A j that begins a word before a, o or u becomes a small i."""
    return F.regexp_replace(text, f"(?iu){WORD_START}j([{AFTER_J}])", "i$1")


def normalize_punctuation(text: Column) -> Column:
    """Middle dots become spaces, pilcrows full stops; white space is collapsed."""
    return collapse_spaces(F.translate(text, "·¶", " ."))


def normalize(text: Column, *, expand_abbr: bool = True, uv_ij: bool = True, punct: bool = True, strict: bool = False) -> Column:
    """All rules in order: abbreviations, decomposition, u/v, i/j, punctuation."""
    out = _checked(text, strict)
    if expand_abbr:
        out = expand_abbreviations(out)
    out = normalize_unicode(out)
    if uv_ij:
        out = normalize_ij(normalize_uv(out))
    return normalize_punctuation(out) if punct else out


def text_column(df: DataFrame, name: str) -> Column:
    """A column of texts; TypeError for any other type, which would be cast without a word otherwise."""
    kind = df.schema[name].dataType
    if not isinstance(kind, StringType):
        raise TypeError(f"column {name} is {kind.simpleString()}; texts are expected")
    return F.col(name)


def with_normalized(df: DataFrame, text_col: str = "text", out: str = "normalized", **options) -> DataFrame:
    """``df`` and the normalised text, or null for null; TypeError if the column isn't one of texts."""
    text_column(df, text_col)
    return df.withColumn(out, normalize(F.col(text_col), **options))


def changed(original: Column, normalized: Column) -> Column:
    """Whether any code point differs; composed and decomposed letters do."""
    return original != normalized


def prefix(text: Column, n: int = 512) -> Column:
    """The first ``n`` code points."""
    return F.substring(text, 1, n)


def basename(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def polygon(points: Column) -> Column:
    """Array of (x, y) from ``x,y x,y ...``."""
    pairs = F.filter(F.split(F.trim(points), r"\s+"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(","), F.lit(1)).cast("int").alias("x"), F.split_part(p, F.lit(","), F.lit(2)).cast("int").alias("y")))


def register_sql(spark) -> None:
    """``vf_nfd`` for SQL texts; the other rules are built-in functions."""
    spark.udf.register("vf_nfd", _form("NFD"))
