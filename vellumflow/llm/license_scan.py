"""Licence scan in DataFrame operations only: Dice coefficient over word bigrams.

A text is lower-cased, other signs than letters and digits become spaces, and its
word bigrams, repeats included, are compared with those of licence templates: short
notices, and whole licences (``licenses/``). Units are a document's lines, its whole
text if it has several, and windows of each template's size at any place, which find
a notice that is wrapped over lines or stands within a longer text.

With coefficient t, numbers a and b of bigrams satisfy t / (2 - t) <= a / b <=
(2 - t) / t, so a unit whose number fits no template is pruned before any bigram is
made. Before that whole texts are: what reaches t has t / (2 - t) of a template's
bigrams, so it has one of a few of its words that touch all but fewer. The bigrams of
the rest meet those of the templates, a table fixed in size by the templates, in a
broadcast join; only those that match are shuffled, by their document.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.shared import written

THRESHOLD = 0.8
FOUND = ["doc_id", "unit", "place", "license", "dice"]

#: Licence notices, by name.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]


# Words that most texts have, which are no sign of a licence.
COMMON = frozenset("a all an and any are as at be but by for from has have in is it may no not of on or other shall such that the their this to under use was were will with you your".split())


@cache
def all_templates() -> tuple[tuple[str, str], ...]:
    """Name and text of the notices and of the whole licences of ``licenses/``."""
    whole = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    return (*NOTICES, *whole)


def template_bigrams(templates) -> list[tuple[str, dict[str, int]]]:
    """Name and bigram counts of each template."""
    out = []
    for name, text in templates:
        words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
        out.append((name, Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))))
    return out


def marks(known: list[tuple[str, dict[str, int]]], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold with some template has one.

    Of each template the longest, common ones last, until the bigrams without them are too few.
    """
    out: set[str] = set()
    for _, bigrams in known:
        need, left = threshold / (2 - threshold) * sum(bigrams.values()), dict(bigrams)
        for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w in COMMON, -len(w), w)):
            if sum(left.values()) < need - 1e-9:
                break
            out.add(word)
            left = {b: n for b, n in left.items() if word not in b.split()}
    return sorted(out)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams_of(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def scan_licenses(docs: DataFrame, *, templates=None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit, place, license, dice: what reaches ``threshold``.

    unit ``line``: the best template of a line, at its number from 1; ``text``: the
    best of the whole of a text of several lines, at 0. Ties go to the smaller name.
    ``window``: at the number of its first word, from 1, a window of a template's size;
    a template takes windows by descending coefficient, the first of equal ones, and drops
    only those that overlap a taken one, so copies side by side are a row each; of
    templates of one licence the best at a place stays. Null and empty texts give no
    row; long texts are read whole; repeated rows and null ids are kept; further columns
    are left out; an empty table, or templates without bigrams, give no rows.
    """
    known = template_bigrams(all_templates() if templates is None else templates)
    sizes = [sum(b.values()) for _, b in known]
    if not any(sizes):
        return docs.limit(0).select(F.col(id_col).alias("doc_id"), F.lit("").alias("unit"), F.lit(0).alias("place"), F.lit("").alias("license"), F.lit(0.0).alias("dice"))
    names = [name.replace("\\", "\\\\").replace("'", "\\'") for name, _ in known]
    rows = ", ".join(f"({k}, '{names[k]}', {sizes[k]}, '{g}', {c})" for k, (_, own) in enumerate(known) for g, c in sorted(own.items()))
    table = docs.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, size, bigram, most)")
    text = F.col(text_col)
    marked = F.arrays_overlap(F.split(normalised(text), " "), F.array(*map(F.lit, marks(known, threshold))))
    kept = docs.filter(text.isNotNull() & marked).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    kept = written(kept, "license-candidates")
    repeats = sorted({c for _, own in known for c in own.values()})
    return whole_units(kept, table, sorted(set(sizes)), threshold).unionByName(windows(kept, table, threshold, repeats))


def whole_units(kept: DataFrame, table: DataFrame, sizes: list[int], threshold: float) -> DataFrame:
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    lines = F.split("text", "\n")
    units = F.concat(F.array(F.when(F.size(lines) > 1, normalised(F.col("text")))), F.transform(lines, normalised))
    words = F.split("words", " ")
    n = F.size(words) - 1
    fits = F.exists(F.array(*map(F.lit, sizes)), lambda s: (n >= s * low) & (n <= s * high))
    parts = kept.select("row", "doc_id", F.posexplode(units).alias("place", "words")).filter((n > 0) & fits)
    met = parts.select("row", "doc_id", "place", n.alias("n"), F.explode(bigrams_of(words)).alias("bigram"))
    found = met.join(F.broadcast(table), "bigram").filter((F.col("n") >= F.col("size") * low) & (F.col("n") <= F.col("size") * high))
    unit = ["row", "doc_id", "place", "n", "template", "license", "size"]
    each = found.groupBy(*unit, "bigram").agg(F.least(F.count("*"), F.first("most")).alias("common"))
    dice = each.groupBy(*unit).agg((F.lit(2.0) * F.sum("common") / (F.col("n") + F.col("size"))).alias("dice")).filter(F.col("dice") >= threshold)
    best = dice.groupBy("row", "doc_id", "place").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"))
    return best.select("doc_id", F.when(F.col("place") > 0, "line").otherwise("text").alias("unit"), "place", F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"))


def windows(kept: DataFrame, table: DataFrame, threshold: float, repeats: list[int]) -> DataFrame:
    """Windows of each template's size that reach ``threshold``, best first, without those that overlap a better one.

    A bigram counts in the windows that hold it, save those that hold the template's
    number of it before it: one stretch of first words. So a window's matches are the
    stretches that cover its first word, a running sum, for all windows at once.
    """
    words = F.split(normalised(F.col("text")), " ")
    placed = kept.select("row", "doc_id", F.posexplode(bigrams_of(words)).alias("pos", "bigram")).join(F.broadcast(table), "bigram")
    of = Window.partitionBy("row", "template")
    met = placed.withColumn("all", F.count("*").over(of)).filter(F.col("all") >= F.col("size") * threshold)
    same = Window.partitionBy("row", "template", "bigram").orderBy("pos")
    filled = F.coalesce(*[F.when(F.col("most") == m, F.lag("pos", m).over(same)) for m in repeats])
    met = met.withColumn("opens", F.greatest(filled + 1, F.col("pos") - F.col("size") + 1))

    def step(at: Column, by: int, start: bool) -> Column:
        return F.struct(at.alias("at"), F.lit(by).alias("by"), F.lit(start).alias("start"))

    unit = ["row", "doc_id", "template", "license", "size"]
    steps = met.select(*unit, F.explode(F.array(step(F.col("opens"), 1, False), step(F.col("pos"), 0, True), step(F.col("pos") + 1, -1, False))).alias("s")).select(*unit, "s.*")
    running = steps.withColumn("common", F.sum("by").over(of.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)))
    starts = running.filter(F.col("start") & (F.col("common") / F.col("size") >= threshold))
    apart = F.coalesce(F.col("at") - F.lag("at").over(of.orderBy("at")) >= F.col("size"), F.lit(False))
    numbered = starts.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(of.orderBy("at")))
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("common")).alias("c"), "at")))
    runs = numbered.groupBy(*unit, "run").agg(best_first.alias("found"), F.min("at").alias("low"), F.max("at").alias("high"))
    taken = runs.select(*unit, F.explode(without_overlaps(F.col("found"), F.col("low"), F.col("high"), F.col("size"))).alias("w")).filter("w is not null")
    named = taken.groupBy("row", "doc_id", F.col("w.at").alias("start"), "license").agg(F.max(-F.col("w.c") / F.col("size")).alias("dice"))
    return named.select("doc_id", F.lit("window").alias("unit"), (F.col("start") + 1).alias("place"), "license", "dice")


def without_overlaps(found: Column, low: Column, high: Column, size: Column) -> Column:
    """Of windows (c, at) between ``low`` and ``high``, in order of preference, each that overlaps none taken before; nulls beside them.

    Taken windows are ``size`` apart, so a stretch of that length holds one at most,
    and a window meets those of three stretches only.
    """

    def take(taken: Column, w: Column) -> Column:
        k = F.floor((w["at"] - low) / size).cast("int")
        near = F.array(*[F.get(taken, k + i)["at"] for i in (-1, 0, 1)])
        free = F.forall(near, lambda t: t.isNull() | (F.abs(t - w["at"]) >= size))
        return F.when(free, F.concat(F.slice(taken, F.lit(1), k), F.array(w), F.slice(taken, k + 2, F.size(taken)))).otherwise(taken)

    places = F.floor((high - low) / size).cast("int") + 1
    return F.aggregate(found, F.array_repeat(F.lit(None).cast("struct<c:bigint,at:int>"), places), take)
