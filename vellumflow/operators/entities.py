"""Entity recognition through a predictor, entity tables, scores and relations.

A predictor takes a list of texts and returns, per text, a list of dicts with
word, entity_group, score, start and end. The one that comes along is a
gazetteer with patterns: deterministic, and no neural model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions.text import is_blank, normalize, prefix, text_column
from vellumflow.operators.corpus import column_or, dense_index
from vellumflow.sources.scratch import cut

ENTITY = T.StructType([T.StructField("word", T.StringType()), T.StructField("entity_group", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
Predictor = Callable[[list[str]], list[list[dict]]]

# Names that the gazetteer knows, by label.
GAZETTEER = {
    "PER": ["Jehan", "Pierre", "Denis", "Guillaume", "Charles", "Loys", "Marie", "Ascanius"],
    "LOC": ["Paris", "Lyon", "Rouen", "Rome", "France", "Tours", "Reims"],
    "ORG": ["Parlement", "Chambre des comptes", "Université"],
}


FOLLOWING = re.compile(r"(?: (?:du |de |d')?[A-Z]\w+)*")


class GazetteerPredictor:
    """Names of a gazetteer at word starts; a personal name takes following capitalised words along."""

    def __init__(self, names: dict[str, list[str]] | None = None):
        self.names = GAZETTEER if names is None else names
        self._pattern = None

    def _load(self) -> re.Pattern:
        if self._pattern is None:
            each = sorted(((n, label) for label, ns in self.names.items() for n in ns), key=lambda x: -len(x[0]))
            self.label = dict(each)
            self._pattern = re.compile(rf"(?<!\w)({'|'.join(re.escape(n) for n, _ in each)})(?!\w)") if each else re.compile(r"(?!)")
        return self._pattern

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            found, at = [], 0
            while m := self._load().search(text, at):
                label = self.label[m[1]]
                at = FOLLOWING.match(text, m.end()).end() if label == "PER" else m.end()  # what isn't taken along may be a name
                word = text[m.start() : at]
                found.append({"word": word, "entity_group": label, "score": 0.95 if word == m[1] else 0.85, "start": m.start(), "end": at})
            out.append(found)
        return out


class NERPipeline:
    """The single-process interface: a predictor that is loaded when first used."""

    def __init__(self, make: Callable[[], Predictor] = GazetteerPredictor, name: str = "gazetteer"):
        self.name, self._make, self._predictor = name, make, None

    def predict(self, text: str) -> list[dict]:
        if not text or not text.strip():
            raise ValueError("the text is blank")
        return self.predict_batch([text])[0]

    def predict_batch(self, texts: list[str]) -> list[list[dict]]:
        if not texts:
            raise ValueError("no texts")
        if self._predictor is None:
            self._predictor = self._make()
        return self._predictor(texts)

    def evaluate(self, texts: list[str], gold: list[list[dict]]) -> dict:
        """Scores of the predictions against each text's gold entities, as of the table form; ValueError for unequal lengths."""
        if len(texts) != len(gold):
            raise ValueError(f"{len(texts)} texts and {len(gold)} lists of gold entities")
        sets = [[{(e["word"].lower(), e["entity_group"]) for e in es} for es in side] for side in (self.predict_batch(texts) if texts else [], gold)]
        n_pred, n_gold = (sum(map(len, side)) for side in sets)
        n_correct = sum(len(p & g) for p, g in zip(*sets, strict=True))
        p, r = n_correct / max(1, n_pred), n_correct / max(1, n_gold)
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        return {"precision": round(p, 4), "recall": round(r, 4), "f1": round(f1, 4), "n_pred": n_pred, "n_gold": n_gold, "n_correct": n_correct}


_made: dict[bytes, Predictor] = {}  # this worker's predictors, by what makes them


def _predictor(key: bytes, make: Callable[[], Predictor]) -> Predictor:
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _each(predictor: Predictor, texts: list[str]) -> Iterator[tuple[list[dict], str | None]]:
    """Entities and null, or none and the error, for each text; one by one only if the batch fails."""
    try:
        yield from ((found, None) for found in predictor(texts))
        return
    except Exception:  # noqa: BLE001  any text may be the cause, and the others have results
        pass
    for text in texts:
        try:
            yield predictor([text])[0], None
        except Exception as e:  # noqa: BLE001
            yield [], f"{type(e).__name__}: {e}"


RECOGNISED = T.StructType([T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("error", T.StringType())])


def recognised(text: Column, make: Callable[[], Predictor] = GazetteerPredictor) -> Column:
    """Struct of entities and error; null and blank texts have neither.

    The predictor is made once per worker, whatever the number of tasks. An error of
    the predictor is its text's alone.
    """
    key = cloudpickle.dumps(make)

    @F.pandas_udf(RECOGNISED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = _predictor(key, make)
        for texts in batches:
            good = texts.map(lambda t: t is not None and bool(t.strip()))
            out = pd.DataFrame({"entities": pd.Series([None] * len(texts), index=texts.index, dtype=object), "error": pd.Series([None] * len(texts), index=texts.index, dtype=object)})
            if good.any():
                found = list(_each(predictor, texts[good].tolist()))
                out.loc[good, "entities"] = pd.Series([[{k: e.get(k) for k in ENTITY.names} for e in es] for es, _ in found], index=texts.index[good], dtype=object)
                out.loc[good, "error"] = pd.Series([e for _, e in found], index=texts.index[good], dtype=object)
            yield out

    return run(text)


def entities_column(text: Column, make: Callable[[], Predictor] = GazetteerPredictor) -> Column:
    """Array of entities; null and blank texts have null, texts that fail none."""
    return recognised(text, make)["entities"]


def analyze(df: DataFrame, text_col: str = "text", make: Callable[[], Predictor] = GazetteerPredictor) -> DataFrame:
    """original, normalized, entities, n_entities, problem: a row per row of ``df``.

    problem is ``blank`` for a null or blank text, ``blank_after_normalize`` where
    the rules leave nothing, the predictor's error, else null; such rows have no
    entities. A column that isn't one of texts is a TypeError.
    """
    text = text_column(df, text_col)
    rows = df.withColumn("original", text).withColumn("normalized", normalize(text))
    problem = F.when(is_blank(text), F.lit("blank")).when(is_blank(F.col("normalized")), F.lit("blank_after_normalize"))
    found = rows.withColumn("_found", recognised(F.col("normalized"), make)).withColumn("problem", F.coalesce(problem, F.col("_found.error"))).withColumn("entities", F.col("_found.entities")).drop("_found")
    rounded = F.transform("entities", lambda e: F.struct(e["word"].alias("word"), e["entity_group"].alias("entity_group"), F.round(e["score"], 4).alias("score"), F.coalesce(e["start"], F.lit(0)).alias("start"), F.coalesce(e["end"], F.lit(0)).alias("end")))
    return found.withColumn("entities", rounded).withColumn("n_entities", F.coalesce(F.size("entities"), F.lit(0))).withColumn("n_entities", F.greatest("n_entities", F.lit(0)))


def entity_table(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Predictor] = GazetteerPredictor, *, chars: int | None = None) -> DataFrame:
    """text_idx, word, entity, score, source, century: a row per entity, of whole texts or of their first ``chars`` code points.

    A text at which the predictor fails has no row; :func:`entity_errors` has them.
    """
    rows = df.select(F.col(id_col).alias("text_idx"), column_or(df, "source").alias("source"), column_or(df, "century").alias("century"), F.explode(entities_column(prefix(F.col(text_col), chars) if chars else F.col(text_col), make)).alias("e"))
    return rows.select("text_idx", F.col("e.word").alias("word"), F.col("e.entity_group").alias("entity"), F.col("e.score").alias("score"), "source", "century")


def entity_errors(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Predictor] = GazetteerPredictor) -> DataFrame:
    """text_idx, error of the texts at which the predictor fails."""
    return df.select(F.col(id_col).alias("text_idx"), recognised(F.col(text_col), make)["error"].alias("error")).filter("error is not null")


def entity_summary(facts: DataFrame) -> DataFrame:
    """entity, n, mean_score, share_high (scores over 0.8)."""
    return facts.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"), F.round(F.avg((F.col("score") > 0.8).cast("int")), 4).alias("share_high"))


def entities_per_line(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Entities over all lines, those without entities included."""
    return facts.agg(F.count("*").alias("n_entities")).join(texts.agg(F.count("*").alias("n_lines"))).withColumn("per_line", F.col("n_entities") / F.greatest("n_lines", F.lit(1)))


def evaluate(pred: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """precision, recall, f1 (4 digits), n_pred, n_gold, n_correct over distinct (text, lower-cased word, label).

    Sets are formed per text and summed. A zero denominator gives 0.
    """

    def kinds(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.lower("word").alias("w"), F.col("entity_group").alias("g")).distinct()

    both = kinds(pred).withColumn("p", F.lit(1)).join(kinds(gold).withColumn("t", F.lit(1)), [*keys, "w", "g"], "full_outer")
    n = both.agg(F.count("p").alias("n_pred"), F.count("t").alias("n_gold"), F.count(F.col("p") + F.col("t")).alias("n_correct"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    p, r = ratio(F.col("n_correct"), F.col("n_pred")), ratio(F.col("n_correct"), F.col("n_gold"))
    f1 = ratio(2 * p * r, p + r)
    return n.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), "n_pred", "n_gold", "n_correct")


def check_aligned(texts: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that only one side has; empty if texts and gold belong together."""
    a, b = texts.select(key).distinct().withColumn("a", F.lit(1)), gold.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").filter("a is null or b is null").select(key)


def cooccurrences(facts: DataFrame, page: str = "text_idx", word: str = "word", *, block: int = 256) -> DataFrame:
    """a, b, n: pages that name both, each pair once in the order of names.

    A page's distinct names are dealt into blocks of about ``block`` by their hash, and
    each pair of blocks is a key of its own: a page of a million names is many keys,
    each of at most some ``block`` squared pairs. Null pages and names are left out.
    """
    names = cut(facts.select(F.col(page).alias("page"), F.col(word).alias("w")).dropna().distinct(), "names")
    blocks = names.groupBy("page").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("of")).filter("of > 1").select("page", "blocks")
    dealt = names.join(blocks, "page").withColumn("at", F.pmod(F.xxhash64("w"), "blocks"))
    low = dealt.select("page", "w", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j")).alias("x")
    high = dealt.select("page", "w", F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("i"), F.col("at").alias("j")).alias("y")
    met = low.join(high, (F.col("x.page") == F.col("y.page")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & ((F.col("x.i") < F.col("x.j")) | (F.col("x.w") < F.col("y.w"))))
    return met.select(F.least("x.w", "y.w").alias("a"), F.greatest("x.w", "y.w").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def gexf_lines(edges: DataFrame) -> DataFrame:
    """part, number, line: the graph document of an edge table of any size, in the order of part and number.

    Nodes are numbered in the order of their names, edges in that of a and b.
    """
    def safe(text: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return text

    edges = cut(edges.select("a", "b", "n"), "edges")
    nodes = dense_index(edges.select(F.col("a").alias("w")).union(edges.select("b")).distinct(), ["w"], "id")
    ends = [nodes.select(F.col("w").alias(end), F.col("id").alias(f"{end}_id")) for end in ("a", "b")]
    links = dense_index(edges.join(ends[0], "a").join(ends[1], "b"), ["a", "b"], "id")
    frame = edges.sparkSession.createDataFrame([(0, 0, '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected"><nodes>'), (2, 0, "</nodes><edges>"), (4, 0, "</edges></graph></gexf>")], "part int, number long, line string")
    node = F.concat(F.lit('<node id="'), "id", F.lit('" label="'), safe(F.col("w")), F.lit('"/>'))
    link = F.format_string('<edge id="%d" source="%d" target="%d" weight="%d"/>', "id", "a_id", "b_id", "n")
    return frame.union(nodes.select(F.lit(1), "id", node)).union(links.select(F.lit(3), "id", link))


def write_gexf(edges: DataFrame, path: str) -> None:
    """The graph document as text, written by tasks: its files, one after the other by name, are the document."""
    gexf_lines(edges).orderBy("part", "number").select("line").write.mode("overwrite").text(path)


def gexf(edges: DataFrame) -> str:
    """Graph document of a (small) edge table."""
    from xml.sax.saxutils import quoteattr

    rows = edges.orderBy("a", "b").collect()
    nodes = sorted({x for r in rows for x in (r["a"], r["b"])})
    at = {n: i for i, n in enumerate(nodes)}
    body = "".join(f"<node id=\"{i}\" label={quoteattr(n)}/>" for n, i in at.items())
    links = "".join(f'<edge id="{i}" source="{at[r["a"]]}" target="{at[r["b"]]}" weight="{r["n"]}"/>' for i, r in enumerate(rows))
    return f'<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected"><nodes>{body}</nodes><edges>{links}</edges></graph></gexf>'


# Forms of verbs of motion.
MOTION = ["ala", "va", "vait", "vint", "vient", "arriva", "parti", "retourna", "chevaucha"]


def relations(df: DataFrame, id_col: str, text_col: str, verbs: list[str] = MOTION) -> DataFrame:
    """id, person, verb, place from name + verb of motion + preposition + name."""
    pattern = rf"(\p{{Lu}}\p{{L}}+) ({'|'.join(verbs)}) (?:a|à|en|vers|de) (\p{{Lu}}\p{{L}}+)"
    hits = df.select(F.col(id_col), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("hit"))
    return hits.select(id_col, *[F.regexp_extract("hit", pattern, i + 1).alias(n) for i, n in enumerate(("person", "verb", "place"))])
