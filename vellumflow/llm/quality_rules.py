"""Quality rules as a ledger of bits: each rule is evaluated once, policies are masks.

The ledger keeps, per document, the measurements and one long whose bit ``k`` is
set if rule ``k`` fails, whatever the policy. A policy is a version's set of rules;
applying one, or asking what a rule alone removes, reads the bits of a written
ledger only, never the texts again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.llm.shared import column_name, written
from vellumflow.llm.text_stats import SYMBOLS, lines_with_words, n_of, repeated_words, word_chars

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_capitals", "n_exclaims", "n_digits"]

#: Rule k fails (bit k) where the SQL condition over the measurements holds.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("very_many_words", "n_words > 1000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("exclaims", "2 * n_exclaims > n_words"),
    ("digits", "2 * n_digits > word_chars"),
    ("few_distinct", "100 * n_distinct < 5 * n_words"),
]
BASE = ("few_words", "repeated_windows")
#: Versions of what a document may not fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "short_words", "long_words", "symbols", "repeated_lines", "capitals", "exclaims", "digits"),
    "v2": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def measured(text: bytes) -> tuple[int, ...]:
    words, lines = text.split(), lines_with_words(text)
    return (
        len(words),
        word_chars(text),
        n_of(text, SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        n_of(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        n_of(text, b"!"),
        n_of(text, b"0123456789"),
    )


_STRUCT = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


def _measure(texts: pa.Array) -> pa.Array:
    rows = [measured(t.as_py() or b"") for t in texts]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES)


def measurements(text: Column) -> Column:
    """Struct of MEASURES for a text column; null counts as empty."""
    return F.arrow_udf(_measure, _STRUCT)(text.cast("binary"))


def fail_bits(struct: str | None = None) -> Column:
    """Bits of the failed rules, from columns, or fields of the struct, that are named as in MEASURES."""
    out = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(RULES):
        bit = F.lit(1 << k).cast("long")
        out = out.bitwiseOR(F.when(F.expr(_inside(rule, struct) if struct else rule), bit).otherwise(F.lit(0).cast("long")))
    return out


def rule_ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, MEASURES and fail_bits, a row per row of ``docs``.

    A null text counts as empty (no words: ``few_words`` fails); null ids and
    repeated rows are kept; further columns are left out; an empty table gives none.
    """
    wide = docs.select(F.col(id_col).alias("doc_id"), measurements(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    return wide.withColumn("fail_bits", fail_bits())


def passes(policy: str, bits: Column | None = None) -> Column:
    bits = F.col("fail_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ledger_column(docs: DataFrame) -> str:
    return column_name(docs, "rule_ledger")


def with_ledger(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` beside their ledger, a struct of MEASURES and fail_bits, as a written table.

    Its column has the first free name of ``rule_ledger``, ``rule_ledger_``, ... The
    table is in columns, so that what reads the bits reads no text, and any policy
    or ablation is applied to it without measuring again.
    """
    name = ledger_column(docs)
    measured = docs.withColumn(name, measurements(F.col(text_col)))
    return written(measured.withColumn(name, F.col(f"`{name}`").withField("fail_bits", fail_bits(name))), "rule-ledger")


def filter_by_rules(docs: DataFrame, policy: str, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs`` only; every rule is in their ledger."""
    kept = with_ledger(docs, text_col=text_col).filter(passes(policy, F.col(f"`{ledger_column(docs)}`.fail_bits")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _inside(condition: str, struct: str) -> str:
    return " ".join(f"`{struct}`.{w}" if w in MEASURES else w for w in condition.split())


def policy_counts(ledger: DataFrame) -> DataFrame:
    """policy, n_kept, n_failed for each version, from one pass over the distinct bit patterns of a ledger."""
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    each = patterns.select("n", "fail_bits", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).cast("long").alias("mask")) for p in POLICIES])).alias("p"))
    kept = F.col("fail_bits").bitwiseAND(F.col("p.mask")) == 0
    return each.groupBy(F.col("p.policy").alias("policy")).agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept"), F.sum(F.when(kept, 0).otherwise(F.col("n"))).alias("n_failed"))


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule: rows that fail it, rows that fail nothing else of the policy, rows kept without it.

    One pass over distinct bit patterns, of which there are at most 2^rules.
    """
    m = mask(policy)
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if m >> k & 1])
    each = patterns.select("n", F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits"), F.explode(rules).alias("r"))
    bit = F.col("r.bit")
    fails, others = F.col("bits").bitwiseAND(bit) != 0, F.col("bits").bitwiseAND(F.bitwise_not(bit))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(total(fails).alias("n_failed"), total(fails & (others == 0)).alias("n_failed_alone"), total(others == 0).alias("n_kept_without"))
