"""The registered queries of this folder: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm import filter_audit, kd_search, license_scan, lm_scoring, mixing, near_duplicates, ngram_join, packing, quality_classifier, quality_rules, token_alignment, token_files, url_filter
from vellumflow.llm.shared import new_path
from vellumflow.llm.tokens import default_tokenizer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_ledger(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.rule_ledger(table(spark, sf_dir, "documents"))
    base_failed = ~quality_rules.passes("base")
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), quality_rules.passes("v1").alias("kept"), "fail_bits")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.lm_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return token_files.read_tokens(spark, folder)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.score_documents(docs, quality_classifier.fit_quality(docs, labels))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digests(table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def rule_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version applied to one written ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = quality_rules.with_ledger(docs)
    return quality_rules.policy_counts(ledger.select(f"{quality_rules.ledger_column(docs)}.fail_bits"))


def op5_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.rule_ledger(table(spark, sf_dir, "documents")), "v1").orderBy("rule")


def queries() -> dict:
    return {
        "op1_exact_top_k": op1_exact_top_k,
        "op2_mix_sources": op2_mix_sources,
        "op3_license_scan": op3_license_scan,
        "op4_simhash_near_duplicates": op4_simhash_near_duplicates,
        "op5_quality_rules": op5_quality_rules,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_url_filter": op7_url_filter,
        "op8_pack": op8_pack,
        "op9_token_files": op9_token_files,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_token_alignment": op11_token_alignment,
        "op12_ngram_join": op12_ngram_join,
        "op13_filter_audit": op13_filter_audit,
        "rule_ablation": op5_ablation,
        "rule_policies": rule_policies,
    }
