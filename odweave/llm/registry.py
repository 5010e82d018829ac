"""Queries of this folder's operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, chat, crc_resampling, decontam, filter_audit, line_join, mixing, ngram_lm, quality_llr, quality_rff, secrets, suffix_dedup, superminhash
from .common import table
from .oracle import SQL


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.loss_spans(chat.format_turns(c.unionByName(own))))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, good = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    found = secrets.secrets(docs, secrets.labelled_samples(spark).unionByName(secrets.trusted_samples(docs, good)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality_llr.quality(table(spark, sf_dir, "documents"), good)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_join.without_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("row.doc_id", "n_removed", "n_fuzzy", F.length("row.text").cast("long").alias("kept_chars"), F.sha2("row.text", 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rff.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("hits.item_id").alias("item_ids"), F.col("hits.distance").alias("distances"), (F.size("hits") > 0).alias("contaminated"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return chaining.passage_summary(docs, chaining.shared_passages(docs))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = ngram_lm.language_model(table(spark, sf_dir, "documents"), ngram_lm.every_fifth())
    return scores


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# What SQL can say of the three operators whose last columns it cannot.


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", (F.floor(F.col("target") * 1e3 + 0.5) / 1e3).alias("target"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secret_scan(spark, sf_dir).drop("n_markov", "spans")


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality_rules(spark, sf_dir).drop("llr", "kept")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11's columns, the two sums of logarithms to three digits: these do not depend on the order of a sum."""
    rounded = lambda c: (F.floor(F.col(c) * 1e3 + 0.5) / 1e3).alias(c)
    return op11_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", rounded("base_score"), rounded("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_format, op2_minhash_dedup, op3_line_dedup, op4_source_mixing, op5_secret_scan,
        op6_quality_classifier, op7_decontamination, op8_suffix_dedup, op9_quality_rules, op10_substring_dedup,
        op11_lm_scoring, op12_target_resampling, op13_filter_audit,
        mix_targets, secret_base_spans, quality_rule_counts, lm_scores,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
