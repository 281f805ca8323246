"""The queries ``opN_<name>`` of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import (
    decontam, html_text, licenses, mixing, ngram_join, quality_model, quality_rules, repair, secrets, simhash,
    substrings, toxicity, trie)
from cohortkit.llm.common import table
from cohortkit.llm.sql import ORACLES


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = secrets.scan_paths(docs)
    return scanned.select("doc_id", *[c.alias(n) for n, c in secrets.digest_columns(F.col("_spans")).items()])


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, quality_model.graded(table(spark, sf_dir, "labels")), n_grades=3)
    scored = quality_model.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "expected_grade", "tail_probability",
                         (F.col("tail_probability") >= quality_model.SELECT).alias("kept"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op4_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("predicted"),
                         F.size("spans").cast("long").alias("n_spans"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations")).drop("h")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_ordinal_quality, op3_html_text, op4_toxic_spans, op5_host_rules, op6_license_scan,
        op7_substrings, op8_winnowing, op9_jaccard_join, op10_mixing, op11_prefix_trie, op12_simhash,
        op13_structure_repair)}


def oracle_sql() -> dict[str, str]:
    names = queries()
    return {name: sql for name, sql in ORACLES.items() if name in names}
