"""A training corpus from the ``documents`` table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last one returns the mix, in which a document
occurs as often as its source's repetition rate asks for.

1. quality: rejects documents whose probability of being graded 1 or better is under one half
2. near_duplicates: one document of each component of near copies (five-word shingles, 0.8) stays
3. decontaminate: drops documents that hold a benchmark window
4. secrets: replaces every secret span by the name of its rule
5. mix: repeats or thins documents to their source's target weight

The first stage's classifier is fitted, which SQL cannot express, so there is
no SQL for the rows of ``run``; ``tests/llm/test_pipeline.py`` compares the
other stages with direct versions.

Edge cases, alike in every stage: columns beyond those of ``documents`` are
dropped, whatever their names; null and empty texts are documents like others (the
quality model gives them the score of no features, near copies and benchmark
windows need words, they hold no secrets, the mix gives them size 0); rows without
doc_id and repeated rows are kept or dropped by their own text; very long texts are
taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import decontam, mixing, ngram_join, quality_model, secrets
from cohortkit.llm.common import delete_folder, ensure_checkpoint_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Near copies: shingles of five words, similarity from 0.8 (3 and 90 % are the contract of operator 9 alone).
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.fit(docs, quality_model.graded(table(spark, sf_dir, "labels")), n_grades=3)
    scored = quality_model.score(docs.select(*COLUMNS), model)
    return scored.where(F.col("tail_probability") >= quality_model.SELECT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs.select(*COLUMNS), k=NEAR_WORDS, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = secrets.redact(F.col("text"), F.col("_spans"))
    scanned = secrets.scan_paths(docs.select(*COLUMNS))
    return (scanned.withColumn("_new", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(text))
            .select("doc_id", F.col("_new").alias("text"), "lang", "source",
                    F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("_new").cast("long")).alias("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", remove_secrets),
    ("mix", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared checkpoint folder and read again.

    A stage's table is deleted as soon as the next one is written; the last one stays for the caller.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            delete_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
