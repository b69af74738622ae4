"""Corpus preparation in five stages, each on all that the one before kept.

quality rules: rejected documents go. line dedup: lines common to many documents
go, texts and their lengths follow. near duplicates: one document of each group
stays. benchmark decontamination: contaminated documents go. best-fit packing:
what is left becomes training sequences, one row per piece.

Defined cases: null, empty and blank texts go with the first stage, which asks for
words. A row is told by its id and text, so other texts of an id, and of a null id, are rows of their
own; equal rows are near duplicates, of which one stays. Of tied near duplicates the smallest id
stays. Very long texts are kept whole and cut into pieces by packing. Other columns come along
under any name until packing, which returns its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import decontaminate, lines, near, packing, quality
from rasterlake.llm.shared import staged, table

#: Near copies of the pipeline share this part of their shingles of so many words; op8's own bounds differ.
NEAR_NGRAM, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = lines.drop_lines(docs, rest=rest)
    kept = kept.select("doc_id", "text", *(F.col(f"rest.{c}").alias(c) for c in rest))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs, ngram=NEAR_NGRAM, percent=NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizers and zstandard have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
