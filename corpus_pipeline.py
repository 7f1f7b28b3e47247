"""The corpus pipeline: quality rules, near-duplicates, repeated strings, benchmark passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame. ``run``
applies them to ``documents``, writing each result to the shared folder and reading it back. All stages but
the last return the columns of ``documents``. Two stages change texts or rows only where they must: the
suffix stage cuts repeated strings out (``n_chars`` follows the text), the others drop whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from daypanel.llm import decontaminate, ngram_join, packing, quality_rules, suffix_dedup
from daypanel.llm.staging import staged

#: No SQL: MinHash classes, suffix arrays, SimHash windows and tokens are not SQL-expressible.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cut(docs)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", length).select(docs.columns) if "n_chars" in docs.columns else out


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
