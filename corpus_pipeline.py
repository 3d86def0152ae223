"""A corpus pipeline of five stages: each takes and returns documents, the last the training order.

Defined results of ``run``: without labels of both values nothing is toxic; null, empty and wordless
texts count as empty, of which the row with the largest doc_id survives the exact copies and, being
a near copy of any other wordless text, the least doc_id among these the near copies; it has no words
and isn't taken. Rows that repeat doc_id and text become one; rows of one doc_id with several texts
are documents of their own, though a near copy among them drops them together; rows without a doc_id
are never near copies. Of ties in any order the doc_id decides. Very long texts are read whole. An
empty table gives an empty result. All columns of the input are kept, whatever their names, but for
those that the mixing stage adds: size, source_size, target, taken, position and positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterglass.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from meterglass.llm.common import SCRATCH, clean, fresh_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Toxicity, SimHash and banded alignment can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again.

    Once a stage is written, what it and the stages before it wrote for themselves is removed.
    """
    docs, since = table(spark, sf_dir, "documents"), len(SCRATCH)
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clean(spark, since, path)
    return docs
