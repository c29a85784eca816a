"""A training-data pipeline: ``STAGES`` applied in turn to ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
reread as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import remove_benchmark_spans
from tessera.llm.line_dedup import remove_repeated_runs
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.packing import best_fit_packing
from tessera.llm.toxicity import fit_toxicity, reject_toxic
from tessera.llm.workspace import Workspace, fresh


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return reject_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated content-defined chunks, and by an exact pass all other repeated runs of two lines or more, go from all places but the first."""
    return remove_repeated_runs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Rows without a doc_id stay, as do all rows of the doc_id that stays.
    """
    joined = ngram_jaccard_join(docs)
    gone = joined.where("component_id <> doc_id").select(F.col("doc_id").alias(name := fresh(docs.columns, "gone")[0])).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return remove_benchmark_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Kneser-Ney scoring and best-fit packing cannot be put in SQL; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for _, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir))
    return docs
