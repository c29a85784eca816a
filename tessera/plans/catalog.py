"""The published tables that the registered queries read: built once per application and folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.sources.documents import corpus

_published: dict[tuple[str, str], Published] = {}
_local: list[str] = []


@dataclass(frozen=True)
class Published:
    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    df: DataFrame
    buckets: int

    def hits(self, words: list[str]) -> DataFrame:
        return lexical.pruned(self.postings, words, self.buckets)

    def frequencies(self, words: list[str]) -> DataFrame:
        return lexical.pruned(self.df, words, self.buckets)


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode, where driver and executors share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tessera-catalog-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def publish(spark: SparkSession, documents: DataFrame, root: str) -> Published:
    """Write documents, postings in term buckets, statistics and document frequencies below ``root``, and read them."""
    read = lambda t: spark.read.parquet(f"{root}/{t}")
    lexical.analyzed(documents, arrays=False).write.parquet(f"{root}/docs")
    docs = read("docs")
    buckets = lexical.write_postings(docs, f"{root}/postings")
    posted = read("postings")
    lexical.stats_of(posted).coalesce(1).write.parquet(f"{root}/stats")
    lexical.write_frequencies(lexical.count_frequencies(posted), f"{root}/df")
    return Published(docs, posted, read("stats"), read("df"), buckets)


def published(spark: SparkSession, sf_dir: str) -> Published:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _published:
        _published[key] = publish(spark, corpus(spark, sf_dir), f"{shared_root(spark)}/catalog-{uuid.uuid4().hex}")
    return _published[key]
