"""Corpora for measurements: an unpacked judged collection, generated text of any size, and a judged grid of intents."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SearchError
from tessera.sources.documents import DOC_SCHEMA, read_qrels


def unpack(archive: str, folder: str, md5: str) -> None:
    """Unpack a zip file that has the given checksum and no entry outside ``folder``."""
    digest = hashlib.md5()
    with open(archive, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    if digest.hexdigest() != md5:
        raise SearchError("CHECKSUM_MISMATCH", "not the expected archive", found=digest.hexdigest())
    top = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (top / name).resolve().is_relative_to(top):
                raise SearchError("UNSAFE_ARCHIVE", "an entry leaves the folder", name=name)
        z.extractall(top)


def prepare_judged(spark: SparkSession, folder: str, output: str, subset: str) -> dict:
    """From ``corpus.jsonl``, ``queries.jsonl`` and ``qrels/test.tsv`` the lab's ``documents`` and ``queries.jsonl``.

    A document without a title is called by its id. Only judged queries are taken; these few go to one file.
    """
    target = Path(output)
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    title = F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("_id"))
    documents = corpus.select(F.col("_id").alias("id"), title.alias("title"), F.col("text").alias("body"), F.lit("document").alias("kind"))
    documents.write.json(str(target / "documents"))
    judged = read_qrels(spark, f"{folder}/qrels/test.tsv").select(F.col("query_id").alias("_id")).distinct()
    asked = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").join(judged, "_id", "left_semi").orderBy("_id")
    count = 0
    with open(target / "queries.jsonl", "w", encoding="utf-8") as out:
        for row in asked.toLocalIterator():
            out.write(json.dumps({"id": row["_id"], "text": row["text"], "split": "test", "subset": subset}) + "\n")
            count += 1
    about = {"documents": spark.read.text(str(target / "documents")).count(), "queries": count}
    (target / "provenance.json").write_text(json.dumps(about | {"source": str(folder)}))
    return about


def _draw(*parts: Column, below: int) -> Column:
    """A number from 0 that depends on ``parts`` alone, so that every task and engine draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long") % below


def synthetic_documents(spark: SparkSession, count: int, words: int = 24, vocabulary: int = 5000, seed: int = 0) -> DataFrame:
    """``count`` documents of ``words`` terms ``t0``, ``t1``, ...; the product of two draws makes low numbers frequent."""
    key = lambda k: (F.lit(seed), F.col("n"), k)
    term = lambda k: F.concat(F.lit("t"), F.floor(_draw(*key(k), F.lit("a"), below=vocabulary) * _draw(*key(k), F.lit("b"), below=vocabulary) / vocabulary))
    numbered = spark.range(count).withColumnRenamed("id", "n")
    return numbered.select(
        F.concat(F.lit("syn-"), "n").alias("id"), F.concat(F.lit("topic"), F.col("n") % 100).alias("title"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: term(k)), " ").alias("body"), F.lit("document").alias("kind"),
        F.concat(F.lit("c"), F.col("n") % 7).alias("category"), F.array(F.concat(F.lit("g"), F.col("n") % 3)).alias("tags"),
        F.lit(None).cast("double").alias("price"), (_draw(*key(F.lit("rating")), below=11) / 2).alias("rating"),
    ).select(*DOC_SCHEMA.names)


def judged_grid(spark: SparkSession, intents: list[tuple[str, str, str]], relevant: int = 3, distractors: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries ``(id, text)`` and judgments of ``intents``: what is asked, how an answer says it, what it is confused with.

    The first answer has grade 2, the other ones 1, distractors 0.
    """
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(intents)], "i int, asked string, answered string, confused string")
    placed = table.select("*", F.posexplode(F.sequence(F.lit(1), F.lit(relevant + distractors))).alias("k", "_")).drop("_")
    good = F.col("k") < relevant
    named = placed.select(
        F.format_string("intent-%03d-%02d", F.col("i"), F.col("k")).alias("id"), F.format_string("q-%03d", F.col("i")).alias("query_id"),
        F.when(good, F.col("answered")).otherwise(F.col("confused")).alias("said"), "k", F.when(F.col("k") == 0, 2).when(good, 1).otherwise(0).alias("grade"),
    )
    documents = named.select(
        "id", F.concat_ws(" ", "said", F.col("k").cast("string")).alias("title"), F.concat(F.lit("Offer of "), F.col("said")).alias("body"), F.lit("service").alias("kind"),
        F.lit("grid").alias("category"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("rating"),
    ).select(*DOC_SCHEMA.names)
    return documents, table.select(F.format_string("q-%03d", F.col("i")).alias("id"), F.col("asked").alias("text")), named.select("query_id", F.col("id").alias("doc_id"), "grade")
