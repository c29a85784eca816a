"""Document schema, strict JSONL reading, qrels, synonyms, and the corpora built from test tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SearchError
from tessera.functions.analyzer import norm, terms

DOC_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("category", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("price", T.DoubleType()), T.StructField("rating", T.DoubleType()),
])
TEXT_FIELDS, KEYWORD_FIELDS, NUMERIC_FIELDS = ("title", "body"), ("kind", "category", "tags"), ("price", "rating")
KINDS = ("product", "service", "document")
MAX_BATCH_DOCUMENTS, MAX_BATCH_BYTES = 1000, 8 << 20


def violations() -> Column:
    """Array of the rules that a document row breaks; empty if it is valid."""
    finite = lambda c: F.col(c).isNull() | ~(F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit("")))
    rules = [
        ("id_size", F.col("id").isNotNull() & size("id").between(1, 128)),
        ("title_blank", F.col("title").isNotNull() & (F.trim("title") != "")),
        ("title_size", size("title") <= 1024),
        ("text_size", size("title") + size("body") <= 65536),
        ("kind", F.col("kind").isin(*KINDS)),
        ("category_size", size("category") <= 256),
        ("tags_count", F.coalesce(F.size("tags"), F.lit(0)) <= 64),
        ("tags_size", ~F.coalesce(F.exists("tags", lambda t: t.isNull() | (F.octet_length(t) > 256)), F.lit(False))),
        ("price", F.col("price").isNull() | (finite("price") & (F.col("price") >= 0))),
        ("rating", F.col("rating").isNull() | (finite("rating") & F.col("rating").between(0, 5))),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSONL file with ``violations``."""
    return parse_jsonl(spark.read.text(path))


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """Documents of JSON lines ``value``, with ``violations``; unknown keys and coerced types are violations, blank lines are skipped."""
    allowed = F.array(*[F.lit(f.name) for f in DOC_SCHEMA])
    raw = lines.where(F.trim("value") != "")
    doc = raw.withColumn("d", F.from_json("value", DOC_SCHEMA)).withColumn("m", F.from_json("value", T.MapType(T.StringType(), T.StringType())))
    number = lambda c: F.get_json_object("value", f"$.{c}")
    quoted = lambda c: F.col("value").rlike(rf'"{c}"\s*:\s*(?:"|true|false)')
    extra = F.array_compact(F.array(
        F.when(F.col("m").isNull(), F.lit("not_json")),
        F.when(F.size(F.array_except(F.json_object_keys("value"), allowed)) > 0, F.lit("unknown_field")),
        *[F.when(number(c).isNotNull() & quoted(c), F.lit(f"{c}_type")) for c in NUMERIC_FIELDS],
    ))
    out = doc.select("d.*", extra.alias("extra")).withColumn("body", F.coalesce("body", F.lit(""))).withColumn("kind", F.coalesce("kind", F.lit("document")))
    out = out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.withColumn("violations", F.array_union("extra", violations())).drop("extra")


def vector_violation(column: str, dimension: int) -> Column:
    v = F.col(column)
    bad = v.isNull() | (F.size(v) != dimension) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (norm(v) < 1e-6)
    return F.coalesce(bad, F.lit(True))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_id, grade`` from 3 or 4 whitespace columns.

    Only a header in the first line is skipped; any other malformed line and a repeated judgment are errors.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("p", F.split(F.trim("value"), r"\s+"))
    shaped = F.size("p").isin(3, 4)
    judged = shaped & F.element_at("p", -1).rlike(r"^-?\d+$")
    first = lines.select("value", shaped.alias("shaped")).first()
    header = first.value if first and first.shaped else None
    bad = lines.where(~judged & ~F.col("value").eqNullSafe(F.lit(header))).select("value").first()
    if bad:
        raise SearchError("INVALID_QRELS", "malformed judgment", line=bad.value)
    out = lines.where(judged).select(F.col("p")[0].alias("query_id"), F.element_at("p", -2).alias("doc_id"), F.element_at("p", -1).cast("int").alias("grade"))
    if not out.groupBy("query_id", "doc_id").count().where("count > 1").isEmpty():
        raise SearchError("INVALID_QRELS", "duplicate judgment")
    return out


def load_synonyms(path: str) -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """Synonym rules ``{"rules": [{"from", "to": [...], "direction"}]}``, normalised to terms."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f).get("rules")
    if not isinstance(rules, list) or len(rules) > 1000:
        raise SearchError("SYNONYM_CONFIG_ERROR", "at most 1000 rules")
    out: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for rule in rules:
        source, targets = tuple(terms(rule.get("from", ""))), [tuple(terms(t)) for t in rule.get("to", [])]
        if rule.get("direction") not in ("one_way", "equivalent") or not 1 <= len(targets) <= 4 or any(not 1 <= len(t) <= 16 for t in [source, *targets]):
            raise SearchError("SYNONYM_CONFIG_ERROR", "bad rule", rule=rule)
        family = [source, *targets]
        for a in family if rule["direction"] == "equivalent" else family[:1]:
            out.setdefault(a, []).extend(t for t in family if t != a and t not in out.get(a, []))
    return out


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test table ``documents`` (with ``labels``) on the document schema; title: start of line one."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    title = F.left(F.substring_index("text", "\n", 1), F.lit(200))
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"), title.alias("title"), F.expr("substring(text, length(left(substring_index(text, '\\n', 1), 200)) + 1)").alias("body"),
        F.lit("document").alias("kind"), F.col("lang").alias("category"), F.array("source").alias("tags"),
        F.lit(None).cast("double").alias("price"), (F.col("quality") * 5.0).alias("rating"), "doc_id",
    )


def parts_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("part-"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("body"),
        F.lit("product").alias("kind"), F.col("p_type").alias("category"), F.array("p_brand").alias("tags"),
        F.col("p_retailprice").alias("price"), ((F.col("p_size") % 11) / 2.0).alias("rating"),
    )
