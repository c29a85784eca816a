"""Ablations: the same judged queries under several search settings, with summaries and a report.

``runs`` asks every query under every setting; relevance and summaries are computed by Spark.
``write_report`` stores one JSONL file per setting, ``report.json`` and an escaped ``report.html``.
"""

from __future__ import annotations

import hashlib
import html
import json
import platform
import statistics
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import SearchError
from tessera.operators.retrieval import relevance, summarize
from tessera.plans.engine import Filter, SearchEngine, SearchRequest

RUN_SCHEMA = "system string, query_id string, text string, groups array<string>, latency_ms double, error string, hits array<struct<id:string,title:string,score:double>>"


def settings(semantic: bool) -> dict[str, dict]:
    """Search settings by name; those that need vectors only where there are some."""
    lexical = {
        name: {"mode": "lexical", "typo_tolerance": typos, "synonyms": synonyms}
        for name, typos, synonyms in (("exact_lexical", False, False), ("fuzzy", True, False), ("synonyms", False, True), ("expanded_lexical", True, True))
    }
    dense = {"semantic": {"mode": "semantic", "typo_tolerance": False, "synonyms": False}, "hybrid": {"mode": "hybrid"}}
    return lexical | (dense if semantic else {})


def load_queries(path: str) -> list[dict]:
    """Judged queries of a JSONL file: ``id``, ``text``, and optionally ``split``, ``subset`` and ``filters``."""
    queries = [json.loads(line) for line in Path(path).read_text(encoding="utf-8").splitlines() if line.strip()]
    for q in queries:
        if not isinstance(q.get("id"), str) or not isinstance(q.get("text"), str):
            raise SearchError("INVALID_QUERIES", "a query needs an id and a text", query=q)
    return queries


def check_inputs(queries: list[dict], qrels: DataFrame, documents: DataFrame, engine: SearchEngine) -> None:
    """Judgments must name known queries and documents, and the index must hold exactly the corpus."""
    spark = engine.spark
    known = spark.createDataFrame([(q["id"],) for q in queries], "query_id string")
    for found, code in (
        (qrels.join(known, "query_id", "left_anti").select(F.col("query_id").alias("id")), "UNKNOWN_QUERY"),
        (qrels.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(F.col("doc_id").alias("id")), "UNKNOWN_DOCUMENT"),
        (documents.select("id").exceptAll(engine.snapshot.docs.select("id")).union(engine.snapshot.docs.select("id").exceptAll(documents.select("id"))), "CORPUS_MISMATCH"),
    ):
        row = found.first()
        if row:
            raise SearchError(code, "the inputs do not belong together", id=row["id"])


def input_checksums(*paths: str) -> dict[str, str]:
    """SHA-256 of each input file, for the report's metadata."""
    return {Path(p).name: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in paths}


def spread(values: list[float]) -> dict[str, float]:
    """Least, middle and greatest of repeated runs."""
    return {"min": min(values), "median": statistics.median(values), "max": max(values)}


def groups_of(query: dict) -> list[str]:
    """The summaries that a query counts in."""
    if query.get("split", "test") != "test":
        return ["all"]
    return ["all", "held_out", query.get("subset", "default")]


def runs(engine: SearchEngine, queries: list[dict], candidate_k: int = 100) -> DataFrame:
    """One row per setting and query; a missed deadline is an error row, other errors are raised."""
    if len({q["id"] for q in queries}) < len(queries):
        raise SearchError("INVALID_QUERIES", "a query id repeats")
    rows = []
    for system, chosen in settings(engine.provider is not None).items():
        for q in queries:
            filters = tuple(Filter(**f) for f in q.get("filters", ()))
            request = SearchRequest(q["text"], filters=filters, top_k=min(100, candidate_k), candidate_k=candidate_k, timeout_ms=5000, **chosen)
            begun, error, hits = time.perf_counter(), None, []
            try:
                hits = engine.search(request)["hits"]
            except SearchError as e:
                if e.code != "DEADLINE_EXCEEDED":
                    raise
                error = e.code
            took = (time.perf_counter() - begun) * 1000
            rows.append((system, q["id"], q["text"], groups_of(q), took, error, [(h["id"], h["document"]["title"], float(h["score"])) for h in hits]))
    return engine.spark.createDataFrame(rows, RUN_SCHEMA)


def judged(found: DataFrame, qrels: DataFrame) -> DataFrame:
    """``found`` with the five metrics; queries without judgments get zeros."""
    placed = found.select(F.to_json(F.struct("system", "query_id")).alias("query_id"), F.posexplode("hits").alias("place", "hit"))
    placed = placed.select("query_id", F.col("hit.id").alias("doc_id"), (F.col("place") + 1).alias("rank"))
    wanted = found.select("system", "query_id").join(qrels, "query_id").select(F.to_json(F.struct("system", "query_id")).alias("query_id"), "doc_id", "grade")
    scores = relevance(placed, wanted).withColumnRenamed("query_id", "_run")
    names = [c for c in scores.columns if c != "_run"]
    joined = found.join(scores, F.to_json(F.struct("system", "query_id")) == F.col("_run"), "left").drop("_run")
    return joined.fillna(0.0, names)


def write_report(found: DataFrame, output: str, metadata: dict | None = None) -> dict:
    """Write the judged runs and their summaries below ``output``; returns the summaries."""
    target = Path(output)
    target.mkdir(parents=True, exist_ok=True)
    summary: dict[str, dict] = {}
    for row in summarize(found.withColumn("error", F.col("error").isNotNull())).orderBy("system", "grp").collect():
        values = row.asDict()
        summary.setdefault(values.pop("system"), {})[values.pop("grp")] = values
    by_system: dict[str, list[dict]] = {}
    for row in found.orderBy("system", "query_id").collect():
        by_system.setdefault(row["system"], []).append(row.asDict(recursive=True))
    about = {"platform": platform.platform(), "python": platform.python_version(), **(metadata or {})}
    for system, rows in by_system.items():
        (target / f"{system}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    (target / "report.json").write_text(json.dumps({"metadata": about, "summary": summary, "runs": by_system}), encoding="utf-8")
    (target / "report.html").write_text(page(by_system, summary, about), encoding="utf-8")
    return summary


def page(by_system: dict[str, list[dict]], summary: dict, about: dict) -> str:
    """A static page; everything that comes from data is escaped."""
    e = html.escape
    parts = ["<!doctype html><meta charset=utf-8><title>Relevance runs</title><h1>Relevance runs</h1>"]
    for system, rows in by_system.items():
        parts.append(f"<h2>{e(system)}</h2><table><tr><th>query<th>nDCG@10<th>hits</tr>")
        for r in rows:
            titles = "; ".join(f"{h['id']}: {h['title']}" for h in r["hits"][:10])
            parts.append(f"<tr><td>{e(r['text'])}<td>{r['ndcg_10']:.3f}<td>{e(titles)}</tr>")
        parts.append("</table>")
    parts.append(f"<h2>Summary</h2><pre>{e(json.dumps({'metadata': about, 'summary': summary}, indent=1))}</pre>")
    return "\n".join(parts)
