"""``python -m tessera.cli PATH COMMAND``.

PATH is an index: create, ingest, delete, refresh, compact, gc, stats, verify, search, lab, export; or a folder
that ``export`` wrote: cluster-search, cluster-status; or, for ``config``, a settings file, which is checked and printed.

``ingest`` takes batches of BATCH lines; a batch with an invalid document is refused whole and ends the command.
An index created with ``--dimension`` is filled and asked with sketches of terms unless ``--fingerprint`` names a
model, whose vectors then have to come through the library.
"""

from __future__ import annotations

import argparse
import dataclasses
import itertools
import json
import sys

from pyspark.sql import SparkSession

from tessera.errors import SearchError
from tessera.evaluation import lab
from tessera.functions.embedding import CachedQueries, EmbeddingProvider, TermSketch
from tessera.plans.cluster import Cluster, export
from tessera.plans.engine import SearchEngine, SearchRequest
from tessera.settings import load_settings
from tessera.sources.documents import load_synonyms, parse_jsonl, read_jsonl, read_qrels
from tessera.sources.store import Index

BATCH = 500


def provider_for(config: dict) -> EmbeddingProvider | None:
    """The built-in sketch, if the index was made for it."""
    sketch = TermSketch(config["dimension"]) if config["dimension"] else None
    return sketch if sketch and sketch.fingerprint == config["fingerprint"] else None


def ingest(index: Index, file: str) -> int:
    """Append the documents of a JSONL file batch by batch; returns the last accepted revision."""
    last = index.durable_revision()
    provider = provider_for(index.config)
    with open(file, encoding="utf-8") as lines:
        filled = (line.rstrip("\n") for line in lines if line.strip())
        while some := list(itertools.islice(filled, BATCH)):
            parsed = parse_jsonl(index.spark.createDataFrame([(x,) for x in some], "value string"))
            bad = parsed.where("size(violations) > 0").select("id", "violations").first()
            if bad:
                raise SearchError("INVALID_DOCUMENT", "a document is not valid", 422, id=bad["id"], violations=bad["violations"])
            last = index.ingest(parsed, provider=provider)
    return last


def run_lab(index: Index, a: argparse.Namespace) -> dict:
    """Judged queries under all settings, from files that must belong to the index; writes the report."""
    queries, qrels = lab.load_queries(a.queries), read_qrels(index.spark, a.qrels)
    provider = provider_for(index.config)
    engine = SearchEngine(index.snapshot(), CachedQueries(provider) if provider else None, load_synonyms(a.synonyms) if a.synonyms else None)
    lab.check_inputs(queries, qrels, read_jsonl(index.spark, a.documents), engine)
    found = lab.judged(lab.runs(engine, queries), qrels).persist()
    try:
        return lab.write_report(found, a.output, {"inputs": lab.input_checksums(a.queries, a.qrels, a.documents)})
    finally:
        found.unpersist()


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("path")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("refresh", "compact", "gc", "stats", "verify", "config", "cluster-status"):
        sub.add_parser(name)
    c = sub.add_parser("create")
    c.add_argument("--dimension", type=int, default=0)
    c.add_argument("--fingerprint")
    sub.add_parser("ingest").add_argument("file")
    sub.add_parser("delete").add_argument("id")
    e = sub.add_parser("export")
    e.add_argument("target")
    e.add_argument("--shards", type=int, default=3)
    e.add_argument("--replicas", type=int, default=1)
    judge = sub.add_parser("lab")
    for name in ("documents", "queries", "qrels", "output"):
        judge.add_argument(name)
    judge.add_argument("--synonyms")
    for name in ("search", "cluster-search"):
        s = sub.add_parser(name)
        s.add_argument("q")
        s.add_argument("--dsl", action="store_true")
        s.add_argument("--top-k", type=int, default=10)
        s.add_argument("--candidate-k", type=int, default=100)
        s.add_argument("--mode", choices=("lexical", "semantic", "hybrid"))
        s.add_argument("--synonyms")
        s.add_argument("--no-typos", action="store_true")
        s.add_argument("--lexical-fallback", action="store_true")
        s.add_argument("--timeout-ms", type=int, default=5000)
        s.add_argument("--explain", action="store_true")
        s.add_argument("--partial", action="store_true", help="cluster-search: answer from the shards there are")
    return p


def _request(a: argparse.Namespace) -> SearchRequest:
    return SearchRequest(
        a.q, query_mode="dsl" if a.dsl else "plain", top_k=a.top_k, candidate_k=a.candidate_k, mode=a.mode, typo_tolerance=not a.no_typos,
        allow_lexical_fallback=a.lexical_fallback, explain=a.explain, timeout_ms=a.timeout_ms,
    )


def _run(a: argparse.Namespace) -> object:
    if a.command == "config":
        return dataclasses.asdict(load_settings(a.path))
    spark = SparkSession.builder.getOrCreate()
    if a.command.startswith("cluster-"):
        cluster = Cluster(spark, a.path, synonyms=load_synonyms(a.synonyms) if getattr(a, "synonyms", None) else None)
        cluster.provider = provider_for(cluster.epoch["config"])
        if a.command == "cluster-status":
            return {"ready": cluster.ready(), "shards": [vars(s) for s in cluster.states()]}
        return cluster.search(_request(a), allow_partial=a.partial)
    making = {}
    if a.command == "create":
        sketched = TermSketch(a.dimension).fingerprint if a.dimension and not a.fingerprint else a.fingerprint
        making = {"create": True, "dimension": a.dimension, "fingerprint": sketched}
    with Index(spark, a.path, read_only=a.command in ("search", "stats", "verify", "lab", "export"), **making) as index:
        if a.command == "ingest":
            return ingest(index, a.file)
        if a.command == "delete":
            return index.delete(a.id)
        if a.command == "search":
            return SearchEngine(index.snapshot(), provider_for(index.config), load_synonyms(a.synonyms) if a.synonyms else None).search(_request(a))
        if a.command == "lab":
            return run_lab(index, a)
        if a.command == "export":
            return export(index.snapshot(), a.target, a.shards, a.replicas)
        if a.command == "verify":
            index.verify()
        return {"refresh": index.refresh, "compact": index.compact, "gc": index.garbage_collect}.get(a.command, index.stats)()


def main(argv: list[str] | None = None) -> None:
    try:
        print(json.dumps(_run(_arguments().parse_args(argv)), default=str))
    except SearchError as e:
        print(json.dumps(e.as_dict(), default=str), file=sys.stderr)
        raise SystemExit(1) from e


if __name__ == "__main__":
    main()
