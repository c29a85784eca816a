"""A published snapshot dealt to shards, and searches over those shards that can be read.

``export`` writes below a new folder::

    epoch.json                      the routing, the global statistics' fingerprint, the index's settings
    stats, df                       global: scores do not depend on which shards answer
    replica-N/docs, postings        all shards' rows, partitioned by shard (postings also by term bucket)
    replica-N/shard-K.json          what replica N holds of shard K

A shard is read from the first replica whose description fits the epoch. Its tasks are Spark's to place and
to retry; a replica that vanishes while it is read is replaced by the next once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SearchError
from tessera.operators import lexical
from tessera.operators.retrieval import shard_of
from tessera.plans.engine import SearchEngine, SearchRequest
from tessera.sources.store import SCHEMAS, Snapshot

ROUTING = "sha256-8-mod"
MOST_SHARDS, MOST_REPLICAS = 32, 3


def _fingerprint(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def export(snapshot: Snapshot, target: str, shards: int = 3, replicas: int = 1) -> dict:
    """Write ``snapshot`` as ``shards`` shards with ``replicas`` copies beside the first; returns the epoch."""
    root = Path(target)
    if not 1 <= shards <= MOST_SHARDS or not 0 <= replicas <= MOST_REPLICAS:
        raise SearchError("INVALID_TOPOLOGY", "shard or replica count out of range")
    if root.exists():
        raise SearchError("EXPORT_EXISTS", "the folder exists", 409)
    root.mkdir(parents=True)
    shard, sizes = shard_of(F.col("id"), shards), dict.fromkeys(range(shards), 0)
    for row in snapshot.docs.groupBy(shard.alias("shard")).count().collect():
        sizes[row["shard"]] = row["count"]
    files = 1 + max(sizes.values()) // lexical.FILE_DOCUMENTS
    part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(files))
    for replica in range(replicas + 1):
        out = f"{root}/replica-{replica}"
        docs = snapshot.docs.withColumn("shard", shard).repartition("shard", part)
        docs.write.partitionBy("shard").parquet(f"{out}/docs")
        posted = snapshot.postings.withColumn("shard", shard).repartition(F.col("shard"), F.col("bucket"), part)
        posted.sortWithinPartitions("shard", "bucket", "term", "field", "id").write.partitionBy("shard", "bucket").parquet(f"{out}/postings")
    snapshot.stats.coalesce(1).write.parquet(f"{root}/stats")
    snapshot.df.repartition("bucket").sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").parquet(f"{root}/df")
    stats = sorted([r.field, r.n, r.total_length] for r in snapshot.stats.collect())
    epoch = {
        "epoch": uuid.uuid4().hex, "routing": ROUTING, "shards": shards, "replicas": replicas, "stats_fingerprint": _fingerprint(stats),
        "config": snapshot.config, "generation": snapshot.manifest["generation"], "buckets": snapshot.buckets,
    }
    for replica in range(replicas + 1):
        for k, size in sizes.items():
            (root / f"replica-{replica}" / f"shard-{k}.json").write_text(json.dumps(_description(epoch, k) | {"documents": size}))
    (root / "epoch.json").write_text(json.dumps(epoch, sort_keys=True))
    return epoch


def _description(epoch: dict, shard: int) -> dict:
    return {"shard": shard, "model": epoch["config"]["fingerprint"], **{k: epoch[k] for k in ("epoch", "stats_fingerprint", "generation")}}


@dataclass(frozen=True)
class ShardState:
    shard: int
    status: str
    replica: int | None = None
    attempts: int = 1


class Cluster:
    """Searches an exported folder."""

    def __init__(self, spark: SparkSession, path: str, provider=None, synonyms: dict | None = None):
        self.spark, self.root, self.provider, self.synonyms = spark, Path(path), provider, synonyms
        if not (self.root / "epoch.json").exists():
            raise SearchError("EPOCH_NOT_FOUND", "no exported cluster here", 404)
        self.epoch = json.loads((self.root / "epoch.json").read_text())

    def _replica_state(self, shard: int, replica: int) -> str:
        folder = self.root / f"replica-{replica}"
        try:
            found = json.loads((folder / f"shard-{shard}.json").read_text())
        except (OSError, ValueError):
            return "SHARD_UNAVAILABLE"
        if any(found.get(k) != v for k, v in _description(self.epoch, shard).items()):
            return "EPOCH_MISMATCH"
        if found.get("documents") and not (folder / "docs" / f"shard={shard}").is_dir():
            return "SHARD_UNAVAILABLE"
        return "ok"

    def states(self) -> list[ShardState]:
        """Of every shard the first fitting replica, or why there is none."""
        out = []
        for k in range(self.epoch["shards"]):
            tried = []
            for replica in range(self.epoch["replicas"] + 1):
                tried.append(self._replica_state(k, replica))
                if tried[-1] == "ok":
                    out.append(ShardState(k, "ok", replica, len(tried)))
                    break
            else:
                out.append(ShardState(k, "EPOCH_MISMATCH" if "EPOCH_MISMATCH" in tried else "SHARD_UNAVAILABLE", None, len(tried)))
        return out

    def ready(self) -> bool:
        return all(s.status == "ok" for s in self.states())

    def _table(self, name: str, by_replica: dict[int, list[int]]) -> DataFrame:
        kinds = {"postings": f"{SCHEMAS['postings']}, shard int"}
        parts = []
        for replica, shards in by_replica.items():
            folder = self.root / f"replica-{replica}" / name
            reader = self.spark.read.schema(kinds[name]) if name in kinds else self.spark.read
            if folder.is_dir():
                parts.append(reader.parquet(str(folder)).where(F.col("shard").isin(shards)).drop("shard"))
        if not parts:
            raise SearchError("INCOMPLETE_COVERAGE", "no shard can be read", 503)
        return reduce(DataFrame.unionByName, parts)

    def snapshot(self, states: list[ShardState]) -> SimpleNamespace:
        """The tables of the given shards with the statistics of all."""
        by_replica: dict[int, list[int]] = defaultdict(list)
        for s in states:
            if s.replica is not None:
                by_replica[s.replica].append(s.shard)
        df = self.spark.read.schema(SCHEMAS["df"]).parquet(str(self.root / "df"))
        return SimpleNamespace(
            docs=self._table("docs", by_replica), postings=self._table("postings", by_replica), stats=self.spark.read.parquet(str(self.root / "stats")), df=df,
            config=self.epoch["config"], buckets=self.epoch["buckets"], manifest={"generation": self.epoch["generation"]},
        )

    def search(self, request: SearchRequest, allow_partial: bool = False) -> dict:
        """The hits of all shards, or with ``allow_partial`` of those that answer; each branch is merged over the shards before fusion."""
        states = self.states()
        for last in (False, True):
            good = [s for s in states if s.status == "ok"]
            partial = len(good) < len(states)
            if not good or partial and not allow_partial:
                raise SearchError("INCOMPLETE_COVERAGE", "shards are missing", 503, shards=[vars(s) for s in states])
            try:
                out = SearchEngine(self.snapshot(good), self.provider, self.synonyms).search(request)
                break
            except SearchError as e:
                if e.code == "DEADLINE_EXCEEDED":
                    raise SearchError("INCOMPLETE_COVERAGE", "the shards did not answer in time", 504, shards=[vars(s) for s in states]) from e
                raise
            except Exception:
                now = self.states()
                if last or now == states:
                    raise
                states = now
        return {
            **out, "partial": partial, "snapshot_epoch": self.epoch["epoch"], "shards": [vars(s) for s in states],
            "coverage": {"successful": len(good), "total": len(states)}, "warnings": [*out["warnings"], *(["partial_results"] if partial else [])],
        }
