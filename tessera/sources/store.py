"""Journal and immutable generations of an index, as Parquet plus one atomically swapped pointer.

``journal/`` holds batches of mutations (``revision, id, document, vector``; a null document deletes).
``refresh`` coalesces the tail and writes a segment of its documents: ``docs/at=N`` and ``postings/at=N``
(in term buckets), and to ``gone/at=N`` the ids of live documents that it replaces or deletes. A row of
segment M is live unless its id is in some ``gone`` with N > M. A generation is a list of segments and
``gone`` tables with their ``stats`` and ``df``, which a refresh changes by what came and what went.
Searches read the generation that the pointer names, so an unfinished refresh is invisible and open
readers keep theirs. With more than MOST_SEGMENTS segments the MERGED with fewest documents become one;
when a quarter of the documents has been replaced, everything is rewritten.
"""

from __future__ import annotations

import fcntl
import functools
import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SearchError
from tessera.functions.embedding import EmbeddingProvider, encode
from tessera.operators import lexical
from tessera.operators.retrieval import coalesce_mutations
from tessera.sources.documents import DOC_SCHEMA, MAX_BATCH_BYTES, MAX_BATCH_DOCUMENTS, vector_violation, violations

FORMAT = "tessera-1"
MAX_PENDING, KEPT_GENERATIONS = 100_000, 3
#: Documents of one journal file and of one file of a generation, so that a file can be hashed in one piece.
JOURNAL_FILE, DOCUMENT_FILE = 10_000, 20_000
MOST_SEGMENTS, MERGED = 8, 4
POSTED_SCHEMA = f"{lexical.POSTINGS}, bucket int"
SCHEMAS = {
    "docs": "id string, title string, body string, kind string, category string, tags array<string>, price double, rating double, vector array<float>, revision long, kind_n string, category_n string, tags_n array<string>",
    "postings": POSTED_SCHEMA, "gone": "id string", "df": "field string, term string, df long, bucket int", "stats": "field string, n long, total_length long",
}
JOURNAL_SCHEMA = T.StructType([T.StructField("revision", T.LongType()), T.StructField("id", T.StringType()), T.StructField("document", DOC_SCHEMA), T.StructField("vector", T.ArrayType(T.FloatType()))])
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}")


def check_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise SearchError("INVALID_INDEX_NAME", "bad index name")
    return name


class Index:
    def __init__(self, spark: SparkSession, path: str, create: bool = False, dimension: int = 0, fingerprint: str | None = None, read_only: bool = False, hook: Callable[[str], None] = lambda at: None):
        self.spark, self.root, self.read_only, self.hook = spark, Path(path), read_only, hook
        self._lock, self.truncated_documents = None, 0
        config = self.root / "config.json"
        if create:
            if config.exists():
                raise SearchError("INDEX_EXISTS", "index exists", 409)
            check_name(self.root.name)
            (self.root / "journal").mkdir(parents=True)
            (self.root / "generations").mkdir()
            config.write_text(json.dumps({"format": FORMAT, "dimension": dimension, "fingerprint": fingerprint}))
        if not config.exists():
            raise SearchError("INDEX_NOT_FOUND", "no such index", 404)
        self.config = json.loads(config.read_text())
        if self.config.get("format") != FORMAT:
            raise SearchError("FORMAT_MISMATCH", "unknown format", 409)
        if not read_only:
            self._lock = open(self.root / "writer.lock", "w")  # noqa: SIM115
            try:
                fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                raise SearchError("WRITER_CONFLICT", "another writer is open", 409) from None

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self._lock:
            self._lock.close()
            self._lock = None

    def _writer(self) -> None:
        if self.read_only or self._lock is None:
            raise SearchError("READ_ONLY", "index is open for reading", 409)

    # mutations

    def journal(self) -> DataFrame:
        batches = sorted(str(p) for p in (self.root / "journal").glob("batch-*"))
        return self.spark.read.schema(JOURNAL_SCHEMA).parquet(*batches) if batches else self.spark.createDataFrame([], JOURNAL_SCHEMA)

    def durable_revision(self) -> int:
        ends = [int(p.name.split("-")[2]) for p in (self.root / "journal").glob("batch-*")]
        return max(ends, default=0)

    def visible_revision(self) -> int:
        manifest = self.manifest()
        return manifest["revision"] if manifest else 0

    def _append(self, rows: DataFrame, count: int) -> int:
        first = self.durable_revision() + 1
        if first + count - 1 - self.visible_revision() > MAX_PENDING:
            raise SearchError("OVERLOADED", "too many unpublished mutations", 429)
        staged = self.root / f"staging-{uuid.uuid4().hex}"
        rows.withColumn("revision", F.col("revision") + first).select(*JOURNAL_SCHEMA.names).coalesce(1 + count // JOURNAL_FILE).write.parquet(str(staged))
        self.hook("staged")
        os.replace(staged, self.root / "journal" / f"batch-{first:012d}-{first + count - 1:012d}")
        self.hook("accepted")
        return first + count - 1

    def ingest(self, documents: DataFrame, vectors: bool = False, batch_limits: bool = True, provider: EmbeddingProvider | None = None) -> int:
        """Append one batch of documents (all or none); returns the last accepted revision.

        Vectors come with the documents or from ``provider``, whose model must be the index's.
        """
        self._writer()
        names = DOC_SCHEMA.names
        if provider is not None:
            if (provider.fingerprint, provider.dimension) != (self.config["fingerprint"], self.config["dimension"]):
                raise SearchError("MODEL_MISMATCH", "the index takes vectors of another model", 409)
            documents, vectors = encode(documents, provider), True
        checked = documents.withColumn("_bad", violations()).persist()
        try:
            size = F.octet_length(F.to_json(F.struct(*names)))
            facts = checked.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(size).alias("bytes"), F.count(F.when(F.size("_bad") > 0, 1)).alias("bad"), F.count(F.when(F.col("truncated") if provider else F.lit(False), 1)).alias("truncated")).first()
            if facts.bad:
                row = checked.where(F.size("_bad") > 0).select("id", "_bad").first()
                raise SearchError("INVALID_DOCUMENT", "a document is not valid", 422, id=row["id"], violations=row["_bad"])
            if batch_limits and (facts.n > MAX_BATCH_DOCUMENTS or (facts.bytes or 0) > MAX_BATCH_BYTES):
                raise SearchError("BULK_TOO_LARGE", "batch too large", 413)
            if facts.ids != facts.n:
                raise SearchError("DUPLICATE_ID", "an id repeats in the batch")
            if vectors and self.config["dimension"] and not checked.where(vector_violation("vector", self.config["dimension"])).isEmpty():
                raise SearchError("INVALID_VECTOR", "a vector is not valid")
            if not facts.n:
                return self.durable_revision()
            vector = F.col("vector") if vectors else F.lit(None).cast("array<float>")
            # Only ids go through the one window task, of MAX_PENDING rows at most; documents stay where they are read.
            order = checked.select("id").withColumn("revision", (F.row_number().over(Window.orderBy("id")) - 1).cast("long"))
            rows = checked.select("id", F.struct(*names).alias("document"), vector.cast("array<float>").alias("vector")).join(order, "id")
            last = self._append(rows, facts.n)
            self.truncated_documents += facts.truncated
            return last
        finally:
            checked.unpersist()

    def delete(self, external: str) -> int:
        self._writer()
        if not external or len(external.encode()) > 128:
            raise SearchError("INVALID_ID", "id must have 1 to 128 bytes")
        return self._append(self.spark.createDataFrame([(0, external, None, None)], JOURNAL_SCHEMA), 1)

    # publication

    def manifest(self) -> dict | None:
        pointer = self.root / "CURRENT.json"
        if not pointer.exists():
            return None
        current = json.loads(pointer.read_text())
        body = (self.root / "generations" / current["generation"] / "manifest.json").read_bytes()
        if hashlib.sha256(body).hexdigest() != current["sha256"]:
            raise SearchError("INDEX_CORRUPT", "manifest checksum differs", 500)
        return json.loads(body)

    def _read(self, table: str, ats: list[int]) -> DataFrame:
        schema = f"{SCHEMAS[table]}, at int"
        if not ats:
            return self.spark.createDataFrame([], schema)
        top = str(self.root / table)
        return self.spark.read.option("basePath", top).schema(schema).parquet(*[f"{top}/at={n}" for n in ats])

    def _live(self, table: str, segments: list[dict], gone: list[dict]) -> DataFrame:
        """The live rows of the given segments; the ids that are gone are few beside them."""
        ats = [x["at"] for x in segments]
        found = self._read(table, ats)
        later = [g["at"] for g in gone if ats and g["at"] > min(ats)]
        if not later:
            return found.drop("at")
        last = self._read("gone", later).groupBy("id").agg(F.max("at").alias("gone_at"))
        return found.join(last, "id", "left").where("gone_at is null or at >= gone_at").drop("at", "gone_at")

    def live(self, table: str, manifest: dict) -> DataFrame:
        return self._live(table, manifest["segments"], manifest["gone"])

    def _path(self, generation: str, table: str) -> str:
        return str(self.root / "generations" / generation / table)

    def counted(self, table: str, manifest: dict) -> DataFrame:
        """``stats`` or ``df`` of a generation."""
        return self.spark.read.schema(SCHEMAS[table]).parquet(self._path(manifest["generation"], table))

    def snapshot(self) -> Snapshot:
        manifest = self.manifest()
        if manifest is None:
            raise SearchError("INDEX_NOT_FOUND", "nothing is published", 404)
        for name, known in manifest["files"].items():
            if not (self.root / name).is_file() or (self.root / name).stat().st_size != known["bytes"]:
                raise SearchError("INDEX_CORRUPT", "a file is missing or cut", 500, file=name)
        return Snapshot(self, manifest)

    def _files(self, folders: list[str]) -> dict[str, dict]:
        """Checksum and size of every file below the folders of the index, computed in tasks."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([str(self.root / f) for f in folders])
        rows = found.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).collect()
        top = f"{self.root.resolve()}/"
        return {unquote(r.path).split(top, 1)[1]: {"sha256": r.sha256, "bytes": r.bytes} for r in rows}

    @staticmethod
    def _folders(manifest: dict) -> list[str]:
        kept = [f"{t}/at={x['at']}" for x in manifest["segments"] for t in ("docs", "postings")]
        return [*kept, *(f"gone/at={g['at']}" for g in manifest["gone"]), f"generations/{manifest['generation']}"]

    def verify(self) -> None:
        """Compare every file of the current generation with its recorded checksum."""
        manifest = self.manifest()
        try:
            found = self._files(self._folders(manifest)) if manifest else {}
        except Exception as e:  # the file system may know of the damage before the bytes are hashed
            damaged = re.search(rf"ChecksumException: Checksum error: \S*?{re.escape(str(self.root.resolve()))}/(\S+)", str(e))
            if not damaged:
                raise
            raise SearchError("INDEX_CORRUPT", "checksum differs", 500, file=damaged[1]) from None
        for name, known in manifest["files"].items() if manifest else ():
            if found.get(name) != known:
                raise SearchError("INDEX_CORRUPT", "checksum differs", 500, file=name)

    def refresh(self, through: int | None = None) -> int:
        """Publish everything up to the last durable revision."""
        self._writer()
        high, low = self.durable_revision(), self.visible_revision()
        if through is not None and not 0 <= through <= high:
            raise SearchError("INVALID_REVISION", "revision is not durable")
        if high == low and self.manifest():
            return high
        tail = coalesce_mutations(self.journal(), low, high).persist()
        try:
            fresh = tail.where("document is not null").select("document.*", "vector", "revision")
            fresh = lexical.analyzed(fresh, arrays=False)
            manifest = self.manifest()
            if manifest:
                self._extend(manifest, tail.select("id"), fresh, high)
            else:
                self._rewrite(fresh, high)
        finally:
            tail.unpersist()
        return high

    def compact(self) -> int:
        """Rewrite the live documents as one segment; the revision stays."""
        self._writer()
        manifest = self.snapshot().manifest
        self._rewrite(self.live("docs", manifest), manifest["revision"])
        return manifest["revision"]

    def _next(self) -> int:
        """A number above all that were ever begun."""
        used = [int(p.name.removeprefix("at=")) for t in ("docs", "postings", "gone") for p in (self.root / t).glob("at=*")]
        return 1 + max(used, default=0)

    def _segment(self, docs: DataFrame, at: int, buckets: int | None = None) -> tuple[list[dict], int | None]:
        """Write a segment; returns its entry, none if there is no document, and its number of buckets."""
        target = f"{self.root}/docs/at={at}"
        docs.write.option("maxRecordsPerFile", DOCUMENT_FILE).parquet(target)
        written = self._read("docs", [at])
        count = written.count()
        if not count:
            return [], buckets
        buckets = lexical.write_postings(written, f"{self.root}/postings/at={at}", buckets)
        return [{"at": at, "documents": count}], buckets

    def _rewrite(self, docs: DataFrame, revision: int) -> None:
        at = self._next()
        segments, buckets = self._segment(docs, at)
        posted = self._read("postings", [x["at"] for x in segments])
        self._publish(revision, segments, [], sum(x["documents"] for x in segments), buckets or lexical.LEAST_BUCKETS, lexical.stats_of(posted), lexical.count_frequencies(posted), {})

    def _extend(self, manifest: dict, ids: DataFrame, fresh: DataFrame, revision: int) -> None:
        """A generation of the last one's segments and one of ``fresh``; documents of the other segments are not written again."""
        buckets, at = manifest["buckets"], self._next()
        old = self.live("docs", manifest)
        old.select("id").join(ids, "id", "left_semi").write.parquet(f"{self.root}/gone/at={at}")
        lost = self._read("gone", [at]).count()
        gone = [*manifest["gone"], *([{"at": at, "ids": lost}] if lost else [])]
        if 4 * sum(g["ids"] for g in gone) > manifest["live"]:
            self._rewrite(old.join(ids, "id", "left_anti").unionByName(fresh), revision)
            return
        came, _ = self._segment(fresh, at, buckets)
        posted = self._read("postings", [x["at"] for x in came])
        stats = [self.counted("stats", manifest), lexical.stats_of(posted)]
        df = [self.counted("df", manifest), lexical.count_frequencies(posted)]
        if lost:
            went = lexical.index_postings(old.join(self._read("gone", [at]).select("id"), "id", "left_semi")).withColumn("bucket", lexical.bucket(F.col("term"), buckets))
            stats.append(lexical.stats_of(went).select("field", (-F.col("n")).alias("n"), (-F.col("total_length")).alias("total_length")))
            df.append(lexical.count_frequencies(went).withColumn("df", -F.col("df")))
        every = lambda tables: functools.reduce(DataFrame.unionByName, tables)
        stats = every(stats).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total_length").alias("total_length")).where("n > 0")
        df = every(df).groupBy("bucket", "field", "term").agg(F.sum("df").alias("df")).where("df > 0")
        segments, live = [*manifest["segments"], *came], manifest["live"] - lost + sum(x["documents"] for x in came)
        if len(segments) > MOST_SEGMENTS:
            small = sorted(segments, key=lambda x: (x["documents"], x["at"]))[:MERGED]
            merged, _ = self._segment(self._live("docs", small, gone), self._next(), buckets)
            segments = [x for x in segments if x not in small] + merged
        first = min((x["at"] for x in segments), default=0)
        self._publish(revision, segments, [g for g in gone if g["at"] > first], live, buckets, stats, df, manifest["files"])

    def _publish(self, revision: int, segments: list[dict], gone: list[dict], live: int, buckets: int, stats: DataFrame, df: DataFrame, known: dict) -> None:
        """Write the statistics and the manifest and swing the pointer; files of older segments keep their checksums."""
        name = uuid.uuid4().hex
        target = self.root / "generations" / name
        stats.coalesce(1).write.parquet(f"{target}/stats")
        lexical.write_frequencies(df, f"{target}/df")
        self.hook("generation")
        manifest = {"format": FORMAT, "generation": name, "revision": revision, "live": live, "buckets": buckets, "segments": segments, "gone": gone}
        folders = self._folders(manifest)
        kept = {f: v for f, v in known.items() if any(f.startswith(f"{x}/") for x in folders)}
        manifest["files"] = kept | self._files([x for x in folders if not any(f.startswith(f"{x}/") for f in kept)])
        body = json.dumps(manifest, sort_keys=True).encode()
        (target / "manifest.json").write_bytes(body)
        self.hook("manifest")
        following = self.root / "CURRENT.next"
        following.write_text(json.dumps({"generation": name, "sha256": hashlib.sha256(body).hexdigest()}))
        self.hook("pointer")
        os.replace(following, self.root / "CURRENT.json")
        self.hook("published")

    def garbage_collect(self) -> list[str]:
        """Delete all generations but the current and the two newest others, and segments that none of these names."""
        self._writer()
        current = self.snapshot().manifest["generation"]
        found = sorted((p for p in (self.root / "generations").iterdir() if p.name != current), key=lambda p: p.stat().st_mtime, reverse=True)
        for p in found:
            if p.is_symlink() or not re.fullmatch(r"[0-9a-f]{32}", p.name):
                raise SearchError("UNSAFE_GC_PATH", "unexpected path", path=str(p))
        for p in found[KEPT_GENERATIONS - 1 :]:
            shutil.rmtree(p)
        named: set[str] = set()
        for p in (self.root / "generations").iterdir():
            if (p / "manifest.json").exists():
                named.update(self._folders(json.loads((p / "manifest.json").read_text())))
        for p in [p for t in ("docs", "postings", "gone") for p in (self.root / t).glob("at=*")]:
            if str(p.relative_to(self.root)) not in named:
                shutil.rmtree(p)
        return [p.name for p in found[KEPT_GENERATIONS - 1 :]]

    def stats(self) -> dict:
        manifest = self.manifest() or {"revision": 0, "live": 0, "generation": None, "files": {}, "segments": []}
        tables: dict[str, int] = {}
        for name, known in manifest["files"].items():
            table = name.split("/")[2 if name.startswith("generations/") else 0]
            tables[table] = tables.get(table, 0) + known["bytes"]
        return {
            "durable_revision": self.durable_revision(), "visible_revision": manifest["revision"], "live_documents": manifest["live"], "generation": manifest["generation"],
            "segments": manifest["segments"], "files": len(manifest["files"]), "bytes": sum(tables.values()), "table_bytes": tables, "truncated_documents": self.truncated_documents,
        }


class Snapshot:
    """The tables of one generation; its files never change."""

    def __init__(self, index: Index, manifest: dict):
        self.manifest, self.config = manifest, index.config
        self.buckets = manifest["buckets"]
        self.docs, self.postings = index.live("docs", manifest), index.live("postings", manifest)
        self.stats, self.df = index.counted("stats", manifest), index.counted("df", manifest)
