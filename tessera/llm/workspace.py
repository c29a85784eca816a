"""Tables written between jobs, in a folder that the driver and every executor share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost executor then costs a
re-read, not a recomputation, and nothing depends on one executor's local disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only in local mode without one (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_FALLBACK:
        _LOCAL_FALLBACK.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(_remove_fallback)
    return _LOCAL_FALLBACK[0]


def _remove_fallback() -> None:
    import shutil

    for path in _LOCAL_FALLBACK:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with so many underscores before it that no column in ``taken`` has that name."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while (name := f"_{name}") in used:
            pass
        used.add(name)
        out.append(name)
    return out


#: Rows and bytes of one Arrow batch between the JVM and a Python worker; texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what these operators' memory is reckoned with."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        number = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < number <= most:
            spark.conf.set(key, str(most))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Names, writes, rereads and drops the intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the written table (same schema, no inference job)."""
        self._count += 1
        path = f"{self.root}/t{self._count}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")  # nothing reads this job's shuffles once its table is written
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._workspace_path)
            path.getFileSystem(conf).delete(path, True)
