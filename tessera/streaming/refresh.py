"""Refresh as a stream: new document files are ingested and published in micro-batches."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.documents import DOC_SCHEMA, parse_jsonl
from tessera.sources.store import Index


def refresh_stream(index: Index, path: str, checkpoint: str, interval: str | None = "1 second") -> StreamingQuery:
    """Read JSONL documents as they arrive; ``interval=None`` processes what is there and stops.

    Documents that break a rule go to ``rejected/`` of the index with their violations, and the rest is
    published. A batch that was published before a restart is not appended again. Of several documents
    of one id in a batch the one with the greatest JSON text counts.
    """
    done = index.root / f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}.json"

    def publish(batch: DataFrame, number: int) -> None:
        if done.exists() and json.loads(done.read_text())["batch"] >= number:
            return
        parsed = parse_jsonl(batch).persist()
        try:
            parsed.where(F.size("violations") > 0).write.mode("overwrite").json(str(index.root / "rejected" / f"{done.stem}-{number}"))
            good = parsed.where(F.size("violations") == 0).select(*DOC_SCHEMA.names)
            last = good.groupBy("id").agg(F.max_by(F.struct(*DOC_SCHEMA.names), F.to_json(F.struct(*DOC_SCHEMA.names))).alias("d")).select("d.*")
            index.ingest(last, batch_limits=False)
        finally:
            parsed.unpersist()
        following = done.with_suffix(".next")
        following.write_text(json.dumps({"batch": number}))
        os.replace(following, done)
        index.refresh()

    stream = index.spark.readStream.text(path).writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if interval is None else stream.trigger(processingTime=interval)).start()
