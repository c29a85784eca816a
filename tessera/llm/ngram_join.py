"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct five-word shingles. Two documents link when
``100 * |intersection| >= threshold * |union|``. Documents with equal sets are one *text* (id: a hash
of the set), so copies are never expanded. Each text indexes a prefix of its shingles in one global
order: rare shingles first, as single signatures, then frequent ones. A frequent shingle says little
alone, so the prefix is extended and pairs of frequent shingles (of one of G hash classes) are
indexed instead. Removing any ``n - ceil(threshold * n)`` shingles leaves at least one signature:
a class of c prefix shingles still holds a pair until c - 1 of them are gone, so it counts c - 1
units, and the prefix is extended until the units exceed the removable shingles. Which shingles
count as frequent only affects speed; any choice gives the same links.

Nulls and odd rows: a null or wordless text has an empty set and links with nothing; a row with a
null doc_id links with nothing and gets a null component; rows that share a doc_id are one document;
texts of any length are compared whole; an empty table gives no rows; extra columns, whatever their
names, are ignored. Shingles are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pairing import linked_components, parity, shared_signatures
from .tokens import U64, give_back, lean, mix, shingle_sets, slices
from .workspace import Workspace

#: Most shingles in the broadcast table of frequent ones (8 bytes each).
FREQUENT_BOUND = 1 << 19
#: A shingle is offered as frequent by a task that meets it in so many texts, and kept from so many in all.
LOCAL_LEAST, GLOBAL_LEAST = 8, 24
#: A signature that so many texts index in the first round counts as frequent in the second.
GROUP_LEAST = 10
#: Least and most bits of the parity bitmap that rejects unlike pairs before their texts are fetched.
BITMAP_BITS = 1 << 11, 1 << 17
#: Distinct texts that one task remembers, so that a hot group of copies is indexed once per task.
REMEMBERED = 1 << 18

_SCAN = "doc_id long, n int, sid long, bits binary, sketch binary, token long, texts long"
_INDEX = "sig long, sid long, n int, left int"


def _set_id(s: np.ndarray) -> int:
    total = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return int(mix(np.array([total + U64(len(s))], U64)).view(np.int64)[0])


def _parity(s: np.ndarray) -> bytes:
    """Parity bitmap with two to four times as many bits as there are shingles."""
    least, most = BITMAP_BITS
    return parity(s, min(most, max(least, 1 << (2 * len(s) - 1).bit_length())) if len(s) else least)


def _prune(threshold: int):
    """Keep pairs whose bitmaps differ in no more bits than linked sets of their sizes could."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(a) > len(b):
                    a = a[: len(a) // 2] ^ a[len(a) // 2 :]
                while len(b) > len(a):
                    b = b[: len(b) // 2] ^ b[len(b) // 2 :]
                least = -(-threshold * (n + m) // (100 + threshold))
                keep.append(int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * least)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return prune


def _scan(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(pending), return_counts=True)
            keep = counts >= LOCAL_LEAST
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])],
                names=["doc_id", "n", "sid", "bits", "sketch", "token", "texts"],
            )

        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(batch.column(1), size)
                k = len(sets)
                n = np.array([len(s) for s in sets], np.int32)
                ids = pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())
                bits = pa.array([_parity(s) for s in sets], pa.binary())
                sketch = pa.array([parity(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), ids, bits, sketch, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
                    names=["doc_id", "n", "sid", "bits", "sketch", "token", "texts"],
                )
                pending.extend(s for s in sets if len(s))
                held += int(n.sum())
                if held > 1 << 22:
                    yield frequent()
                    pending, held = [], 0
        if pending:
            yield frequent()

    return scan


def _levels(threshold: int, most: int = 1 << 40) -> list[int]:
    """Smallest size of each band; linked sizes lie in the same or in neighbouring bands."""
    out, k = [1], 1
    while out[-1] < most:
        out.append(100**k // threshold**k + 1)
        k += 1
    return out


def signatures(s: np.ndarray, frequent: np.ndarray, threshold: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set, and for each the most overlap of a pair that first meets there."""
    n = len(s)
    units = n - (-(-threshold * n // 100)) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        known = frequent[at] == s
        rare = s[~known]
    else:
        known, rare = None, s
    if len(rare) >= units:
        return rare[:units], n - np.arange(units)
    sigs, lefts = [rare], [n - np.arange(len(rare))]
    common, rest = s[known], units - len(rare)
    band = int(np.searchsorted(levels, n, "right")) - 1
    for level in (band, band + 1):
        classes = max(1, int(levels[max(level - 1, 0)]) // 3)
        kind = (mix(common + U64(level + 1)) % U64(classes)).astype(np.int64)
        order = np.lexsort((common, kind))
        tokens, kind = common[order], kind[order]
        starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
        sizes = np.diff(np.r_[starts, len(kind)])
        used = int(np.searchsorted(np.cumsum(sizes - 1), rest)) + 1
        seed = U64((level + 1) * 0x2545F4914F6CDD1D % (1 << 64))
        for k in range(min(used, len(sizes))):
            if sizes[k] < 2:
                continue
            members = tokens[starts[k] : starts[k] + sizes[k]]
            i, j = np.triu_indices(sizes[k], 1)
            sigs.append(mix(members[i] * U64(0x9FB21C651E98DF25) + mix(members[j] ^ seed)))
            lefts.append(np.minimum(n, k + n - len(rare) - starts[k] - i))
    return np.concatenate(sigs), np.concatenate(lefts)


def _index(size: int, threshold: int, frequent):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        levels = np.array(_levels(threshold)[:120])
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                cols = [], [], [], []
                for doc, s in zip(batch.column(0).is_valid().to_pylist(), shingle_sets(batch.column(1), size)):
                    if len(s) < 2 or not doc:
                        continue
                    sid = _set_id(s)
                    if sid in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sid)
                    sig, left = signatures(s, table, threshold, levels)
                    for c, x in zip(cols, (sig, np.full(len(sig), sid), np.full(len(sig), len(s), np.int32), left)):
                        c.append(x)
                if cols[0]:
                    sig, sid, n, left = map(np.concatenate, cols)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig.view(np.int64)), pa.array(sid), pa.array(n), pa.array(left.astype(np.int32))], names=["sig", "sid", "n", "left"]
                    )

    return index


def _verify(size: int, threshold: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_u"):
                keep = []
                for a, b in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= threshold * (len(a) + len(b) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return verify


def ngram_jaccard_join(documents: DataFrame, threshold: int = 75, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest doc_id reachable by links. ``threshold`` is in percent, 70-100.
    """
    if not 70 <= threshold <= 100:
        raise ValueError("threshold must be from 70 to 100 percent")
    spark = documents.sparkSession
    work = Workspace(spark, "ngram-join")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = work.save(docs.mapInArrow(lean(_scan(size)), _SCAN))
    rows = scanned.where("token is null").select("doc_id", "n", "sid", "bits", "sketch")
    # The first index shows which shingles are frequent among prefixes; the second one is joined.
    hot = scanned.where("token is not null").groupBy("token").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= GLOBAL_LEAST)
    index = docs.mapInArrow(lean(_index(size, threshold, _frequent(spark, hot))), _INDEX)
    crowded = index.groupBy(F.col("sig").alias("token")).agg(F.count("*").alias("texts")).where(F.col("texts") >= GROUP_LEAST)
    frequent = _frequent(spark, work.save(hot.unionByName(crowded).groupBy("token").agg(F.max("texts").alias("texts"))))
    shared = work.save(shared_signatures(docs.mapInArrow(lean(_index(size, threshold, frequent)), _INDEX)))
    texts = rows.where("sid is not null and doc_id is not null").groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch")
    )
    texts = work.save(texts)

    def links(pairs: DataFrame) -> DataFrame:
        side = lambda k: texts.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
        beside = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v")
        alike = work.save(beside.mapInArrow(lean(_prune(threshold)), "u long, v long"))
        wanted = alike.select(F.col("u").alias("sid")).union(alike.select("v")).distinct().join(texts.select("sid", "doc_id"), "sid")
        wanted = work.save(wanted)
        # A merge join at every size: the plan measured on a small corpus is the one a large corpus runs.
        fetched = docs.join(wanted.hint("merge"), "doc_id").select("sid", "text").mapInArrow(lean(_of_set(size)), "sid long, text string")
        fetched = work.save(fetched.dropDuplicates(["sid"]))
        side = lambda k: fetched.select(F.col("sid").alias(k), F.col("text").alias(f"text_{k}"))
        out = work.save(alike.join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(lean(_verify(size, threshold)), "u long, v long"))
        work.drop(alike, wanted, fetched)
        return out

    roots = linked_components(shared, threshold, links, work, texts.select("sid", "sketch"))
    named = texts.select("sid", "doc_id").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = work.save(named.join(least, "root").select("sid", "component_id"))
    work.drop(shared, texts)
    return rows.join(named, "sid", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.expr("case when doc_id is null then null else coalesce(component_id, doc_id) end").alias("component_id"),
    )


def _of_set(size: int):
    """Keep fetched texts whose set is the wanted one (rows may share a doc_id)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                got = [_set_id(s) if len(s) else None for s in shingle_sets(batch.column(1), size)]
                yield batch.filter(pa.array([a == b for a, b in zip(got, batch.column(0).to_pylist())], pa.bool_()))

    return keep


def _frequent(spark: SparkSession, counted: DataFrame):
    """The most frequent shingles, at most FREQUENT_BOUND of them, sorted and broadcast."""
    top = counted.orderBy(F.desc("texts"), "token").limit(FREQUENT_BOUND).select("token").toArrow()
    out = spark.sparkContext.broadcast(np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64)))
    del top
    give_back()
    return out
