"""Postings, statistics and BM25 for one request or a table of queries.

Alternatives are rows ``(query_id, grp, alt, term, field, weight)``: contributions are summed per
alternative, the best alternative of a group counts, and groups are summed.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.analyzer import nfkc_casefold, simple_fold, term_array, terms

K1, B = 1.2, 0.75
#: Weight of a hit in each text field.
FIELD_WEIGHTS = {"title": 2.0, "body": 1.0}
#: Bytes of text for one bucket of postings, and documents for one more file of each bucket: a task sorts one such file.
BUCKET_BYTES, FILE_DOCUMENTS = 16 << 20, 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
#: Terms that are packed together, and bytes of text below which one task more does not pay.
PACK_TERMS, TASK_BYTES = 500_000, 1 << 20
POSTINGS = "id string, field string, term string, len int, tf long, positions array<int>"
QUERY_SCHEMA = "query_id string, grp int, alt int, term string, field string, weight double"


def analyzed(documents: DataFrame, exact_unicode: bool = True, arrays: bool = True) -> DataFrame:
    """Documents with normalised keyword columns and, if asked for, ``title_terms`` and ``body_terms``."""
    fold = nfkc_casefold if exact_unicode else simple_fold
    out = documents
    for f in FIELD_WEIGHTS if arrays else ():
        out = out.withColumn(f"{f}_terms", term_array(fold(F.coalesce(F.col(f), F.lit("")))))
    tags = F.from_json(fold(F.to_json(F.coalesce("tags", F.array().cast("array<string>")))), "array<string>") if exact_unicode else F.transform("tags", simple_fold)
    return out.withColumn("kind_n", fold(F.col("kind"))).withColumn("category_n", fold(F.col("category"))).withColumn("tags_n", tags)


def postings(docs: DataFrame, positions: bool = True) -> DataFrame:
    """``id, field, term, tf, len`` and, if asked for, ``positions``."""
    field = lambda f: docs.select("id", F.lit(f).alias("field"), F.size(f"{f}_terms").alias("len"), F.posexplode(f"{f}_terms").alias("pos", "term"))
    every = field("title").unionByName(field("body"))
    extra = [F.sort_array(F.collect_list("pos")).alias("positions")] if positions else []
    return every.groupBy("id", "field", "term", "len").agg(F.count("*").alias("tf"), *extra)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's postings need no other row: terms and positions are counted where it is read."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for k, field in enumerate(FIELD_WEIGHTS, 1):
                for i, text in zip(ids, batch.column(k).to_pylist()):
                    found = terms(text or "")
                    places: dict[str, list[int]] = {}
                    for p, t in enumerate(found):
                        places.setdefault(t, []).append(p)
                    rows += [(i, field, t, len(found), len(p), p) for t, p in places.items()]
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "field", "term", "len", "tf", "positions"])


def index_postings(docs: DataFrame) -> DataFrame:
    """Postings of ``docs(id, title, body)`` by the exact analyzer, without a shuffle."""
    return docs.select("id", *FIELD_WEIGHTS).mapInArrow(_count_terms, POSTINGS)


def _pack_chunk(ids: list, fields: list[int], lengths: list[int], vocabulary: dict[str, int], codes: array, buckets: int) -> Iterator[tuple[int, bytes]]:
    """``bucket, packed postings`` of the texts whose terms ``codes`` hold one after the other."""
    known = list(vocabulary)
    home = np.fromiter((zlib.crc32(t.encode()) % buckets for t in known), np.int64, len(known))
    by_home = np.argsort(home, kind="stable")
    place = np.empty_like(by_home)
    place[by_home] = np.arange(len(known))
    size = np.array(lengths)
    text = np.repeat(np.arange(len(size)), size)
    position = (np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    key = place[np.array(codes, np.int64)] * len(size) + text
    order = np.argsort(key, kind="stable")
    key, position = key[order], position[order]
    begins = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
    term, text = np.divmod(key[begins[:-1]], len(size))
    home, words, names, field = home[by_home], pa.array(known, pa.string()).take(pa.array(by_home)), pa.array(ids, pa.string()), np.array(fields, np.int8)
    cuts = np.flatnonzero(np.diff(home[term], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        at, first = text[a:b], int(term[a])
        own, index = np.unique(at, return_inverse=True)
        columns = {
            "id": pa.DictionaryArray.from_arrays(pa.array(index, pa.int32()), names.take(pa.array(own))), "field": pa.array(field[at]),
            "term": pa.DictionaryArray.from_arrays(pa.array(term[a:b] - first, pa.int32()), words.slice(first, int(term[b - 1]) - first + 1)),
            "len": pa.array(size[at], pa.int32()), "positions": pa.ListArray.from_arrays(pa.array(begins[a : b + 1] - begins[a], pa.int32()), pa.array(position[begins[a] : begins[b]])),
        }
        batch, sink = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield int(home[first]), sink.getvalue().to_pybytes()


def _pack(buckets: int, files: int, tasks: int):
    """Postings as few packed rows ``task, bucket, packed``; which file of a bucket takes them changes from pack to pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fields, lengths, vocabulary, codes = [], [], [], {}, array("i")

        def packed() -> pa.RecordBatch:
            part = zlib.crc32(repr(ids[0]).encode()) % files
            rows = [((b * files + part) % tasks, b, p) for b, p in _pack_chunk(ids, fields, lengths, vocabulary, codes, buckets)]
            for x in (ids, fields, lengths, vocabulary):
                x.clear()
            del codes[:]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["task", "bucket", "packed"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for i, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                    for k, text in enumerate(texts):
                        found = terms(text or "")
                        if found:
                            ids.append(i)
                            fields.append(k)
                            lengths.append(len(found))
                            codes.extend([vocabulary.setdefault(t, len(vocabulary)) for t in found])
                    if len(codes) >= PACK_TERMS:
                        yield packed()
        if codes:
            yield packed()
        _give_back()

    return run


def _give_back() -> None:
    """Freed memory goes back to the system: the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array(list(FIELD_WEIGHTS))
    for batch in batches:
        for home, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
            for p in pa.ipc.open_stream(packed.as_buffer()):
                tf = pc.list_value_length(p["positions"]).cast(pa.int64())
                columns = [p["id"].dictionary_decode(), names.take(p["field"]), p["term"].dictionary_decode(), p["len"], tf, p["positions"], pa.repeat(pa.scalar(home, pa.int32()), p.num_rows)]
                rows = pa.RecordBatch.from_arrays(columns, names=["id", "field", "term", "len", "tf", "positions", "bucket"])
                for at in range(0, rows.num_rows, 16_384):
                    yield rows.slice(at, 16_384)
    _give_back()


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def pruned(table: DataFrame, words: list[str], buckets: int) -> DataFrame:
    """The rows of the given terms: literals, so that other buckets and row groups are not read."""
    wanted = sorted(set(words))
    return table.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % buckets for w in wanted})) & F.col("term").isin(wanted))


def write_postings(docs: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write postings to ``path`` by bucket, each sorted by term; returns the number of buckets.

    Unless it is given, the number grows with the text, and a bucket has more files where there are many
    documents, so that no frequent term is one task's. A task sorts the postings of one file, which it gets packed.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("title", F.lit(""))) + F.octet_length(F.coalesce("body", F.lit("")))).alias("bytes")).first()
    text = size.bytes or 0
    buckets = buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, text // BUCKET_BYTES))
    files = 1 + max(size.n // FILE_DOCUMENTS, text // (buckets * 2 * BUCKET_BYTES))
    tasks = min(buckets * files, 1 + text // TASK_BYTES)
    packed = docs.select("id", *FIELD_WEIGHTS).mapInArrow(_pack(buckets, files, tasks), "task int, bucket int, packed binary")
    posted = packed.repartitionById(tasks, F.col("task")).mapInArrow(_unpack, f"{POSTINGS}, bucket int")
    posted.sortWithinPartitions("bucket", "term", "field", "id").write.partitionBy("bucket").parquet(path)
    return buckets


def count_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("bucket", "field", "term").agg(F.count("*").alias("df"))


def write_frequencies(counted: DataFrame, path: str) -> None:
    counted.repartition("bucket").sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").parquet(path)


def stats_of(posted: DataFrame) -> DataFrame:
    """``field, n, total_length``: of each document's terms in a field exactly one stands first."""
    return posted.groupBy("field").agg(F.count(F.when(F.col("positions")[0] == 0, 1)).alias("n"), F.sum("tf").alias("total_length"))


def field_stats(docs: DataFrame) -> DataFrame:
    """``field, n, total_length`` over the documents that have text in the field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f"{f}_terms").alias("len")) for f in FIELD_WEIGHTS])).alias("p")
    return docs.select(pairs).select("p.*").groupBy("field").agg(F.count(F.when(F.col("len") > 0, 1)).alias("n"), F.sum("len").cast("long").alias("total_length"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log1p((n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def contribution(weight: Column, field: Column, rarity: Column, tf: Column, length: Column, average: Column) -> Column:
    boost = F.when(field == "title", FIELD_WEIGHTS["title"]).otherwise(FIELD_WEIGHTS["body"])
    return weight * boost * rarity * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def score(alternatives: DataFrame, posted: DataFrame, stats: DataFrame, df: DataFrame, eligible: DataFrame | None = None, selected: bool = False) -> DataFrame:
    """``query_id, id, score``: the sum over groups of the best alternative's BM25.

    Only the queries' own terms are read from the postings; ``selected`` says that ``posted`` and ``df``
    hold no others, so that ``df`` and the alternatives are few.
    """
    wanted = alternatives.select("term").distinct()
    own = lambda table: table if selected else table.join(wanted, "term", "left_semi")
    given = F.broadcast if selected else lambda table: table
    hits = own(posted.select("id", "field", "term", "tf", "len"))
    if eligible is not None:
        hits = hits.join(eligible.select("id"), "id", "left_semi")
    weighed = (
        hits.join(given(own(df.select("field", "term", "df"))), ["field", "term"]).join(F.broadcast(stats), "field")
        .withColumn("average", F.when(F.col("n") > 0, F.col("total_length") / F.col("n")).otherwise(1.0))
        .withColumn("base", contribution(F.lit(1.0), F.col("field"), idf(F.col("n"), F.col("df")), F.col("tf"), F.col("len"), F.col("average")))
        .select("id", "term", F.col("field").alias("hit_field"), "base")
    )
    rows = weighed.join(given(alternatives), "term").where("field is null or field = hit_field")
    by_alternative = rows.groupBy("query_id", "id", "grp", "alt").agg(F.sum(F.col("base") * F.col("weight")).alias("s"))
    by_group = by_alternative.groupBy("query_id", "id", "grp").agg(F.max("s").alias("s"))
    return by_group.groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def explain_rows(alternatives: DataFrame, posted: DataFrame, stats: DataFrame, df: DataFrame) -> DataFrame:
    """One row per matched term and field: its frequency, rarity and contribution."""
    rows = alternatives.join(posted.withColumnRenamed("field", "hit_field"), "term").where("field is null or field = hit_field").drop("field").withColumnRenamed("hit_field", "field")
    rows = rows.join(df.select("field", "term", "df"), ["field", "term"]).join(F.broadcast(stats), "field").withColumn("average", F.when(F.col("n") > 0, F.col("total_length") / F.col("n")).otherwise(1.0))
    rarity = idf(F.col("n"), F.col("df"))
    return rows.select("query_id", "id", "field", "term", "tf", "df", rarity.alias("idf"), contribution(F.col("weight"), F.col("field"), rarity, F.col("tf"), F.col("len"), F.col("average")).alias("contribution"))


def top_k(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1 per query, by falling score, ties by id, and keeps ``k``."""
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _rounded(scores: np.ndarray, digits: int | None) -> np.ndarray:
    """As Spark rounds: halves of the shortest decimal form go up."""
    if digits is None:
        return scores
    found, index = np.unique(scores, return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(float(x))).quantize(step, ROUND_HALF_UP)) for x in found])[index]


def batch_top_k(alternatives: DataFrame, docs: DataFrame, stats: DataFrame, df: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """``query_id, id, score, rank``, as ``top_k`` of ``score``, of many queries in one pass over ``docs(id, title, body)``.

    Many queries share the frequent terms, so that rows of query and document are many times the postings. Here a
    document's terms are scored against all queries where its text is read, and of a task's documents each
    query's first ``k`` go on. The alternatives, with positive weights, are collected.
    """
    given = alternatives.select("query_id", "grp", "alt", "term", "field", "weight").collect()
    if any(not r.weight > 0 for r in given):
        raise ValueError("weights must be positive")
    totals = {r.field: r for r in stats.collect()}
    wanted = F.broadcast(alternatives.select("term").distinct())
    # A term of a field is a feature, an alternative (or all groups of one alternative of a query) a column.
    features: dict[tuple[str, str], int] = {}
    rarity: list[float] = []
    for r in df.join(wanted, "term", "left_semi").collect():
        if r.df > 0:
            features[r.field, r.term] = len(rarity)
            rarity.append(FIELD_WEIGHTS[r.field] * math.log1p((totals[r.field].n - r.df + 0.5) / (r.df + 0.5)) * (K1 + 1))
    grouped: dict[str, dict[str, set]] = {}
    for r in given:
        grouped.setdefault(r.query_id, {}).setdefault(r.grp, set()).add(r.alt)
    slices = []
    names = sorted(grouped)
    for at in range(0, len(names), 64):
        columns: dict[tuple, int] = {}
        cells, inside = [], set(names[at : at + 64])
        for r in (r for r in given if r.query_id in inside):
            column = columns.setdefault((r.query_id, *((r.grp, r.alt) if len(grouped[r.query_id][r.grp]) > 1 else ())), len(columns))
            cells += [(features[f, r.term], column, r.weight) for f in ((r.field,) if r.field else FIELD_WEIGHTS) if (f, r.term) in features]
        sums: dict[tuple, list[int]] = {}
        for c, column in columns.items():
            sums.setdefault(c[:2], []).append(column)
        slices.append((len(columns), cells, [(c[0], list(own)) for c, own in sums.items()]))
    average = {f: r.total_length / r.n if r.n else 1.0 for f, r in totals.items()}
    docs, every = docs.select("id", *FIELD_WEIGHTS), _best(features, rarity, average, slices, k, digits)
    again = docs.groupBy("id").count().where("count > 1").select(F.col("id").alias("again"))
    if again.isEmpty():
        return top_k(docs.mapInArrow(every, "query_id string, id string, score double"), k)
    # Documents of one id score together: they take the general way.
    same = F.col("id").eqNullSafe(F.col("again"))
    first = docs.join(again, same, "left_anti").mapInArrow(every, "query_id string, id string, score double")
    rest = score(alternatives, index_postings(docs.join(again, same, "left_semi")), stats, df)
    return top_k(first.unionByName(rest if digits is None else rest.withColumn("score", F.round("score", digits))), k)


def _best(features: dict, rarity: list, average: dict, slices: list, k: int, digits: int | None):
    margin = 0.0 if digits is None else 2 * 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = []
        for width, cells, _ in slices:
            own = {f: i for i, f in enumerate(sorted({f for f, _, _ in cells}))}
            place, w = np.full(len(rarity), len(own)), np.zeros((len(own) + 1, width))
            place[np.array(list(own), np.int64)] = np.arange(len(own))
            for f, c, x in cells:
                w[own[f], c] += x
            weights.append((place, w))
        rare, best = np.array(rarity), {}

        def block(ids: list, starts: list, hits: list) -> None:
            feature, tf, part = (np.array(c) for c in zip(*hits))
            base = rare[feature] * tf / (tf + part)
            names = np.array(ids, object)
            for (place, w), (_, _, sums) in zip(weights, slices):
                cells = np.add.reduceat(base[:, None] * w[place[feature]], starts)
                scores: dict[str, np.ndarray] = {}
                for query, own in sums:
                    s = cells[:, own].max(axis=1)
                    scores[query] = scores[query] + s if query in scores else s
                for query, s in scores.items():
                    kept = best.get(query)
                    least = kept[0][-1] - margin if kept and len(kept[0]) >= k else 0.0
                    at = np.flatnonzero((s > 0) & (s >= least))
                    if not len(at):
                        continue
                    if len(at) > k:
                        at = at[s[at] >= np.partition(s[at], -k)[-k] - margin]
                    new = _rounded(s[at], digits), names[at]
                    both = [np.concatenate(c) for c in zip(kept, new)] if kept else new
                    first = sorted(range(len(both[0])), key=lambda i: (-both[0][i], both[1][i] is not None, both[1][i] or ""))[:k]
                    best[query] = tuple(c[first] for c in both)

        ids, starts, hits = [], [], []
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for i, *texts in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns)):
                    begin = len(hits)
                    for field, text in zip(FIELD_WEIGHTS, texts):
                        found = terms(text or "")
                        counted = Counter(found)
                        part = K1 * (1 - B + B * len(found) / average.get(field, 1.0))
                        hits += [(features[field, t], n, part) for t, n in counted.items() if (field, t) in features]
                    if len(hits) > begin:
                        ids.append(i)
                        starts.append(begin)
                    if len(hits) >= 16_384:
                        block(ids, starts, hits)
                        ids, starts, hits = [], [], []
        if hits:
            block(ids, starts, hits)
            _give_back()
        for query, (s, names) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(s), pa.string()), pa.array(names, pa.string()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    return run


def phrase_matches(posted: DataFrame, phrase: list[str], fields: tuple[str, ...] = tuple(FIELD_WEIGHTS)) -> DataFrame:
    """Ids and fields in which the terms stand in a row, from positional postings."""
    spark = posted.sparkSession
    wanted = spark.createDataFrame([(t, i) for i, t in enumerate(phrase)], "term string, at int")
    rows = posted.where(F.col("field").isin(*fields)).join(F.broadcast(wanted), "term").select("id", "field", "at", F.explode("positions").alias("pos"))
    starts = rows.groupBy("id", "field", (F.col("pos") - F.col("at")).alias("start")).agg(F.countDistinct("at").alias("n"))
    return starts.where(F.col("n") == len(phrase)).select("id", "field").distinct()
