"""Substring deduplication of paragraphs by MinHash banding.

A text is cut at line ends, and long lines are cut further where their content says so: a place
between two words has a print, made from the first bytes of both, and where it is less than the
prints of the REACH places on either side (all in the same line) a paragraph ends. A cut thus depends
on 18 neighbouring words alone, so a passage spliced into the middle of other text is cut there as
anywhere else, and its inner paragraphs are equal in all its places. A paragraph cut from a line has
REACH + 1 words or more.

Paragraphs with equal word sequences are one *text*, so copies are never paired. Each text gets
ROWS x BANDS minimum hashes over its five-word shingles; texts that agree in all rows of a band
collide, colliding ones are verified by exact Jaccard similarity
(``100 * |intersection| >= threshold * |union|``), and components of verified pairs are clusters. At
75 % a pair is missed by all bands with a probability of 0.003. The first place of a cluster
(smallest doc_id, then paragraph number) stays, the others are removed. Removed paragraphs in a row
with PASSAGE words or more in all are a *passage*.

Null and wordless texts have no paragraphs; paragraphs of less than a shingle's five words take no
part and stay; rows with a null doc_id are left alone; rows that share a doc_id are one document, and
equal rows are treated alike. A text of any length is handled whole. Extra columns, whatever their
names, are ignored by the report and kept by ``remove_repeated_paragraphs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairing import linked_components, shared_signatures
from .tokens import NOT_SPACE, U64, Words, lean, mix, sequence_ids, slices, window_hashes
from .workspace import Workspace, fresh

ROWS, BANDS = 2, 7
SHINGLE, THRESHOLD = 5, 75
REACH, PASSAGE = 8, 20
REMEMBERED = 1 << 18
#: A print is (FIRST * left + SECOND * right) modulo PRIME, of the leading four bytes of both words.
FIRST, SECOND, PRIME = 1812433253, 1664525, 2147483647
_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=U64) * U64(0x8CB92BA72F3D8DD7)) | U64(1)
PLACES = "doc_id long, text_key long, par int, words int, sid long"
_INDEX = "sig long, sid long, n int"


def paragraph_starts(found: Words, reach: int = REACH) -> np.ndarray:
    """Index of the first word of every paragraph."""
    count = len(found.starts)
    if not count:
        return np.empty(0, np.int64)
    lines = np.searchsorted(np.flatnonzero(found.data == 10), found.starts)
    fresh_line = np.ones(count, bool)
    fresh_line[1:] = lines[1:] != lines[:-1]
    fresh_line[found.bounds[:-1][np.diff(found.bounds) > 0]] = True
    lead = np.zeros(count, U64)
    size = found.ends - found.starts
    padded = np.r_[found.data, np.zeros(3, np.uint8)]
    for j in range(4):
        lead = np.where(size > j, (lead << U64(8)) | padded[found.starts + j], lead)
    prints = np.zeros(count, U64)
    prints[:-1] = (lead[:-1] * U64(FIRST) + lead[1:] * U64(SECOND)) % U64(PRIME)
    first = np.flatnonzero(fresh_line)
    length = np.diff(np.r_[first, count])
    begin, end = np.repeat(first, length), np.repeat(first + length, length)
    after = np.arange(1, count + 1)
    cut = (after - begin > reach) & (end - after > reach)
    for j in range(1, reach + 1):
        less = prints[j:] < prints[:-j]
        cut[j:] &= less
        cut[:-j] &= prints[:-j] < prints[j:]
    starts = fresh_line
    starts[1:] |= cut[:-1]
    return np.flatnonzero(starts)


class _Cut:
    """The paragraphs of a slice of texts: words, row, number in the text, and sequence id of each."""

    def __init__(self, column: pa.Array):
        self.found = Words(column, NOT_SPACE)
        self.hashes = self.found.hashes()
        starts = paragraph_starts(self.found)
        self.bounds = np.r_[starts, len(self.hashes)]
        self.row = np.searchsorted(self.found.bounds, starts, "right") - 1
        first = np.r_[True, self.row[1:] != self.row[:-1]] if len(starts) else np.empty(0, bool)
        at = np.arange(len(starts))
        self.number = at - np.maximum.accumulate(np.where(first, at, 0)) if len(starts) else at
        self.words = np.diff(self.bounds)
        self.ids = sequence_ids(self.hashes, self.bounds)

    def new(self, seen: set[int], least: int) -> np.ndarray:
        """Paragraphs of ``least`` words or more, one of each text that is not in ``seen``, which they enter."""
        where = np.flatnonzero(self.words >= least)
        _, first = np.unique(self.ids[where], return_index=True)
        where = where[np.sort(first)]
        keep = np.array([i not in seen for i in self.ids[where].tolist()], bool)
        if len(seen) >= REMEMBERED:
            seen.clear()
        where = where[keep]
        seen.update(self.ids[where].tolist())
        return where

    def shingles(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of the paragraphs ``where``, and the bounds of each one's."""
        runs = window_hashes(self.hashes, SHINGLE)
        count = self.words[where] - SHINGLE + 1
        owner = np.repeat(np.arange(len(where)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        every = runs[self.bounds[where][owner] + inner]
        _, first = np.unique(mix(every + owner.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
        first = np.sort(first)
        return every[first], np.searchsorted(owner[first], np.arange(len(where) + 1))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            cut = _Cut(batch.column(2))
            keep = np.flatnonzero(cut.words >= SHINGLE)
            at = pa.array(cut.row[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(cut.number[keep].astype(np.int32)), pa.array(cut.words[keep].astype(np.int32)), pa.array(cut.ids[keep])],
                names=["doc_id", "text_key", "par", "words", "sid"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The band signatures of every text; a set of one or two shingles only links with equal ones and has one."""
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole):
            cut = _Cut(batch.column(2))
            new = cut.new(seen, SHINGLE)
            if not len(new):
                continue
            members, bounds = cut.shingles(new)
            n = np.diff(bounds).astype(np.int32)
            ids, large = cut.ids[new], np.flatnonzero(n > 2)
            out = [], [], []
            for band in range(BANDS):
                sig = np.full(len(new), U64(band + 1))
                for seed in _SEEDS[band * ROWS : band * ROWS + ROWS]:
                    scrambled = members * seed
                    sig = mix(sig * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(scrambled ^ (scrambled >> U64(31)), bounds[:-1]))
                take = large if band else slice(None)
                for column, values in zip(out, (sig.view(np.int64)[take], ids[take], n[take])):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["sig", "sid", "n"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingles of the wanted paragraphs of the fetched documents, and their parity sketch."""
    for whole in batches:
        for batch in slices(whole):
            cut = _Cut(batch.column(1))
            bounds = np.searchsorted(cut.row, np.arange(batch.num_rows + 1))
            where = []
            for i, want in enumerate(batch.column(0).to_pylist()):
                wanted, a = set(want), int(bounds[i])
                for k, sid in enumerate(cut.ids[a : int(bounds[i + 1])].tolist(), a):
                    if sid in wanted:
                        wanted.discard(sid)
                        where.append(k)
            if not where:
                continue
            where = np.array(where)
            shingles, ends = cut.shingles(where)
            odd = np.bitwise_xor.reduceat(U64(1) << (shingles & U64(63)), ends[:-1])
            sets = [np.sort(shingles[a:b]).tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(cut.ids[where]), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in odd], pa.binary())], names=["sid", "members", "sketch"])


def _alike(threshold: int):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return alike


def _documents(documents: DataFrame) -> DataFrame:
    body = F.col("text").cast("string")
    return documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))


def repeated_paragraphs(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Every place of a paragraph: ``doc_id, text_key, par, words, cluster, removed``.

    ``cluster`` identifies the component, ``removed`` is true at all its places but the first.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "substring-dedup")
    docs = _documents(documents)
    places = work.save(docs.mapInArrow(lean(_places), PLACES))
    shared = work.save(shared_signatures(docs.mapInArrow(lean(_bands), _INDEX)))
    place = F.struct("doc_id", "text_key", "par")
    texts = work.save(places.groupBy("sid").agg(F.min(place).alias("at"), (F.min(place) < F.max(place)).alias("several")))
    wanted = shared.select("sid").distinct().join(texts, "sid").groupBy("at.doc_id", "at.text_key").agg(F.collect_list("sid").alias("want"))
    fetched = docs.join(wanted.hint("merge"), ["doc_id", "text_key"]).select("want", "text")
    members = work.save(fetched.mapInArrow(lean(_members), "sid long, members binary, sketch binary").dropDuplicates(["sid"]))

    def links(pairs: DataFrame) -> DataFrame:
        side = lambda k: members.select(F.col("sid").alias(k), F.col("members").alias(f"members_{k}"))
        beside = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "members_u", "members_v")
        return work.save(beside.mapInArrow(lean(_alike(threshold)), "u long, v long"))

    roots = linked_components(shared, threshold, links, work, members.select("sid", "sketch")).withColumnRenamed("node", "sid")
    work.drop(shared, members)
    grouped = texts.join(roots, "sid", "left").withColumn("cluster", F.coalesce("root", "sid"))
    heads = grouped.groupBy("cluster").agg(F.min("at").alias("head"), (F.max("several") | (F.count("*") > 1)).alias("repeats")).where("repeats")
    # A table of its own: a text with many places is then a skewed side of a join, which can be split.
    judged = work.save(grouped.join(heads, "cluster").select("sid", "cluster", "head"))
    work.drop(texts)
    return places.join(judged.hint("merge"), "sid", "left").select(
        "doc_id", "text_key", "par", "words", F.coalesce("cluster", "sid").alias("cluster"), F.coalesce(place != F.col("head"), F.lit(False)).alias("removed")
    )


def _passages(lost: str) -> F.Column:
    """How many runs of neighbouring paragraphs in the sorted array ``lost(par, words)`` have PASSAGE words."""
    start = F.expr("cast(struct(-2 as par, 0 as words, 0 as n) as struct<par:int,words:int,n:int>)")

    def step(state, x):
        goes_on = x["par"] == state["par"] + 1
        words = F.when(goes_on, state["words"]).otherwise(0) + x["words"]
        counted = (words >= PASSAGE) & ~(goes_on & (state["words"] >= PASSAGE))
        return F.struct(x["par"].alias("par"), words.cast("int").alias("words"), (state["n"] + counted.cast("int")).alias("n"))

    return F.aggregate(lost, start, step, lambda s: s["n"].cast("long"))


def paragraph_report(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_paragraphs, n_removed, words_removed, n_passages, removed`` (paragraph numbers) of each row."""
    found = repeated_paragraphs(documents, threshold).groupBy(F.col("doc_id").alias("_id"), "text_key").agg(F.collect_set(F.struct("par", "words", "removed")).alias("every"))
    found = found.select("_id", "text_key", F.size("every").alias("n"), F.array_sort(F.filter("every", lambda x: x["removed"])).alias("lost"))
    rows = documents.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("_key"))
    total = F.aggregate("lost", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.join(found, (rows["doc_id"] == found["_id"]) & (rows["_key"] == found["text_key"]), "left").select(
        "doc_id", zero(F.col("n")).alias("n_paragraphs"), zero(F.when(F.col("lost").isNotNull(), F.size("lost"))).alias("n_removed"), zero(total).alias("words_removed"),
        zero(_passages("lost")).alias("n_passages"), F.coalesce(F.array_join(F.transform("lost", lambda x: x["par"].cast("string")), ","), F.lit("")).alias("removed"),
    )


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the listed paragraphs, each cut from its first word to the next paragraph's."""
    for whole in batches:
        for batch in slices(whole):
            text, gone = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            dirty = [i for i, g in enumerate(gone) if g]
            if dirty:
                cut = _Cut(pa.array([text[i] for i in dirty], pa.string()))
                bounds = np.searchsorted(cut.row, np.arange(len(dirty) + 1))
                for k, i in enumerate(dirty):
                    raw, lost = text[i].encode(), set(gone[i])
                    begins = (cut.found.starts[cut.bounds[bounds[k] : bounds[k + 1]]] - cut.found.offs[k]).tolist()
                    parts = [raw[: begins[0]], *(raw[a:b] for p, (a, b) in enumerate(zip(begins, [*begins[1:], len(raw)])) if p not in lost)]
                    text[i] = b"".join(parts).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["kept", "text"])


def remove_repeated_paragraphs(documents: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``documents`` without the removed paragraphs; other columns stay as they are."""
    key, doc, other, pars = fresh(documents.columns, "key", "doc", "other", "pars")
    gone = repeated_paragraphs(documents, threshold).where("removed").groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(other)).agg(F.collect_set("par").alias(pars))
    rows = documents.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(gone, (rows["doc_id"] == gone[doc]) & (rows[key] == gone[other]), "left")
    rest = [c for c in documents.columns if c != "text"]
    packed = joined.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("kept"), F.col("text").cast("string").alias("text"), F.col(pars).alias("gone"))
    schema = packed.schema["kept"].dataType.simpleString()
    out = packed.mapInArrow(lean(_drop), f"kept {schema}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"kept.`{c}`") for c in documents.columns])
