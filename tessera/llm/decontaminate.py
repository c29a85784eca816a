"""Benchmark decontamination: a broadcast set of test n-grams against every window of every text.

A window is 8 consecutive words of a test item; an item of fewer words, but not none, is one window.
Windows are looked up by 64-bit hash and each hit is verified word by word. The test set is
broadcast in parts of about PART_WORDS words, held as arrays of some 30 bytes a window; every further
part is one more narrow pass over the rows that the pass before has written, so a worker holds one
part at a time and a large test set costs passes, never a shuffle of the corpus or an unbounded
broadcast.

Null or wordless texts and items have no windows, and an empty test set changes nothing. Items with
a null item_id are left out; items of equal id are one. Texts of any length are scanned whole. Rows
repeat as in the input; further columns may have any names and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ALNUM, U64, Words, lean, slices, window_hashes
from .workspace import Workspace

WINDOW = 8
#: Words of test items in one broadcast part.
PART_WORDS = 1 << 20
_FILTER_BITS = 22
#: A text in which this matches still holds a word.
ANY_WORD = r"[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
_REST = "text string, n_words long, hits array<int>, items array<string>"


@dataclass
class _Windows:
    """The windows of one length, sorted by hash: where each stands in ``words``, and its item."""

    hashes: np.ndarray
    mark: np.ndarray  # which leading bits occur
    begin: np.ndarray
    end: np.ndarray
    item: np.ndarray


def _tables(items: list[tuple[str, str]], window: int) -> tuple[bytes, list[str], dict[int, _Windows]]:
    """All words of the items, a space after each; the items' names; and their windows by length."""
    words, at, parts = [], 0, {}
    for k, (_, text) in enumerate(items):
        found = Words(pa.array([text]), ALNUM)
        count = len(found.starts)
        if not count:
            continue
        own = [found.word(i) for i in range(count)]
        words += own
        ends = at + np.cumsum([len(w) + 1 for w in own])
        begins = np.r_[at, ends[:-1]]
        at = int(ends[-1])
        size = min(window, count)
        hashes = window_hashes(found.hashes(), size)
        parts.setdefault(size, []).append((hashes, begins[: len(hashes)], ends[size - 1 :] - 1, np.full(len(hashes), k)))
    out = {}
    for size, found in parts.items():
        hashes, begin, end, item = (np.concatenate([p[j] for p in found]) for j in range(4))
        order = np.argsort(hashes, kind="stable")
        mark = np.zeros(1 << _FILTER_BITS, bool)
        mark[(hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        out[size] = _Windows(hashes[order], mark, begin[order], end[order], item[order].astype(np.int32))
    return b" ".join([*words, b""]), [name for name, _ in items], out


def _scan(tables):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names, sizes = tables.value
        for whole in batches:
            for batch in slices(whole):
                found = Words(batch.column(1), ALNUM)
                bounds = found.bounds
                hashed = found.hashes()
                hit = np.zeros(len(hashed) + 1, np.int32)
                items: dict[int, set[str]] = {}
                for size, known in sizes.items():
                    runs = window_hashes(hashed, size)
                    at = np.flatnonzero(known.mark[(runs >> U64(64 - _FILTER_BITS)).astype(np.int64)])
                    first, last = np.searchsorted(known.hashes, runs[at]), np.searchsorted(known.hashes, runs[at], "right")
                    doc = np.searchsorted(bounds, at, "right") - 1
                    good = np.flatnonzero((first < last) & (at + size <= bounds[doc + 1]))
                    for p, d, a, b in zip(at[good].tolist(), doc[good].tolist(), first[good].tolist(), last[good].tolist()):
                        own = b" ".join(found.word(j) for j in range(p, p + size))
                        same = {names[known.item[e]] for e in range(a, b) if words[known.begin[e] : known.end[e]] == own}
                        if same:
                            hit[p] += 1
                            hit[p + size] -= 1
                            items.setdefault(d, set()).update(same)
                at = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                where = np.searchsorted(at, bounds)
                old_hits, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                hits, found_items = [], []
                for d in range(found.rows):
                    own = at[where[d] : where[d + 1]] - bounds[d]
                    hits.append(np.union1d(own, old_hits[d]).tolist() if old_hits[d] else own.tolist())
                    found_items.append(sorted({*(old_items[d] or ()), *items.get(d, ())}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(hits, pa.list_(pa.int32())), pa.array(found_items, pa.list_(pa.string()))],
                    names=["kept", "text", "n_words", "hits", "items"],
                )

    return scan


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove each run of hit words, from its first to its last byte."""
    for whole in batches:
        for batch in slices(whole):
            text, hits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            dirty = [i for i, h in enumerate(hits) if h]
            if dirty:
                found = Words(pa.array([text[i] for i in dirty], pa.string()), ALNUM)
                for k, i in enumerate(dirty):
                    own = np.array(hits[i]) + found.bounds[k]
                    breaks = np.flatnonzero(np.diff(own) > 1)
                    raw, out, at = text[i].encode(), [], 0
                    for a, b in zip(own[np.r_[0, breaks + 1]], own[np.r_[breaks, len(own) - 1]]):
                        out.append(raw[at : found.starts[a] - found.offs[k]])
                        at = found.ends[b] - found.offs[k]
                    text[i] = b"".join([*out, raw[at:]]).decode()
            touched = pa.array([bool(h) for h in hits], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), touched], names=["kept", "text", "touched"])


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """``kept`` (a struct of the row's other columns) ``, text, n_words, hits`` (word positions) ``, items``."""
    spark = documents.sparkSession
    work = Workspace(spark, "decontaminate")
    rest = [F.col(f"`{c}`") for c in documents.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    out = documents.select(
        F.struct(*rest).alias("kept"), F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    schema = f"kept {out.schema['kept'].dataType.simpleString()}, {_REST}"
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    words = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    parts = max(1, int(-(-words // part_words)))
    for k in range(parts):
        part = items.where(F.expr(f"pmod(xxhash64(item_id, text), {parts}) = {k}"))
        tables = spark.sparkContext.broadcast(_tables([(r.item_id, r.text) for r in part.toLocalIterator()], window))
        out = out.mapInArrow(lean(_scan(tables)), schema)
        if k < parts - 1:
            done = work.save(out)
            if k:
                work.drop(last)
            out = last = done
    return out


def decontamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts, a digest of the item ids, and ``contaminated`` where two items or more occur."""
    return benchmark_hits(documents.select("doc_id", "text"), benchmark).select(
        "kept.doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def remove_benchmark_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` with hit words cut out of ``text`` and ``n_chars`` recounted.

    A document of which no word is left goes; one without hits stays as it is.
    """
    names = documents.columns
    marked = benchmark_hits(documents, benchmark)
    schema = marked.schema["kept"].dataType.simpleString()
    cut = marked.select("kept", "text", "hits").mapInArrow(lean(_cut), f"kept {schema}, text string, touched boolean")
    new = cut.where(f"not touched or text rlike '{ANY_WORD}'")
    counted = lambda: F.when(F.col("touched"), F.length("text").cast("long")).otherwise(F.col("kept.n_chars")).alias("n_chars")
    return new.select(*[F.col("text") if c == "text" else counted() if c == "n_chars" else F.col(f"kept.`{c}`") for c in names])
