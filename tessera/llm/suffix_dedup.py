"""Removal of repeated passages with sparse suffix arrays.

Passages of ``length`` words or more that occur again are found at the word level. Of all suffixes
only those at minimiser positions are kept: in every run of ``length - SEED + 1`` neighbouring
SEED-word seeds the one with the least hash is selected, so each ``length``-word window holds a
selected position, and the same one wherever the window occurs. Suffixes that share their seed with
another are sorted by their words; neighbours are compared, which gives the length of their common
prefix, and each match is extended to the left and right: a window that begins ``k`` words before the
seed is the same in two places if the suffixes have ``length - k`` words in common and the ``k``
words before them are equal. A window's first place (smallest doc_id, then position) stays; the words
of all other places are removed. The result equals marking every window but the first of its content,
and so does not depend on which positions are selected.

The suffixes of a seed are dealt into blocks of about BLOCK, each sorted and compared by one task, so
no seed is gathered whole. A window that is the first in its block is then compared with those of the
seed's other blocks by an aggregate over the windows' hashes, to which each block adds it once.

Texts with equal word sequences are one *text*; the copies of a text that do not have its smallest
doc_id are wholly removed if they have ``length`` words. Suffixes whose surroundings stood earlier in
their own text are settled there and not indexed.

Null and short texts lose nothing; rows with a null doc_id are left alone; rows that share a doc_id
are one document. Texts of any length are handled whole. Extra columns, whatever their names, are
ignored. Words are lower-cased (A-Z) runs of non-space; around a seed they are compared by 32 bits of
their hashes (the whole ``length`` of them must agree).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import NOT_SPACE, U64, Words, lean, mix, power_tables, sequence_ids, slices, window_hashes
from .workspace import Workspace

LENGTH, SEED = 50, 20
#: Expected suffixes of one seed that a task sorts and compares at once.
BLOCK = 2048
REMEMBERED = 1 << 18
_STEP = U64(0x9E3779B97F4A7C15)


def selected(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions that are the (leftmost) least of some ``run`` neighbouring hashes."""
    if len(hashes) < run:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, run)
    return np.unique(views.argmin(1) + np.arange(len(views)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            found = Words(batch.column(1), NOT_SPACE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sequence_ids(found.hashes(), found.bounds)), pa.array(np.diff(found.bounds))], names=["doc_id", "sid", "words"])


def _suffixes(length: int, seed: int):
    """``seed, sid, pos`` of the suffixes of each text; with a null seed, a span ``pos`` to ``end`` that is lost."""
    side = length - seed

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                found = Words(batch.column(1), NOT_SPACE)
                hashes = found.hashes()
                runs = window_hashes(hashes, seed)
                keys, ids, at, spans = [], [], [], []
                for sid, a, b in zip(sequence_ids(hashes, found.bounds).tolist(), found.bounds.tolist(), found.bounds[1:].tolist()):
                    if b - a < length or sid in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(sid)
                    own = runs[a : b - seed + 1]
                    where = selected(own, length - seed + 1)
                    chosen = own[where]
                    if len(np.unique(chosen)) < len(chosen):
                        around: set[tuple] = set()
                        fresh = []
                        for p in where.tolist():
                            lo, hi = max(0, p - side), min(b - a, p + length)
                            key = p - lo, hashes[a + lo : a + hi].tobytes()
                            if key in around:  # no window here is the first of its content
                                spans.append((sid, lo, hi))
                            else:
                                around.add(key)
                                fresh.append(p)
                        where = np.array(fresh, np.int64)
                        chosen = own[where]
                    keys.append(chosen)
                    ids.append(np.full(len(where), sid))
                    at.append(where.astype(np.int32))
                if keys:
                    key, k = np.concatenate(keys).view(np.int64), len(spans)
                    sid, lo, hi = (np.array([s[i] for s in spans], np.int64) for i in range(3))
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([pa.array(key), pa.nulls(k, pa.int64())]), pa.array(np.r_[np.concatenate(ids), sid]), pa.array(np.r_[np.concatenate(at), lo].astype(np.int32)),
                         pa.concat_arrays([pa.nulls(len(key), pa.int32()), pa.array(hi.astype(np.int32))])], names=["seed", "sid", "pos", "end"])

    return suffixes


_CONTEXT = "seed long, blk int, blocks int, doc_id long, sid long, pos int, before int, after int, suffix binary, prefix binary"
_FIELDS = [c.split(" ")[0] for c in _CONTEXT.split(", ")]
_FOUND = "sid long, start int, end int, doc_id long, print long"


def _contexts(length: int, seed: int):
    """Each wanted suffix with the words of all windows around its seed, 4 bytes each.

    ``suffix`` starts at the seed, most significant byte first, so that bytes sort as words do;
    ``prefix`` goes backwards from the word before. Both are filled up with zeros; ``after`` and
    ``before`` count their words.
    """
    side = length - seed

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Words(batch.column(2), NOT_SPACE)
                hashes = found.hashes()
                ids = sequence_ids(hashes, found.bounds)
                short = np.r_[np.zeros(side, np.uint32), (hashes >> U64(32)).astype(np.uint32), np.zeros(length, np.uint32)]
                mine = np.flatnonzero(ids == batch.column(1).to_numpy())  # others are further rows of this doc_id
                wants = batch.column(3).take(pa.array(mine))
                count = np.diff(wants.offsets.to_numpy())
                if not len(mine) or not count.sum():
                    continue
                flat = wants.flatten()
                key, pos, blocks = (flat.field(i).to_numpy() for i in range(3))
                row = np.repeat(mine, count)
                a, b = found.bounds[row], found.bounds[row + 1]
                at = a + pos
                after, before = np.minimum(b - at, length), np.minimum(at - a, side)
                right = short[(at + side)[:, None] + np.arange(length)]
                right[np.arange(length) >= after[:, None]] = 0
                left = short[(at + side - 1)[:, None] - np.arange(side)]
                left[np.arange(side) >= before[:, None]] = 0
                fixed = lambda x, width: pa.Array.from_buffers(pa.binary(4 * width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                block = (mix(ids[row].view(U64) + pos.astype(U64) * _STEP) % blocks.astype(U64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(block), pa.array(blocks), batch.column(0).take(pa.array(row)), pa.array(ids[row]), pa.array(pos),
                     pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), fixed(right.byteswap(), length), fixed(left, side)], names=_FIELDS)

    return contexts


def _words(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _compare(length: int, seed: int):
    """Of the suffixes of each seed and block, in suffix order: the windows that are not the first of their
    content, joined to spans. Where a seed has several blocks, also each first window, with its print."""
    side = length - seed

    def windows(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        size = len(x["seed"])
        group = np.cumsum(np.r_[True, (x["seed"][1:] != x["seed"][:-1]) | (x["blk"][1:] != x["blk"][:-1])])
        # Neighbours in suffix order: how many words they have in common.
        differ = x["suffix"][1:] != x["suffix"][:-1]
        common = np.where(differ.any(1), differ.argmax(1), length)
        common = np.r_[-1, np.where(group[1:] == group[:-1], np.minimum(common, np.minimum(x["after"][1:], x["after"][:-1])), -1)]
        # Hash of the k words before the seed, for each k.
        left = np.zeros((size, side + 1), U64)
        for k in range(side):
            left[:, k + 1] = mix(left[:, k] * _STEP + x["prefix"][:, k].astype(U64) + U64(1))
        who, back, print_ = [], [], []
        for k in range(side + 1):
            # Suffixes in a row that have length - k words in common are of one class.
            kind = np.cumsum(common < length - k)
            own = np.flatnonzero((x["before"] >= k) & (x["after"] >= length - k))
            who.append(own)
            back.append(np.full(len(own), k))
            print_.append(mix(left[own, k] + kind[own].astype(U64) * U64(0xD1B54A32D192ED03) + U64(k)))
        who, back, print_ = np.concatenate(who), np.concatenate(back), np.concatenate(print_)
        start = x["pos"][who] - back
        order = np.lexsort((start, x["doc_id"][who], print_))
        who, back, start, print_ = who[order], back[order], start[order], print_[order]
        head = np.r_[True, print_[1:] != print_[:-1]] if len(who) else np.empty(0, bool)
        first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(who) else head
        later = (x["doc_id"][who] != x["doc_id"][who[first]]) | (start != start[first])  # a window can stand around several seeds of its own
        lost, at = who[later], start[later]
        order = np.lexsort((at, lost))
        lost, at = lost[order], at[order]
        new = np.r_[True, (lost[1:] != lost[:-1]) | (at[1:] != at[:-1] + 1)] if len(lost) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        last = np.r_[begin[1:], len(lost)] - 1 if len(begin) else begin
        columns = [[x["sid"][lost[begin]]], [at[begin]], [at[last] + length]]
        none = len(begin)
        many = np.flatnonzero(head & (x["blocks"][who] > 1))
        if len(many):
            own, k = who[many], back[many]
            # The whole window's hash, equal in every block: from its first word to its last.
            every = np.concatenate([x["prefix"][:, ::-1], x["suffix"]], 1)
            power, inverse = power_tables(side + length + 1)
            sums = np.zeros((size, side + length + 1), U64)
            np.cumsum((mix(every.astype(U64) + U64(1))) * power[: side + length], axis=1, out=sums[:, 1:])
            whole = mix((sums[own, side - k + length] - sums[own, side - k]) * inverse[side - k] + x["seed"][own].view(U64))
            for c, v in zip(columns, (x["sid"][own], start[many], start[many] + length)):
                c.append(v)
            doc, key = x["doc_id"][own], whole.view(np.int64)
        else:
            doc = key = np.empty(0, np.int64)
        sid, begins, ends = (np.concatenate(c) for c in columns)
        return pa.RecordBatch.from_arrays(
            [pa.array(sid), pa.array(begins.astype(np.int32)), pa.array(ends.astype(np.int32)),
             pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(doc)]), pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(key)])], names=["sid", "start", "end", "doc_id", "print"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {k: batch.column(i).to_numpy() for i, k in enumerate(_FIELDS[:-2])}
            now["suffix"], now["prefix"] = _words(batch.column(len(_FIELDS) - 2), length).byteswap(), _words(batch.column(len(_FIELDS) - 1), side)
            if held is not None:
                now = {k: np.concatenate([held[k], v]) for k, v in now.items()}
            same = (now["seed"] == now["seed"][-1]) & (now["blk"] == now["blk"][-1])
            cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if cut:
                yield windows({k: v[:cut] for k, v in now.items()})
            held = {k: v[cut:] for k, v in now.items()}
        if held is not None:
            yield windows(held)

    return compare


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, words = [], []
        for spans in batch.column(1).to_pylist():
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            out.append([{"start": a, "end": b} for a, b in merged])
            words.append(sum(b - a for a, b in merged))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(words, pa.int64())], names=["sid", "spans", "lost"])


def repeated_passages(documents: DataFrame, length: int = LENGTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_removed, spans`` of each row; spans are of words, end exclusive."""
    work = Workspace(documents.sparkSession, "suffix-dedup")
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = every.where("doc_id is not null and text is not null")
    texts = work.save(every.mapInArrow(lean(_texts), "doc_id long, sid long, words long"))
    heads = work.save(texts.where("doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("head")))
    index = work.save(docs.mapInArrow(lean(_suffixes(length, seed)), "seed long, sid long, pos int, end int"))
    place = F.xxhash64("sid", "pos")
    seeds = index.where("seed is not null").groupBy("seed").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")).where("low < high")
    seeds = work.save(seeds.select("seed", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    shared = index.where("seed is not null").join(seeds.hint("merge"), "seed")
    wanted = shared.groupBy("sid").agg(F.collect_set(F.struct("seed", "pos", "blocks")).alias("want")).join(heads, "sid")
    wanted = work.save(wanted.select(F.col("head").alias("doc_id"), "sid", "want"))
    fetched = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "sid", "text", "want")
    contexts = fetched.mapInArrow(lean(_contexts(length, seed)), _CONTEXT)
    found = work.save(contexts.repartition("seed", "blk").sortWithinPartitions("seed", "blk", "suffix", "doc_id", "pos").mapInArrow(lean(_compare(length, seed)), _FOUND))
    at = F.struct("doc_id", "start")
    between = found.where("print is not null")
    first = work.save(between.groupBy("print").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select("print", "low"))
    across = between.join(first.hint("merge"), "print").where(at != F.col("low"))
    lost = found.where("print is null").select("sid", "start", "end").union(across.select("sid", "start", "end"))
    lost = lost.union(index.where("seed is null").select("sid", F.col("pos").alias("start"), "end"))
    spans = lost.groupBy("sid").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(
        _merge, "sid long, spans array<struct<start:int,end:int>>, lost long"
    )
    # A table of its own: a text with many copies is then a skewed side of a join, which can be split.
    judged = work.save(heads.join(spans, "sid", "left"))
    copy = F.expr(f"doc_id is not null and doc_id <> head and words >= {length}")
    return texts.join(judged.hint("merge"), "sid", "left").select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.when(copy, F.col("words")).when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.expr("array(struct(0 as start, cast(words as int) as end))"))
        .when(F.col("doc_id").isNull() | F.col("spans").isNull(), F.expr("cast(array() as array<struct<start:int,end:int>>)")).otherwise(F.col("spans")).alias("spans"),
    )
