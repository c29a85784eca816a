"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest permitted length, then packed longest first:
a piece goes to the open bin that it fills best; where none has room, a bin is opened of the size
with the least cost per word it can still be expected to hold. At the end every bin shrinks to the
smallest permitted size that holds its contents. A bin costs ``overhead + size + size^2 / quadratic``.

Pieces are dealt by hash into shards of about SHARD pieces, each packed by one task on its own, so
memory is bounded, no length or source is hot, and at most a bin or two a shard are ill filled.

Null and wordless texts give one row with length 0 and no bin. Rows repeat as in the input, ties go
to the smaller doc_id, and null doc_ids are packed like others. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD, QUADRATIC = 32, 32768
SHARD = 1 << 15
PLACED = ["doc_id", "piece", "start", "n_words", "bin_id", "offset", "capacity"]
WORD = r"[^\x20\x09-\x0D]+"


def bin_cost(size: int) -> float:
    return OVERHEAD + size + size * size / QUADRATIC


def pack(lengths: list[int], capacities: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """``(bin, offset, capacity)`` of each length; ``lengths`` are sorted, longest first."""
    sizes = sorted(capacities)
    costs = [(c, bin_cost(c)) for c in sizes]
    room: list[tuple[int, int]] = []  # (room left, -bin), sorted: ties go to the later bin
    fill: list[int] = []
    out = []
    rest = sum(lengths)
    for n in lengths:
        at = bisect_left(room, (n, -len(fill)))
        if at < len(room):
            left, k = room.pop(at)
            k = -k
        else:
            k = len(fill)
            fill.append(0)
            left = min(((cost / min(c, rest), c) for c, cost in costs if c >= n))[1]
        out.append((k, fill[k]))
        fill[k] += n
        rest -= n
        if left > n:
            insort(room, (left - n, -k))
    final = [sizes[bisect_left(sizes, f)] for f in fill]
    return [(k, offset, final[k]) for k, offset in out]


def best_fit_packing(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """``doc_id, piece, start, n_words, bin_id, offset, capacity`` of each piece.

    ``start`` is the piece's first word in its text, ``offset`` its place in the bin.
    """
    most = max(capacities)
    sized = documents.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"), F.xxhash64("text").alias("h"))
    pieces = sized.select(
        "doc_id", "h", "words", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("words") - 1, F.lit(0)), F.lit(most).cast("long"))).alias("piece", "start")
    ).withColumn("n_words", F.least(F.col("words") - F.col("start"), F.lit(most)))
    count = sized.agg(F.sum(F.greatest(F.ceil(F.col("words") / most), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(count) // shard))
    dealt = pieces.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, h, piece), {shards}) as int)"))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("h", "ascending")])
        lengths = [n for n in rows["n_words"].to_pylist() if n]  # the wordless come last
        places = [*pack(lengths, capacities), *[(None, None, None)] * (rows.num_rows - len(lengths))]
        bins, offsets, sizes = zip(*places)
        names = [None if k is None else f"{s}-{k}" for s, k in zip(rows["shard"].to_pylist(), bins)]
        columns = [rows[c] for c in ("doc_id", "piece", "start", "n_words")]
        return pa.table([*columns, pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=PLACED)

    return dealt.groupBy("shard").applyInArrow(
        one, "doc_id long, piece int, start long, n_words long, bin_id string, offset long, capacity long"
    )
