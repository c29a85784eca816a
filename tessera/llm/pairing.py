"""From an inverted index to candidate pairs without ever emitting all pairs of a group.

An *index* is a table ``(sig, sid, n, left)``: signature, id of a distinct text, its set size, and an
upper bound of the overlap that a pair meeting first at this signature can still reach. A first pass
emits at most ``limit`` pairs per member and group, and the pair of each member with the group's hub:
copies edited from one original are often too unlike each other to link but all link to it. Once
these are verified and merged into components, an exhaustive second pass emits only pairs that lie
in different components, so a group of a million near copies costs a few pairs per member while no
link between components is lost. Groups above BLOCK members are cut into blocks, and the second
pass visits every pair of blocks that can hold members of different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .tokens import lean
from .workspace import Workspace

#: Expected members of one block of a signature's group, which bounds a task's working set.
BLOCK = 2048
#: The limited passes: signatures of a text up to this turn, pairs per member and group.
PASSES = ((4, 3), (24, 3))
#: How far apart, in a group sorted by size, the members of a first-pass pair may be.
REACH = 12
#: Bits of the parity sketch that rejects unlike pairs inside their group.
SKETCH_BITS = 512

PAIR_SCHEMA = "u long, v long"


def shared_signatures(index: DataFrame) -> DataFrame:
    """Rows of signatures that at least two different texts have, once per text.

    Adds the group's ``size``, the sum of sizes over the text's groups (``reach``), and along each
    text's own shared signatures, earliest first, the ``turn`` of this one and the signature before
    it (``before``).
    """
    by = Window.partitionBy("sig").orderBy("n", "sid")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = (
        index.select(
            "*",
            F.min("sid").over(whole).alias("_lo"),
            F.max("sid").over(whole).alias("_hi"),
            F.count("*").over(whole).alias("size"),
            F.lag("sid").over(by).alias("_before"),
        )
        .where("_lo < _hi and (_before is null or _before <> sid)")
        .drop("_lo", "_hi", "_before")
    )
    if "left" not in index.columns:
        found = found.withColumn("left", F.col("n"))
    along = Window.partitionBy("sid").orderBy(F.desc("left"), "sig")
    found = found.withColumn("reach", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return found.withColumn("turn", F.row_number().over(along)).withColumn("before", F.coalesce(F.lag("sig").over(along), F.col("sid")))


def hub_pairs(shared: DataFrame, threshold: int) -> DataFrame:
    """Each member of a group with the member of most ``reach``: at most one pair per row."""
    hubs = shared.groupBy("sig").agg(F.max(F.struct("reach", "sid", "n", "left", "comp")).alias("hub"))
    need = F.expr(f"({threshold} * (n + hub.n) + {99 + threshold}) div {100 + threshold}")
    met = shared.join(hubs, "sig").where((F.col("comp") != F.col("hub.comp")) & (F.least("left", "hub.left", "n", "hub.n") >= need))
    return met.select(F.least("sid", "hub.sid").alias("u"), F.greatest("sid", "hub.sid").alias("v"))


def _own_cells(shared: DataFrame) -> DataFrame:
    """Each row once, in its block of its group."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    rows = shared.withColumn("_n", blocks).withColumn("blk", F.expr("cast(pmod(xxhash64(sid), _n) as int)"))
    return rows.withColumn("lo", F.col("blk")).withColumn("hi", F.col("blk"))


def _all_cells(shared: DataFrame) -> DataFrame:
    """Each row in every cell (pair of blocks) in which it can meet a row of another component.

    A large group that is one component already is left out. In the others the members of the largest
    component never meet each other: their blocks only pair with those of the other members, so a
    group of one large component and a few more texts costs a row per member and a few copies of these.
    """
    small = shared.where(F.col("size") <= BLOCK).withColumn("blk", F.lit(0)).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    large = shared.where(F.col("size") > BLOCK)
    parts = large.groupBy("sig", "comp").agg(F.count("*").alias("_c"))
    facts = parts.groupBy("sig").agg(F.max_by("comp", F.struct("_c", "comp")).alias("_major"), F.max("_c").alias("_most"), F.sum("_c").alias("_all")).where("_most < _all")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    rows = large.join(facts, "sig").withColumn("_m", blocks(F.col("_most"))).withColumn("_o", blocks(F.col("_all") - F.col("_most")))
    mine = F.col("comp") == F.col("_major")
    rows = rows.withColumn("blk", F.when(mine, F.expr("cast(pmod(xxhash64(sid), _m) as int) + _o")).otherwise(F.expr("cast(pmod(xxhash64(sid), _o) as int)")))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.when(mine, F.col("_o")).otherwise(F.col("_o") + F.col("_m")) - 1)))
    rows = rows.withColumn("lo", F.least("blk", "_with")).withColumn("hi", F.greatest("blk", "_with"))
    return small.unionByName(rows.select(*small.columns))


def candidate_pairs(shared: DataFrame, threshold: int, limit: int | None) -> DataFrame:
    """Distinct pairs ``u < v`` of texts in one group whose sizes and bounds allow ``threshold`` %.

    ``shared`` needs ``(sig, sid, n, left, before, size, reach, comp)``; pairs of one ``comp`` are left out, and so
    are pairs that have the signature before in common, since their group there has them already.
    With a column ``sketch`` (of ``parity``) pairs are left out whose sketches differ too much to link.
    ``limit`` pairs per member and those with hubs are emitted in the first passes, all of them with ``None``.
    """
    sketched = ["sketch"] if "sketch" in shared.columns else []
    columns = ["sig", "lo", "hi", "n", "sid", "left", "comp", "blk", "before", *sketched]
    rows = _all_cells(shared) if limit is None else _own_cells(shared)
    rows = rows.select(*columns)
    dealt = rows.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "n", "sid")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        names = ["sig", "lo", "hi", "n", "sid", "left", "comp", "blk", "before"]
        for batch in batches:
            now = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            if sketched:
                raw = b"".join(batch.column(len(names)).to_pylist())
                now["sketch"] = np.frombuffer(raw, np.uint64).reshape(batch.num_rows, -1)
            if held is not None:
                now = {k: np.concatenate([held[k], x]) for k, x in now.items()}
            if not len(now["sig"]):
                continue
            same = (now["sig"] == now["sig"][-1]) & (now["lo"] == now["lo"][-1]) & (now["hi"] == now["hi"][-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = {k: x[cut:] for k, x in now.items()}
            if cut:
                yield from _pairs_of({k: x[:cut] for k, x in now.items()}, threshold, limit)
        if held is not None:
            yield from _pairs_of(held, threshold, limit)

    found = dealt.mapInArrow(lean(pairs), PAIR_SCHEMA)
    return (found if limit is None else found.union(hub_pairs(shared, threshold))).distinct()


def _pairs_of(x: dict[str, np.ndarray], threshold: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Compare each row with the one ``d`` places before it, for growing ``d``, all rows at once."""
    first = np.ones(len(x["sig"]), bool)
    first[1:] = (x["sig"][1:] != x["sig"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])
    at = np.flatnonzero(first)
    mixed = np.minimum.reduceat(x["comp"], at) < np.maximum.reduceat(x["comp"], at)
    if not mixed.all():  # groups of one component have nothing to find
        keep = np.repeat(mixed, np.diff(np.r_[at, len(first)]))
        x = {k: v[keep] for k, v in x.items()}
    n, sid, comp, left, blk = (x[k].astype(np.int64) for k in ("n", "sid", "comp", "left", "blk"))
    cross = x["lo"] != x["hi"]
    alive = np.arange(len(n))
    made = np.zeros(len(n), np.int32)
    us, vs, held = [], [], 0
    d = 0
    while len(alive) and (limit is None or d < REACH):
        d += 1
        alive = alive[alive >= d]
        back = alive - d
        ok = (x["sig"][alive] == x["sig"][back]) & (x["lo"][alive] == x["lo"][back]) & (x["hi"][alive] == x["hi"][back])
        ok &= 100 * n[back] >= threshold * n[alive]
        alive, back = alive[ok], back[ok]
        both = n[alive] + n[back]
        need = -(-threshold * both // (100 + threshold))
        good = (comp[alive] != comp[back]) & (left[alive] >= need) & (left[back] >= need) & (sid[alive] != sid[back])
        good &= x["before"][alive] != x["before"][back]
        good &= ~cross[alive] | (blk[alive] != blk[back])
        if "sketch" in x:
            at = np.flatnonzero(good)
            odd = np.bitwise_count(x["sketch"][alive[at]] ^ x["sketch"][back[at]]).sum(1, dtype=np.int64)
            good[at] = odd <= (both - 2 * need)[at]
        a, b = sid[alive[good]], sid[back[good]]
        us.append(np.minimum(a, b))
        vs.append(np.maximum(a, b))
        held += len(a)
        if limit is not None:
            made[alive[good]] += 1
            alive = alive[made[alive] < limit]
        if held > 1 << 20:
            yield _batch(us, vs)
            us, vs, held = [], [], 0
    if held:
        yield _batch(us, vs)


def parity(s: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the members of a set in each of ``bits`` places: two sets that differ in d members
    differ in at most d bits, also after a larger bitmap is folded onto the size of a smaller one."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _batch(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])


def linked_components(shared: DataFrame, threshold: int, links: Callable[[DataFrame], DataFrame], work: Workspace, sketches: DataFrame | None = None) -> DataFrame:
    """``node, root`` of the graph of verified pairs; ``links`` keeps the pairs that hold.

    ``sketches(sid, sketch)`` are fetched for the last pass, unless ``shared`` has them already.

    Each limited pass merges most of what is left of large groups; the last pass tries every pair
    of texts that are still in different components.
    """
    merged = None
    for turns, limit in (*PASSES, (None, None)):
        rows = shared if turns is None else shared.where(F.col("turn") <= turns)
        if merged is None:
            rows = rows.withColumn("comp", F.col("sid"))
        else:
            rows = rows.join(merged.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
        if limit is None and sketches is not None:
            rows = rows.join(sketches, "sid")
        new = links(candidate_pairs(rows, threshold, limit))
        if merged is not None:
            new = merged.select(F.col("node").alias("u"), F.col("root").alias("v")).union(new)
        merged = connected_components(new, work)
    return merged
