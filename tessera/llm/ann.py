"""Approximate nearest neighbours by inner product: inverted file, product quantisation, reranking.

Vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the largest norm, so that the nearest
by Euclidean distance are the largest by inner product. Coarse centroids and the codebooks of the
residuals are fitted on at most TRAIN_BOUND vectors (those with the smallest hash of vec_id); every
vector is then indexed: its list, its codes, itself. Lists make up shards of about SHARD vectors:
small neighbouring ones share a shard, a crowded one is dealt by hash over several. A query goes to
the shards of the lists that it visits and to no others; where more than CELL queries meet in a
shard, it is searched by several tasks. A query ranks the members of its lists with a distance table
over the codes, and the best RERANK x k, with all that tie with the last of them, are measured
exactly on the original vectors in double precision. How many lists it visits is set on the sample,
so that they hold COVERAGE of the true neighbours there; a query whose lists hold fewer than k
vectors of other vec_ids, over all shards, visits further ones.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of
another length than the most common one (the shorter, if two are). Several rows of one vec_id are
candidates each; a query never finds its own vec_id and is asked once, with the least of its vectors.
Ties go to the smaller vec_id. Extra columns, whatever their names, are ignored; an empty table or
no query gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

TRAIN_BOUND = 10_000
#: Most lists; vectors of a shard, queries that a task meets in one, and those of them searched at once.
LISTS, SHARD, CELL, CHUNK = 1024, 16_384, 4096, 256
COVERAGE, RERANK = 0.985, 40
PARTS, CODES = 16, 256


@dataclass
class AnnModel:
    centroids: np.ndarray  # lists x (d + 1)
    books: list[np.ndarray]  # of each part: codes x width
    edges: np.ndarray  # where parts begin and end
    probes: int
    most: float  # largest norm


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _extend(x: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most**2 - (x.astype(float) ** 2).sum(1), 0))
    return np.c_[x, rest].astype(np.float32)


def _direction(x: np.ndarray) -> np.ndarray:
    """Along which the points differ most."""
    return np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]


def _nearest_list(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(1), 1)


def fit(sample: np.ndarray, most: float, k: int, total: int) -> AnnModel:
    rng = np.random.default_rng(7)
    x = _extend(sample, most)
    centroids = _k_means(x, int(max(1, min(LISTS, total**0.5, len(x) ** 0.5 * 2))), 8, rng)
    centroids = centroids[np.argsort(centroids @ _direction(centroids), kind="stable")]  # neighbours in a row
    home = _nearest_list(x, centroids)
    residual = x - centroids[home]
    edges = np.unique(np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int))
    books = [_k_means(residual[:, a:b], CODES, 6, rng) for a, b in zip(edges, edges[1:])]
    ask = rng.choice(len(x), min(400, len(x)), replace=False)
    scores = sample[ask].astype(float) @ sample.T.astype(float)
    scores[np.arange(len(ask)), ask] = -np.inf
    top = np.argsort(-scores, 1)[:, : max(1, min(k, len(x) - 1))]
    query = np.c_[sample[ask], np.zeros(len(ask))].astype(np.float32)
    place = np.argsort(np.argsort(-_list_order(query, centroids), 1), 1)
    ranks = np.sort(np.take_along_axis(place, home[top], 1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(len(ranks) * COVERAGE))]) + 1
    return AnnModel(centroids, books, edges, probes, most)


def _list_order(query: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return query @ centroids.T - 0.5 * (centroids**2).sum(1)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0), values.dtype)


def _encode(model):
    def encode(batches):
        m = model.value
        for batch in batches:
            raw = _matrix(batch.column(1))
            if not len(raw):
                continue
            x = _extend(raw, m.most)
            home = _nearest_list(x, m.centroids)
            residual = x - m.centroids[home]
            codes = np.stack([_nearest_list(residual[:, a:b], book) for a, b, book in zip(m.edges, m.edges[1:], m.books)], 1).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home.astype(np.int32)), packed], names=["vec_id", "embedding", "list", "codes"])

    return encode


def shard_plan(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each list, and how many it has of its own (1 if it may share it)."""
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    now, held = 0, 0
    for j, size in enumerate(sizes.tolist()):
        if held and held + size > SHARD:
            now, held = now + 1, 0
        first[j], count[j] = now, max(1, -(-size // SHARD))
        if count[j] > 1:
            now, held = now + int(count[j]), 0
        else:
            held += size
    return first, count


def _visits(m: AnnModel, wide: np.ndarray, copies: np.ndarray, k: int, sizes: np.ndarray) -> np.ndarray:
    """Which lists each query visits."""
    order = np.argsort(-_list_order(wide, m.centroids), 1)
    visits = np.zeros((len(wide), len(m.centroids)), bool)
    # Rows of the query's own vec_id do not count towards the k.
    before = np.cumsum(sizes[order], 1) - sizes[order]
    wanted = (np.arange(order.shape[1]) < m.probes) | (before < k + copies[:, None])
    np.put_along_axis(visits, order, wanted, 1)
    return visits & (sizes > 0)


def _wide(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.zeros(len(x))].astype(np.float32)


def _route(model, k: int, sizes: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Each query once for every shard that it visits."""
    shards = int((first + count).max())

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            visits = _visits(model.value, _wide(_matrix(batch.column(1))), batch.column(2).to_numpy(), k, sizes)
            to = np.zeros((len(visits), shards), bool)
            for j in np.flatnonzero(visits.any(0)).tolist():
                to[:, first[j] : first[j] + count[j]] |= visits[:, j : j + 1]
            who, shard = np.nonzero(to)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *(c.take(pa.array(who)) for c in batch.columns)], names=["shard", "vec_id", "embedding", "copies"])

    return route


def _search(model, k: int, sizes: np.ndarray):
    names = ["query_id", "vec_id", "score"]

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        m = model.value
        ids, x = index.column("vec_id").to_numpy(), _matrix(index.column("embedding"))
        codes = np.frombuffer(b"".join(index.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        home = index.column("list").to_numpy()
        lists = [(j, np.flatnonzero(home == j)) for j in np.unique(home).tolist()]
        take = min(len(ids), k * RERANK)
        out = [], [], []
        for at in range(0, asked.num_rows, CHUNK):
            some = asked.slice(at, CHUNK)
            own, q = some.column("vec_id").to_numpy(), _matrix(some.column("embedding"))
            wide = _wide(q)
            visits = _visits(m, wide, some.column("copies").to_numpy(), k, sizes)
            tables = [wide[:, a:b] @ book.T for a, b, book in zip(m.edges, m.edges[1:], m.books)]
            coarse = wide @ m.centroids.T
            rough = np.full((len(q), len(ids)), -np.inf, np.float32)
            for j, rows in lists:
                who = np.flatnonzero(visits[:, j])
                if len(who):
                    part = np.repeat(coarse[who, j][:, None], len(rows), 1)
                    for p, table in enumerate(tables):
                        part += table[np.ix_(who, codes[rows, p])]
                    rough[np.ix_(who, rows)] = part
            for i in range(len(q)):
                free = np.where(ids == own[i], -np.inf, rough[i])
                least = -np.partition(-free, take - 1)[take - 1]
                best = np.flatnonzero((free >= least) & np.isfinite(free))
                # Summed row by row: equal vectors get equal scores whatever stands beside them.
                exact = (x[best].astype(float) * q[i].astype(float)).sum(1)
                top = np.lexsort((ids[best], -exact))[:k]
                for c, v in zip(out, (np.full(len(top), own[i]), ids[best][top], exact[top])):
                    c.append(v)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=names)

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (float array) of the rows that take part."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 "
        "and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(embedding, x -> x <> 0)"
    )
    width = good.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return good.where(F.size("embedding") == (width.w if width else 0))


def nearest(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of each row for which ``queries`` holds."""
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    good = usable(vectors)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    facts = good.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.count(F.when(queries, 1)).alias("asked")).first()
    if not facts.n or not facts.asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_BOUND).select("embedding").toArrow()
    model = spark.sparkContext.broadcast(fit(_matrix(sample.column(0)).astype(np.float32), facts.most, k, facts.n))
    index = work.save(good.mapInArrow(_encode(model), "vec_id long, embedding array<double>, list int, codes binary"))
    sizes = np.zeros(len(model.value.centroids), np.int64)
    for row in index.groupBy("list").count().collect():  # at most LISTS rows
        sizes[row["list"]] = row["count"]
    first, count = shard_plan(sizes)
    of_list = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("list"))
    index = index.withColumn("shard", (of_list(first) + F.pmod(F.xxhash64("vec_id"), of_list(count))).cast("int"))
    copies = good.groupBy("vec_id").agg(F.count("*").alias("copies"))
    asked = good.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).join(copies, "vec_id").select("vec_id", "embedding", "copies")
    routed = work.save(asked.mapInArrow(_route(model, k, sizes, first, count), "shard int, vec_id long, embedding array<double>, copies long"))
    cells = work.save(routed.groupBy("shard").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")))
    left = index.join(cells, "shard").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    again = cells.select("shard", F.col("cells").alias("among"))
    right = routed.join(again, "shard").withColumn("cell", F.expr("cast(pmod(xxhash64(vec_id, 1), among) as int)")).drop("among")
    found = left.groupBy("shard", "cell").cogroup(right.groupBy("shard", "cell")).applyInArrow(_search(model, k, sizes), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
