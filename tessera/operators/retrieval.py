"""Respelling, exact vector search, rank fusion, shards and relevance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.analyzer import bigrams, dot

RRF_CONSTANT, MAX_VARIANTS, MAX_CANDIDATES = 60, 8, 2000


def respellable(term: Column) -> Column:
    """Terms with a digit, overlong terms and terms under four letters are left as they are."""
    return (F.length(term) >= 4) & (F.length(term) <= 64) & ~term.rlike(r"\p{Nd}")


def radius(term: Column) -> Column:
    return F.when(F.length(term) <= 7, 1).otherwise(2)


def fuzzy_variants(tokens: DataFrame, vocabulary: DataFrame, limit: int = MAX_VARIANTS) -> DataFrame:
    """``token, term, distance, df, rank``: vocabulary terms within the token's radius.

    Padded bigrams propose candidates (each edit destroys at most two of them, so none is missed
    for tokens of four letters or more); edit distance decides.
    """
    known = vocabulary.where(F.length("term") <= 64)
    proper = tokens.select("token").distinct().where(respellable(F.col("token")))
    spelled = known.join(F.broadcast(proper.select(F.col("token").alias("term"))), "term", "left_semi").select(F.col("term").alias("token"))
    unknown = proper.join(F.broadcast(spelled), "token", "left_anti").withColumn("r", radius(F.col("token")))
    pairs = _sharing(unknown, known, F.col("r")).withColumn("distance", F.levenshtein("token", "term")).where(F.col("distance") <= F.col("r"))
    by = Window.partitionBy("token").orderBy("distance", F.desc("df"), "term")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("token", "term", "distance", "df", "rank")


def _sharing(tokens: DataFrame, vocabulary: DataFrame, r: Column) -> DataFrame:
    """Tokens with the terms of fitting length that share bigrams, ``overlap`` of them; the tokens are few and given, the vocabulary streams by."""
    left, right = tokens.withColumn("_t", bigrams(F.col("token"))), vocabulary.withColumn("_v", bigrams(F.col("term")))
    near = right.join(F.broadcast(left), (F.abs(F.length("token") - F.length("term")) <= r) & F.arrays_overlap("_t", "_v"))
    return near.withColumn("overlap", F.size(F.array_intersect("_t", "_v")).cast("long")).drop("_t", "_v")


def bigram_candidates(tokens: DataFrame, vocabulary: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The bounded form: the ``limit`` terms of fitting length that share most bigrams with a token."""
    shared = _sharing(tokens.select("token").distinct(), vocabulary.select("term"), radius(F.col("token"))).select("token", "term", "overlap")
    by = Window.partitionBy("token").orderBy(F.desc("overlap"), "term")
    return shared.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def vector_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query_id, id, score`` of every pair; the queries are few and given, the vectors stream by."""
    return vectors.join(F.broadcast(queries), F.lit(True)).select("query_id", "id", dot(F.col("embedding"), F.col("query")).alias("score"))


def fuse(branches: DataFrame, k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """``query_id, id, score, rank, ranks`` from rows ``(query_id, branch, id, rank)``."""
    fused = branches.groupBy("query_id", "id").agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", "rank")))).alias("ranks")
    )
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def shard_of(id_column: Column, shards: int) -> Column:
    """First eight bytes of the id's SHA-256, big-endian, modulo the number of shards."""
    head = F.conv(F.substring(F.sha2(id_column, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % shards).cast("int")


def first_ranks(run: DataFrame) -> DataFrame:
    """``query_id, doc_id, rank``: every document once, at its first place, ranks closed up from 1."""
    first = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    by = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return first.withColumn("rank", F.row_number().over(by))


def relevance(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query_id, ndcg_10, mrr_10, recall_10, recall_100, success_5`` of every judged query.

    ``run(query_id, doc_id, rank)``; a document counts at its first rank only.
    """
    placed = first_ranks(run)
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    ideal_by = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = qrels.withColumn("i", F.row_number().over(ideal_by)).groupBy("query_id").agg(
        F.sum(F.when(F.col("i") <= 10, gain(F.col("grade"), F.col("i")))).alias("ideal"), F.sum((F.col("grade") > 0).cast("int")).alias("relevant")
    )
    hit = placed.join(qrels, ["query_id", "doc_id"]).where("grade > 0")
    got = hit.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, gain(F.col("grade"), F.col("rank")))).alias("dcg"), F.max(F.when(F.col("rank") <= 10, 1.0 / F.col("rank"))).alias("mrr"),
        *[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in (5, 10, 100)],
    )
    part = lambda c, total: F.coalesce(F.when(F.col(total) > 0, F.col(c) / F.col(total)), F.lit(0.0))
    return ideal.join(got, "query_id", "left").select(
        "query_id", part("dcg", "ideal").alias("ndcg_10"), F.coalesce("mrr", F.lit(0.0)).alias("mrr_10"), part("h10", "relevant").alias("recall_10"),
        part("h100", "relevant").alias("recall_100"), F.coalesce((F.col("h5") > 0).cast("double"), F.lit(0.0)).alias("success_5"),
    )


def summarize(runs: DataFrame) -> DataFrame:
    """Means, counts and latency percentiles per system and group, from ``(system, groups, latency_ms, error, metrics...)``."""
    metrics = ("ndcg_10", "mrr_10", "recall_10", "recall_100", "success_5")
    return runs.withColumn("grp", F.explode("groups")).groupBy("system", "grp").agg(
        F.count("*").alias("queries"), F.count(F.when(F.col("error"), 1)).alias("errors"), *[F.avg(m).alias(m) for m in metrics],
        *[F.percentile("latency_ms", p / 100).alias(f"p{p}") for p in (50, 95, 99)],
    )


def coalesce_mutations(journal: DataFrame, above: int, through: int) -> DataFrame:
    """The last mutation of each id in ``(above, through]``."""
    return journal.where((F.col("revision") > above) & (F.col("revision") <= through)).groupBy("id").agg(F.max_by(F.struct(*[c for c in journal.columns if c != "id"]), "revision").alias("m")).select("id", "m.*")


def merge_live(live: DataFrame, tail: DataFrame) -> DataFrame:
    """``live`` after the coalesced mutations ``tail(id, document, ...)``: mutated ids go, unless deleted their new form comes."""
    return live.join(tail.select("id"), "id", "left_anti").unionByName(tail.where("document is not null").select(*live.columns))


def merge_shards(scores: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank`` from rows with a ``shard``: each shard's first ``k`` are merged, which gives the first ``k`` of all."""
    own = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "id")
    short = scores.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k).drop("place", "shard")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return short.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def spread(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Least, middle and greatest ``value`` of repeated runs."""
    return runs.groupBy(by).agg(F.min(value).alias("least"), F.percentile(value, 0.5).alias("middle"), F.max(value).alias("greatest"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, counted as often as they occur, that stand on one side only, with ``side``; none if the two are equal."""
    one = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return one(left, right, "left").unionByName(one(right, left, "right"))
