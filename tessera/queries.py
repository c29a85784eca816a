"""The catalogue of registered queries and their DuckDB counterparts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.evaluation.corpora import judged_grid, synthetic_documents
from tessera.functions.analyzer import nfkc_casefold, term_array
from tessera.functions.embedding import embedding_text
from tessera.operators import lexical, retrieval
from tessera.plans import dsl
from tessera.plans.catalog import published
from tessera.sources.documents import corpus, parts_corpus, vector_violation, violations

_TOKEN = r"[\p{L}\p{N}]+"
_BASE = rf"""c as (
  select 'doc-' || d.doc_id as id, d.doc_id, left(split_part(text, chr(10), 1), 200) as title, substr(text, length(left(split_part(text, chr(10), 1), 200)) + 1) as body,
    lang as category, source as tag, quality * 5.0 as rating from documents d left join labels l using (doc_id)),
t as (select *, regexp_extract_all(replace(lower(title), 'ß', 'ss'), '{_TOKEN}') as tt, regexp_extract_all(replace(lower(body), 'ß', 'ss'), '{_TOKEN}') as bt from c)"""
_POSTINGS = _BASE + """, f as (select id, 'title' as field, tt as ts from t union all select id, 'body', bt from t),
x as (select id, field, len(ts) as len, unnest(ts) as term from f),
p as (select id, field, term, len, count(*) as tf from x group by all),
st as (select field, count(*) filter (len(ts) > 0) as n, cast(sum(len(ts)) as bigint) as total_length from f group by 1),
df as (select field, term, count(*) as df from p group by all)"""
_BM25 = """s as (select q.query_id, q.grp, q.alt, p.id, sum(q.weight * case p.field when 'title' then 2.0 else 1.0 end * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2
    / (p.tf + 1.2 * (0.25 + 0.75 * p.len / (st.total_length / st.n)))) as s
  from q join p on p.term = q.term and (q.field is null or q.field = p.field) join df on df.term = p.term and df.field = p.field join st on st.field = p.field group by all),
b as (select query_id, id, sum(s) as score from (select query_id, grp, id, max(s) as s from s group by all) group by all)"""
_TOP = "select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from b qualify rank <= {k}"


def _scored(spark: SparkSession, d: str, rows: list[tuple] | DataFrame, k: int) -> DataFrame:
    """Top ``k`` of queries given as rows, whose terms are read by literal, or as a table of many queries, scored in one pass."""
    index = published(spark, d)
    if isinstance(rows, list):
        words = [r[3] for r in rows]
        scores = lexical.score(_alternatives(spark, rows), index.hits(words), index.stats, index.frequencies(words), selected=True)
        best = lexical.top_k(scores, k, digits=6)
    else:
        best = lexical.batch_top_k(rows, index.docs, index.stats, index.df, k, digits=6)
    return best.withColumn("rank", F.col("rank").cast("long"))


def _alternatives(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, lexical.QUERY_SCHEMA)


_WORDS = [("a", 0, 0, "the", None, 1.0), ("a", 1, 0, "idiot", None, 1.0), ("a", 2, 0, "license", None, 1.0)]
_GROUPS = [("g", 0, 0, "license", None, 1.0), ("g", 0, 1, "copyright", None, 0.8), ("g", 0, 2, "licensed", None, 0.7), ("g", 1, 0, "under", None, 1.0), ("g", 1, 1, "version", "body", 0.8)]


def _values(rows: list[tuple]) -> str:
    return "q(query_id, grp, alt, term, field, weight) as (values " + ", ".join("(" + ", ".join("null::varchar" if v is None else repr(v) for v in r) + ")" for r in rows) + ")"


QUERIES, ORACLE_SQL = {}, {}


def _register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@_register("bm25_two_field_topk", f"with {_POSTINGS}, {_values(_WORDS)}, {_BM25} {_TOP.format(k=20)}")
def bm25_two_field_topk(spark, d):
    return _scored(spark, d, _WORDS, 20)


@_register("bm25_alternative_max_groups", f"with {_POSTINGS}, {_values(_GROUPS)}, {_BM25} {_TOP.format(k=50)}")
def bm25_alternative_max_groups(spark, d):
    return _scored(spark, d, _GROUPS, 50)


@_register("bm25_batch_queries", f"""with {_POSTINGS},
q as (select distinct 'b-' || item_id as query_id, term as grp, 0 as alt, term, null::varchar as field, 1.0 as weight
  from (select item_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{_TOKEN}')) as term from benchmark)), {_BM25} {_TOP.format(k=10)}""")
def bm25_batch_queries(spark, d):
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("b-"), "item_id").alias("query_id"), F.explode(term_array(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")))).alias("term")).distinct()
    return _scored(spark, d, words.select("query_id", F.col("term").alias("grp"), F.lit(0).alias("alt"), "term", F.lit(None).cast("string").alias("field"), F.lit(1.0).alias("weight")), 10)


@_register("bm25_explain_rows", f"""with {_POSTINGS}, {_values(_WORDS)} select q.query_id, p.id, p.field, p.term, p.tf, df.df, round(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)), 6) as idf,
  round(q.weight * case p.field when 'title' then 2.0 else 1.0 end * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / (st.total_length / st.n))), 6) as contribution
  from q join p using (term) join df on df.term = p.term and df.field = p.field join st on st.field = p.field""")
def bm25_explain_rows(spark, d):
    index, words = published(spark, d), [r[3] for r in _WORDS]
    rows = lexical.explain_rows(_alternatives(spark, _WORDS), index.hits(words), index.stats, index.frequencies(words))
    return rows.withColumn("idf", F.round("idf", 6)).withColumn("contribution", F.round("contribution", 6))


@_register("token_positions", f"with {_BASE} select id, 'body' as field, unnest(bt) as term, unnest(range(len(bt))) as position from t union all select id, 'title', unnest(tt), unnest(range(len(tt))) from t")
def token_positions(spark, d):
    return published(spark, d).postings.select("id", "field", "term", F.explode(F.col("positions").cast("array<long>")).alias("position"))


@_register("term_frequency", f"with {_POSTINGS} select id, field, term, tf, len from p")
def term_frequency(spark, d):
    return published(spark, d).postings.select("id", "field", "term", "tf", F.col("len").cast("long").alias("len"))


@_register("document_frequency", f"with {_POSTINGS} select * from df")
def document_frequency(spark, d):
    return published(spark, d).df.select("field", "term", "df")


@_register("corpus_stats", f"with {_POSTINGS} select * from st")
def corpus_stats(spark, d):
    return published(spark, d).stats


@_register("vocabulary_size", f"with {_POSTINGS} select count(distinct term) as terms from p where length(term) <= 64")
def vocabulary_size(spark, d):
    return published(spark, d).df.where(F.length("term") <= 64).agg(F.countDistinct("term").alias("terms"))


def _match(name: str, query: str, where: str):
    @_register(name, f"with {_BASE} select id from t where {where}")
    def run(spark, d):
        index = published(spark, d)
        return dsl.matching(index.docs, index.postings, dsl.parse(query), index.buckets).select("id")


_IN = lambda w: f"(list_contains(tt, '{w}') or list_contains(bt, '{w}'))"
_match("term_filter", "license", _IN("license"))
_match("phrase_match", '"mit license"', "(' ' || array_to_string(tt, ' ') || ' ' like '% mit license %' or ' ' || array_to_string(bt, ' ') || ' ' like '% mit license %')")
_match("boolean_and_or_not", "the AND NOT license OR idiot", f"({_IN('the')} and not {_IN('license')}) or {_IN('idiot')}")
_match("not_of_conjunction", "NOT (the AND of)", f"not ({_IN('the')} and {_IN('of')})")
_match("or_with_leading_and", "(the AND idiot) OR license", f"({_IN('the')} and {_IN('idiot')}) or {_IN('license')}")
_match("field_scope", "title:(the OR der)", "list_contains(tt, 'the') or list_contains(tt, 'der')")
_match("keyword_eq", "category:EN", "category = 'en'")
_match("keyword_in_tags", "tags:src1 OR tags:src2", "tag in ('src1', 'src2')")
_match("numeric_range", "rating:>=4 rating:<=5", "coalesce(rating >= 4 and rating <= 5, false)")
_match("missing_metadata_not", "NOT rating:>=4", "not coalesce(rating >= 4, false)")


@_register("filter_only_zero_score", f"with {_BASE} select id, 0.0::double as score from t where category = 'de' order by id limit 100")
def filter_only_zero_score(spark, d):
    return published(spark, d).docs.where(dsl.compile_node(dsl.parse("category:de"))).select("id", F.lit(0.0).alias("score")).orderBy("id").limit(100)


@_register("parts_numeric_filter", "select 'part-' || p_partkey as id from part where p_retailprice > 950 and (p_size % 11) / 2.0 >= 3")
def parts_numeric_filter(spark, d):
    docs = lexical.analyzed(parts_corpus(spark, d), arrays=False)
    return docs.where(dsl.compile_node(dsl.parse("price:>950 AND rating:>=3"))).select("id")


_TOKENS = ["licence", "idiott", "whith", "copyrigth", "relased"]


@_register("fuzzy_variants", f"""with {_POSTINGS}, v as (select term, cast(sum(df) as bigint) as df from df where length(term) <= 64 group by 1),
k as (select unnest({_TOKENS!r}) as token), u as (select token, case when length(token) <= 7 then 1 else 2 end as r from k where token not in (select term from v)),
m as (select token, term, levenshtein(token, term) as distance, v.df from u join v on abs(length(token) - length(term)) <= r and levenshtein(token, term) <= r)
select token, term, distance, df, row_number() over (partition by token order by distance, df desc, term) as rank from m qualify rank <= 8""")
def fuzzy_variants(spark, d):
    vocabulary = published(spark, d).df.groupBy("term").agg(F.sum("df").alias("df"))
    out = retrieval.fuzzy_variants(spark.createDataFrame([(t,) for t in _TOKENS], "token string"), vocabulary)
    return out.withColumn("distance", F.col("distance").cast("long")).withColumn("rank", F.col("rank").cast("long"))


@_register("bigram_candidates", f"""with {_POSTINGS}, v as (select distinct term from df where length(term) <= 64), k as (select unnest({_TOKENS!r}) as token),
g as (select token as w, unnest(list_distinct(list_transform(range(1, length(token) + 2), lambda i: substr('^' || token || '$', i, 2)))) as g from k),
h as (select term as w, unnest(list_distinct(list_transform(range(1, length(term) + 2), lambda i: substr('^' || term || '$', i, 2)))) as g from v),
o as (select g.w as token, h.w as term, count(*) as overlap from g join h using (g) where abs(length(g.w) - length(h.w)) <= case when length(g.w) <= 7 then 1 else 2 end group by 1, 2)
select token, term, overlap, row_number() over (partition by token order by overlap desc, term) as rank from o qualify rank <= 2000""")
def bigram_candidates(spark, d):
    vocabulary = published(spark, d).df.where(F.length("term") <= 64).select("term").distinct()
    out = retrieval.bigram_candidates(spark.createDataFrame([(t,) for t in _TOKENS], "token string"), vocabulary)
    return out.withColumn("rank", F.col("rank").cast("long"))


_DOT = "round(list_inner_product(cast(e.embedding as double[]), cast(q.embedding as double[])), 6)"


def _vectors(spark, d, ids):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    queries = e.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query"))
    scores = retrieval.vector_scores(queries, e.select(F.col("vec_id").alias("id"), "embedding", "label"))
    return scores.withColumn("score", F.round("score", 6))


@_register("vector_batch_topk", f"""select cast(q.vec_id as varchar) as query_id, e.vec_id as id, {_DOT} as score, row_number() over (partition by q.vec_id order by {_DOT} desc, e.vec_id) as rank
from embeddings e, embeddings q where q.vec_id in (0, 1, 2, 3, 4) qualify rank <= 100""")
def vector_batch_topk(spark, d):
    return lexical.top_k(_vectors(spark, d, [0, 1, 2, 3, 4]), 100).withColumn("rank", F.col("rank").cast("long"))


@_register("vector_topk_filtered", f"select e.vec_id as id, {_DOT} as score from embeddings e, embeddings q where q.vec_id = 7 and e.label = 3 order by score desc, id limit 10")
def vector_topk_filtered(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id = 7").select(F.lit("q").alias("query_id"), F.col("embedding").alias("query"))
    scored = retrieval.vector_scores(q, e.where("label = 3").select(F.col("vec_id").alias("id"), "embedding")).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), "id").limit(10).select("id", "score")


@_register("rrf_fusion", f"""with {_POSTINGS}, {_values(_WORDS)}, {_BM25},
l as (select replace(id, 'doc-', '') as id, row_number() over (order by round(score, 6) desc, id) as rank from b qualify rank <= 100),
s as (select cast(e.vec_id as varchar) as id, row_number() over (order by {_DOT} desc, e.vec_id) as rank from embeddings e, embeddings q where q.vec_id = 7 qualify rank <= 100),
u as (select *, 'lexical' as br from l union all select *, 'semantic' from s)
select id, round(sum(1.0 / (60 + rank)), 9) as score, max(rank) filter (br = 'lexical') as lexical_rank, max(rank) filter (br = 'semantic') as semantic_rank from u group by id""".replace("s as (select q.query_id", "s0 as (select q.query_id").replace("from s group by all) group by all)", "from s0 group by all) group by all)"))
def rrf_fusion(spark, d):
    left = _scored(spark, d, _WORDS, 100).select(F.lit("q").alias("query_id"), F.lit("lexical").alias("branch"), F.replace("id", F.lit("doc-"), F.lit("")).alias("id"), "rank")
    right = lexical.top_k(_vectors(spark, d, [7]), 100).select(F.lit("q").alias("query_id"), F.lit("semantic").alias("branch"), F.col("id").cast("string").alias("id"), F.col("rank").cast("long").alias("rank"))
    fused = retrieval.fuse(left.unionByName(right), 1000)
    return fused.select("id", F.round("score", 9).alias("score"), F.col("ranks")["lexical"].alias("lexical_rank"), F.col("ranks")["semantic"].alias("semantic_rank"))


def _journal(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("revision"), F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("document"))


@_register("journal_coalesce", "select cast(user_id as varchar) as id, max(event_id) as revision, nullif(arg_max(event_type, event_id), 'error') as document from events where event_id > 100 group by 1")
def journal_coalesce(spark, d):
    """The tail after the visible revision 100, through the last one in the table."""
    journal = _journal(spark, d)
    return retrieval.coalesce_mutations(journal, 100, journal.agg(F.max("revision")).first()[0] or 0)


@_register("live_after_deletes", "select count(*) as live from (select arg_max(event_type, event_id) as e from events group by user_id) where e <> 'error'")
def live_after_deletes(spark, d):
    return retrieval.coalesce_mutations(_journal(spark, d), -1, 2**62).where("document is not null").agg(F.count("*").alias("live"))


@_register("shard_routing", "select 'doc-' || doc_id as id, cast(('0x' || substr(sha256('doc-' || doc_id), 1, 16))::ubigint % 7 as bigint) as shard from documents")
def shard_routing(spark, d):
    i = F.concat(F.lit("doc-"), "doc_id")
    return spark.read.parquet(f"{d}/documents.parquet").select(i.alias("id"), retrieval.shard_of(i, 7).cast("long").alias("shard"))


@_register("partial_coverage_topk", f"with {_POSTINGS}, {_values(_WORDS)}, {_BM25} select id, round(score, 6) as score from b where ('0x' || substr(sha256(id), 1, 16))::ubigint % 7 in (0, 2, 4) order by 2 desc, 1 limit 20")
def partial_coverage_topk(spark, d):
    index, words = published(spark, d), [r[3] for r in _WORDS]
    up = index.hits(words).where(retrieval.shard_of(F.col("id"), 7).isin(0, 2, 4))
    scores = lexical.score(_alternatives(spark, _WORDS), up, index.stats, index.frequencies(words), selected=True)
    return scores.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(20).select("id", "score")


@_register("ndcg_mrr_recall", f"""with s as (select q.vec_id as query_id, e.vec_id as doc_id, e.label = q.label as rel, row_number() over (partition by q.vec_id order by {_DOT} desc, e.vec_id) as rank
  from embeddings e, embeddings q where q.vec_id < 10), r as (select query_id, count(*) filter (rel) as relevant from s group by 1),
i as (select query_id, relevant, list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda x: 3 / log2(x + 1))) as ideal from r)
select query_id, round(sum(case when rel and rank <= 10 then 3 / log2(rank + 1) else 0 end) / any_value(ideal), 6) as ndcg_10, round(coalesce(max(1.0 / rank) filter (rel and rank <= 10), 0), 6)::double as mrr_10,
  round(count(*) filter (rel and rank <= 10) / any_value(relevant), 6) as recall_10, round(count(*) filter (rel and rank <= 100) / any_value(relevant), 6) as recall_100,
  (case when count(*) filter (rel and rank <= 5) > 0 then 1 else 0 end)::double as success_5 from s join i using (query_id) group by query_id""")
def ndcg_mrr_recall(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    run = lexical.top_k(_vectors(spark, d, list(range(10))), 100).select(F.col("query_id").cast("long").alias("query_id"), F.col("id").alias("doc_id"), "rank")
    same = e.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label")
    out = retrieval.relevance(run, same.select("query_id", "doc_id", F.lit(2).alias("grade")))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@_register("latency_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1")
def latency_percentiles(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(*[F.round(F.percentile("value", p / 100), 6).alias(f"p{p}") for p in (50, 95, 99)])


@_register("validation_violations", f"""with {_BASE} select id, array_to_string(list_filter([case when trim(title) = '' then 'title_blank' end, case when strlen(title) > 1024 then 'title_size' end,
  case when strlen(title) + strlen(body) > 65536 then 'text_size' end], lambda x: x is not null), ',') as violations from t""")
def validation_violations(spark, d):
    return corpus(spark, d).select("id", F.array_join(violations(), ",").alias("violations"))


@_register("unknown_judgments", "select doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def unknown_judgments(spark, d):
    english = spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'")
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id").join(english.select("doc_id"), "doc_id", "left_anti")


@_register("nfkc_casefold_tokens", f"with {_BASE} select id, cast(len(tt) + len(bt) as bigint) as n_terms from t")
def nfkc_casefold_tokens(spark, d):
    """The exact analyzer; the SQL folds by lower case and the sharp s, all that these texts need."""
    return corpus(spark, d).select("id", F.size(term_array(nfkc_casefold(embedding_text()))).cast("long").alias("n_terms"))


def _filters(name: str, filters: list[tuple], where: str):
    @_register(name, f"with {_BASE} select id from t where {where}")
    def run(spark, d):
        conditions = [dsl.filter_predicate(*f) for f in filters]
        return published(spark, d).docs.where(functools.reduce(Column.__and__, conditions)).select("id")


_filters("filter_keyword_in", [("category", "in", ["de", "FR"])], "category in ('de', 'fr')")
_filters("filters_conjunction", [("category", "eq", "EN"), ("tags", "in", ["src1", "src2", "src3"]), ("rating", "gte", 5)], "category = 'en' and tag in ('src1', 'src2', 'src3') and coalesce(rating >= 5, false)")
_match("phrase_in_field", 'body:"mit license" OR title:"mit license" AND NOT idiot', f"array_to_string(bt, ' ') ~ '(^|.* )mit license( .*|$)' or (array_to_string(tt, ' ') ~ '(^|.* )mit license( .*|$)' and not {_IN('idiot')})")

_HELD = lambda a: f"' ' || array_to_string({a}, ' ') || ' ' like '% mit license %'"


@_register("phrase_postings", f"with {_BASE} select id, 'title' as field from t where {_HELD('tt')} union all select id, 'body' from t where {_HELD('bt')}")
def phrase_postings(spark, d):
    return lexical.phrase_matches(published(spark, d).hits(["mit", "license"]), ["mit", "license"])


_PHRASE = [("p", 0, 0, "mit", None, 0.8), ("p", 0, 0, "license", None, 0.8)]


@_register("bm25_phrase_alternative", f"with {_POSTINGS}, {_values(_PHRASE)}, {_BM25} select id, round(score, 6) as score from b where id in (select id from t where {_HELD('tt')} or {_HELD('bt')})")
def bm25_phrase_alternative(spark, d):
    """A phrase scores as the sum of its words, in documents that hold it."""
    index, words = published(spark, d), ["mit", "license"]
    hits = index.hits(words)
    inside = hits.join(lexical.phrase_matches(hits, words).select("id").distinct(), "id", "left_semi")
    return lexical.score(_alternatives(spark, _PHRASE), inside, index.stats, index.frequencies(words), selected=True).select("id", F.round("score", 6).alias("score"))


_ONE = [("z", 0, 0, "license", None, 1.0)]


@_register("zero_filled_scores", f"with {_POSTINGS}, {_values(_ONE)}, {_BM25} select t.id, coalesce(round(score, 6), 0.0)::double as score from t left join b using (id) where {_IN('license')} or category = 'de'")
def zero_filled_scores(spark, d):
    """Documents that a query admits by a filter alone score zero."""
    index = published(spark, d)
    eligible = dsl.matching(index.docs, index.postings, dsl.parse("license OR category:de"), index.buckets).select("id")
    scores = lexical.score(_alternatives(spark, _ONE), index.hits(["license"]), index.stats, index.frequencies(["license"]), eligible, selected=True)
    return eligible.join(scores.drop("query_id"), "id", "left").select("id", F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score"))


@_register("fetched_second_page", f"with {_POSTINGS}, {_values(_WORDS)}, {_BM25}, r as ({_TOP.format(k=20)}) select r.rank, r.id, c.title, c.category from r join c using (id) where r.rank > 10")
def fetched_second_page(spark, d):
    page = _scored(spark, d, _WORDS, 20).where("rank > 10").select("rank", "id")
    return page.join(published(spark, d).docs.select("id", "title", "category"), "id").select("rank", "id", "title", "category")


_SPELLED = f"""v as (select term, cast(sum(df) as bigint) as df from df where length(term) <= 64 group by 1),
k as (select unnest({_TOKENS!r}) as token), u as (select token, case when length(token) <= 7 then 1 else 2 end as r from k where token not in (select term from v)),
m as (select token, term, levenshtein(token, term) as distance, v.df from u join v on abs(length(token) - length(term)) <= r and levenshtein(token, term) <= r),
y as (select token, term, row_number() over (partition by token order by distance, df desc, term) as rank from m qualify rank <= 8),
q as (select 'f' as query_id, token as grp, rank as alt, term, null::varchar as field, 0.7 as weight from y union all select 'f', token, 0, token, null, 1.0 from k)"""


@_register("bm25_respelled", f"with {_POSTINGS}, {_SPELLED}, {_BM25} {_TOP.format(k=50)}")
def bm25_respelled(spark, d):
    """Each token and its respellings, at a lower weight, are alternatives of one group."""
    index = published(spark, d)
    tokens = spark.createDataFrame([(t,) for t in _TOKENS], "token string")
    near = retrieval.fuzzy_variants(tokens, index.df.groupBy("term").agg(F.sum("df").alias("df"))).collect()
    rows = [("f", _TOKENS.index(r.token), r["rank"], r.term, None, 0.7) for r in near]
    return _scored(spark, d, [("f", g, 0, t, None, 1.0) for g, t in enumerate(_TOKENS)] + rows, 50)


@_register("protected_terms", f"with {_POSTINGS} select distinct term from df where length(term) < 4 or length(term) > 64 or regexp_matches(term, '\\p{{Nd}}')")
def protected_terms(spark, d):
    return published(spark, d).df.where(~retrieval.respellable(F.col("term"))).select("term").distinct()


@_register("cardinality_estimate", f"with {_POSTINGS}, n as (select term, sum(df) as n from df group by 1) select cast(least((select n from n where term = 'license'), least((select count(*) from c), (select sum(n) from n where term in ('the', 'idiot')))) as bigint) as most")
def cardinality_estimate(spark, d):
    """The upper bound by which conjuncts can be ordered: three document frequencies and a count."""
    index, words = published(spark, d), ["license", "the", "idiot"]
    df = {r.term: r.n for r in index.frequencies(words).groupBy("term").agg(F.sum("df").alias("n")).collect()}
    return spark.createDataFrame([(dsl.estimate(dsl.parse("license AND (the OR idiot)"), df, index.docs.count()),)], "most long")


@_register("shard_sizes", f"with {_POSTINGS}, k as (select id, cast(('0x' || substr(sha256(id), 1, 16))::ubigint % 7 as bigint) as shard from c) select shard, count(distinct k.id) as documents, count(p.term) as postings from k left join p using (id) group by 1")
def shard_sizes(spark, d):
    index, shard = published(spark, d), retrieval.shard_of(F.col("id"), 7).cast("long").alias("shard")
    counted = index.postings.groupBy(shard).agg(F.count("*").alias("postings"))
    return index.docs.groupBy(shard).agg(F.count("*").alias("documents")).join(counted, "shard", "left").select("shard", "documents", F.coalesce("postings", F.lit(0)).alias("postings"))


@_register("shard_merge_topk", f"with {_POSTINGS}, {_values(_WORDS)}, {_BM25} {_TOP.format(k=20)}")
def shard_merge_topk(spark, d):
    """The first of each of seven shards, merged, are the first of the whole."""
    index, words = published(spark, d), [r[3] for r in _WORDS]
    scores = lexical.score(_alternatives(spark, _WORDS), index.hits(words), index.stats, index.frequencies(words), selected=True)
    dealt = scores.select("query_id", "id", F.round("score", 6).alias("score"), retrieval.shard_of(F.col("id"), 7).alias("shard"))
    return retrieval.merge_shards(dealt, 20).withColumn("rank", F.col("rank").cast("long"))


@_register("index_statistics", f"with {_POSTINGS} select (select count(*) from c) as documents, (select count(*) from p) as postings, (select count(distinct term) from df) as terms, (select cast(sum(strlen(coalesce(title, '')) + strlen(coalesce(body, ''))) as bigint) from c) as text_bytes")
def index_statistics(spark, d):
    index = published(spark, d)
    size = F.sum(F.octet_length(F.coalesce("title", F.lit(""))) + F.octet_length(F.coalesce("body", F.lit("")))).cast("long")
    docs = index.docs.agg(F.count("*").alias("documents"), size.alias("text_bytes"))
    return docs.crossJoin(index.postings.agg(F.count("*").alias("postings"))).crossJoin(index.df.agg(F.countDistinct("term").alias("terms"))).select("documents", "postings", "terms", "text_bytes")


@_register("embedding_texts", f"with {_BASE} select id, md5(concat_ws(chr(10), title, body)) as text_md5 from c")
def embedding_texts(spark, d):
    return published(spark, d).docs.select("id", F.md5(embedding_text().cast("binary")).alias("text_md5"))


@_register("invalid_vectors", """with v as (select vec_id, case vec_id % 100 when 7 then embedding[:3] when 11 then null when 13 then list_transform(embedding, lambda x: 0::float) else embedding end as v, len(embedding) as n from embeddings)
select vec_id, coalesce(len(v) <> n or sqrt(list_sum(list_transform(v, lambda x: x::double * x))) < 1e-6, true) as bad from v""")
def invalid_vectors(spark, d):
    """The check at ingest, over vectors of which some are cut, missing or zero."""
    e, rest = spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 100
    size = e.select(F.size("embedding")).first()
    spoilt = F.when(rest == 7, F.slice("embedding", 1, 3)).when(rest == 11, F.lit(None)).when(rest == 13, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return e.select("vec_id", spoilt.alias("v")).select("vec_id", vector_violation("v", size[0] if size else 0).alias("bad"))


@_register("live_after_merge", "select cast(user_id as varchar) as id, arg_max(event_type, event_id) as document from events group by 1 having arg_max(event_type, event_id) <> 'error'")
def live_after_merge(spark, d):
    """A first generation through the middle revision, merged with the coalesced rest, is the live set."""
    journal = _journal(spark, d)
    last = journal.agg(F.max("revision")).first()[0] or 0
    base = retrieval.coalesce_mutations(journal, -1, last // 2).where("document is not null").select("id", "document")
    return retrieval.merge_live(base, retrieval.coalesce_mutations(journal, last // 2, last))


@_register("ordered_distinct", "select cast(user_id as varchar) as query_id, event_type as doc_id, row_number() over (partition by user_id order by min(event_id), event_type) as rank from events group by user_id, event_type")
def ordered_distinct(spark, d):
    run = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("doc_id"), F.col("event_id").alias("rank"))
    return retrieval.first_ranks(run).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@_register("run_spread", "select event_type, min(value) as least, round(median(value), 6) as middle, max(value) as greatest from events group by 1")
def run_spread(spark, d):
    return retrieval.spread(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value").withColumn("middle", F.round("middle", 6))


@_register("set_difference", "(select doc_id, 'left' as side from (select doc_id from documents except all select doc_id from labels)) union all (select doc_id, 'right' from (select doc_id from labels except all select doc_id from documents))")
def set_difference(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet").select("doc_id")
    return retrieval.set_difference(read("documents"), read("labels"))


_METRICS = ("ndcg_10", "mrr_10", "recall_10", "recall_100", "success_5")


@_register("run_summaries", f"""with r as (select event_type as system, ['all', 'g' || user_id % 3] as groups, value as latency_ms, event_id % 11 = 0 as error, {', '.join(f'(event_id % {i + 3}) / {i + 3}.0 as {m}' for i, m in enumerate(_METRICS))} from events),
x as (select *, unnest(groups) as grp from r) select system, grp, count(*) as queries, count(*) filter (error) as errors, {', '.join(f'round(avg({m}), 6) as {m}' for m in _METRICS)},
  {', '.join(f'round(quantile_cont(latency_ms, {p / 100}), 6) as p{p}' for p in (50, 95, 99))} from x group by 1, 2""")
def run_summaries(spark, d):
    """Means, counts and percentiles per system and group, with events as the judged runs."""
    e = spark.read.parquet(f"{d}/events.parquet")
    runs = e.select(F.col("event_type").alias("system"), F.array(F.lit("all"), F.concat(F.lit("g"), F.col("user_id") % 3)).alias("groups"), F.col("value").alias("latency_ms"), (F.col("event_id") % 11 == 0).alias("error"), *[((F.col("event_id") % (i + 3)) / float(i + 3)).alias(m) for i, m in enumerate(_METRICS)])
    out = retrieval.summarize(runs)
    return out.select("system", "grp", "queries", "errors", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@_register("metrics_without_positives", """with j as (select event_id // 20 as query_id, event_id as doc_id, event_id % 20 + 1 as rank, case when (event_id // 20) % 2 = 0 then 0 else event_id % 3 end as grade from events),
r as (select query_id, cast(sum(case when rank <= 10 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as double) as dcg, count(*) filter (grade > 0) as relevant, count(*) filter (grade > 0 and rank <= 10) as h10, count(*) filter (grade > 0 and rank <= 5) as h5,
  min(rank) filter (grade > 0 and rank <= 10) as first from j group by 1),
i as (select query_id, sum((pow(2, grade) - 1) / log2(k + 1)) as ideal from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as k from j) where k <= 10 group by 1)
select query_id, round(case when ideal > 0 then dcg / ideal else 0 end, 6) as ndcg_10, round(coalesce(1.0 / first, 0), 6)::double as mrr_10, round(case when relevant > 0 then h10 / relevant else 0 end, 6) as recall_10,
  (case when relevant > 0 then 1 else 0 end)::double as recall_100, (case when h5 > 0 then 1 else 0 end)::double as success_5 from r join i using (query_id)""")
def metrics_without_positives(spark, d):
    """Graded judgments; every other query has no positive one and scores zero."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.expr("event_id div 20").alias("query_id"), F.col("event_id").alias("doc_id"), (F.col("event_id") % 20 + 1).alias("rank"))
    graded = e.select("query_id", "doc_id", F.when(F.col("query_id") % 2 == 0, 0).otherwise(F.col("doc_id") % 3).cast("int").alias("grade"))
    out = retrieval.relevance(e, graded)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_DRAWN = lambda key, below: f"cast('0x' || substr(md5('0-' || n || '-' || {key}), 1, 8) as bigint) % {below}"


@_register("synthetic_corpus", f"""with g as (select unnest(range((select count(*) from documents))) as n),
w as (select n, list_transform(range(1, 25), lambda k: 't' || cast(floor(({_DRAWN("k || '-a'", 5000)}) * ({_DRAWN("k || '-b'", 5000)}) / 5000.0) as bigint)) as w from g)
select 'syn-' || n as id, 'topic' || n % 100 as title, array_to_string(w, ' ') as body, 'c' || n % 7 as category, ({_DRAWN("'rating'", 11)}) / 2.0::double as rating from w""")
def synthetic_corpus(spark, d):
    """As many generated documents as the table has."""
    count = spark.read.parquet(f"{d}/documents.parquet").count()
    return synthetic_documents(spark, count).select("id", "title", "body", "category", "rating")


_INTENTS = [("fix a leaking tap", "plumber for taps", "tap dance lessons"), ("piano for beginners", "piano lessons", "piano removal")]


@_register("judged_grid", f"""with t(i, asked, answered, confused) as (values {', '.join(str((i, *t)) for i, t in enumerate(_INTENTS))}), p as (select *, unnest(range(6)) as k from t)
select printf('q-%03d', i) as query_id, asked, printf('intent-%03d-%02d', i, k) as doc_id, case when k < 3 then answered else confused end || ' ' || k as title, case when k = 0 then 2 when k < 3 then 1 else 0 end as grade from p""")
def judged_grid_rows(spark, d):
    documents, asked, grades = judged_grid(spark, _INTENTS)
    out = grades.join(documents.select(F.col("id").alias("doc_id"), "title"), "doc_id").join(asked.select(F.col("id").alias("query_id"), F.col("text").alias("asked")), "query_id")
    return out.select("query_id", "asked", "doc_id", "title", F.col("grade").cast("long").alias("grade"))
