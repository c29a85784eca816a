"""The published index and the batch of queries, at more than one file and task."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical, retrieval
from tessera.plans import catalog
from tessera.queries import QUERIES

WORDS = ["the", "licence", "license", "licensed", "idiot", "idiott", "straße", "x1", "a", "under", "version", "copyright", "copyrights", "relaxed", "released"]


def texts(n):
    return [(f"d{i}", " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 2 + i % 4)), " ".join(WORDS[(i + k * k) % len(WORDS)] for k in range(i % 9)) if i % 7 else None) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, body string").repartition(3)


def rows(t, *columns):
    return sorted(map(tuple, t.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    docs = [(i, f"{title or ''}\n{body or ''}", "de" if i % 3 else "en", "src1", 10) for i, (_, title, body) in enumerate(texts(60))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 0.5) for i in range(0, 60, 2)], "doc_id long, quality double").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(i, f"The {WORDS[i]} {WORDS[-i]}") for i in range(9)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def plan(t):
    t.collect()
    return t._jdf.queryExecution().executedPlan().toString()


ALTERNATIVES = [
    *[(f"q{i}", g, 0, WORDS[(i + g * 2) % len(WORDS)], None, 1.0) for i in range(150) for g in range(3)],
    ("alt", 0, 0, "license", None, 1.0), ("alt", 0, 1, "licence", "title", 0.7), ("alt", 0, 1, "licensed", None, 0.7), ("alt", 1, 0, "the", "body", 0.5), ("none", 0, 0, "absent", None, 1.0),
]


@pytest.mark.parametrize("more", [[], [("d1", "the license", "the"), ("d7", "idiot", None), (None, "the", "licensed"), (None, "the the", "")]])
def test_batch_equals_general_scores(spark, monkeypatch, more):
    docs = table(spark, texts(80) + [(f"copy{i}", "the license", "under license") for i in range(20)] + more)
    posted = lexical.index_postings(docs)
    given = spark.createDataFrame(ALTERNATIVES, lexical.QUERY_SCHEMA)
    args = lexical.stats_of(posted), lexical.document_frequency(posted)
    plain = lexical.top_k(lexical.score(given, posted, *args), 5, digits=6)
    assert rows(lexical.batch_top_k(given, docs, *args, 5, digits=6), "query_id", "id", "score", "rank") == rows(plain, "query_id", "id", "score", "rank")
    with pytest.raises(ValueError, match="positive"):
        lexical.batch_top_k(given.withColumn("weight", F.lit(0.0)), docs, *args, 5)


def test_batch_queries_do_not_move_pairs(spark, folder):
    """Only each task's first of a query are moved, not a row for each query and document that share a term."""
    p = plan(QUERIES["bm25_batch_queries"](spark, folder))
    assert "MapInArrow" in p and "Join" not in p and "keys=[query_id" not in p


def test_every_file_of_postings_is_sorted_by_its_own_task(spark, tmp_path, monkeypatch):
    docs = table(spark, texts(400)).cache()
    for name, value in (("BUCKET_BYTES", 400), ("MOST_BUCKETS", 20), ("TASK_BYTES", 1), ("PACK_TERMS", 300)):
        monkeypatch.setattr(lexical, name, value, raising=False)
    buckets = lexical.write_postings(docs, f"{tmp_path}/p")
    found = spark.read.parquet(f"{tmp_path}/p")
    assert rows(found, "id", "field", "term", "tf", "len", "positions") == rows(lexical.index_postings(docs), "id", "field", "term", "tf", "len", "positions")
    assert found.where(F.col("bucket") != lexical.bucket(F.col("term"), buckets)).isEmpty()
    files = [str(p) for p in Path(f"{tmp_path}/p").rglob("part-*.parquet")]
    tasks = [re.search(r"part-(\d+)", p)[1] for p in files]
    assert len(files) == len(set(tasks)) > len({re.search(r"bucket=(\d+)", p)[1] for p in files}) > 5
    for p in files:
        keys = [(r.term, r.field, r.id) for r in spark.read.parquet(p).collect()]
        assert keys == sorted(keys)


def test_postings_of_odd_documents(spark, tmp_path):
    odd = table(spark, [(None, "a", None), ("x", "", None), ("x", "ﬁ ß", "\x00 \U0001d54f"), ("x", "a a", "a"), ("big", None, "w " * 50_000)])
    lexical.write_postings(odd, f"{tmp_path}/p", 3)
    columns = "id", "field", "term", "tf", "len", "positions"
    assert rows(spark.read.parquet(f"{tmp_path}/p"), *columns) == rows(lexical.index_postings(odd), *columns)
    lexical.write_postings(odd.limit(0), f"{tmp_path}/none")
    assert spark.read.schema(f"{lexical.POSTINGS}, bucket int").parquet(f"{tmp_path}/none").isEmpty()


def grams(w):
    return {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}


def test_bigram_candidates_stream_the_vocabulary(spark):
    """The given tokens are sent to the vocabulary; a token that comes twice counts once."""
    tokens = spark.createDataFrame([(t,) for t in ("licence", "idiott", "licence", "relased")], "token string")
    got = retrieval.bigram_candidates(tokens, spark.createDataFrame([(w,) for w in WORDS], "term string"))
    want = sorted((t, w, len(grams(t) & grams(w))) for t in ("licence", "idiott", "relased") for w in WORDS if abs(len(t) - len(w)) <= (1 if len(t) <= 7 else 2) and grams(t) & grams(w))
    assert sorted((r.token, r.term, r.overlap) for r in got.collect()) == want
    assert "Generate" not in plan(got) and "SortMergeJoin" not in plan(got)


def test_respelled_reads_its_own_terms(spark, folder):
    got = QUERIES["bm25_respelled"](spark, folder)
    scans = [x for x in plan(got).split("\n") if "FileScan parquet" in x and "tf#" in x]
    assert scans and all("In(term" in x for x in scans) and got.count() > 0


def test_zero_filled_scores_by_hand(spark, folder):
    got = {r.id: r.score for r in QUERIES["zero_filled_scores"](spark, folder).collect()}
    docs = {r.id: r for r in catalog.published(spark, folder).docs.collect()}
    holds = {i for i, r in docs.items() if "license" in f"{r.title} {r.body}".split()}
    assert set(got) == holds | {i for i, r in docs.items() if r.category == "de"} and {i for i, s in got.items() if s > 0} == holds
