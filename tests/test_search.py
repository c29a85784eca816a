import itertools
import json
import math
import random

import pytest

from tessera.errors import SearchError
from tessera.operators import lexical, retrieval
from tessera.plans import dsl
from tessera.plans.engine import Filter, SearchEngine, SearchRequest
from tessera.sources.documents import DOC_SCHEMA, load_synonyms, read_jsonl, read_qrels
from tessera.sources.store import Index
from tessera.streaming.refresh import refresh_stream

DOCS = [
    ("a", "Bluetooth earbuds", "Wireless music listening", "product", None, [], None, 4.5),
    ("b", "AC repair", "Air conditioner not cooling repair", "service", None, [], None, 4.8),
    ("c", "Distributed systems", "reliability database storage", "document", None, [], None, 4.2),
    ("d", "Beginner storage", "distributed new systems", "document", None, [], None, 2.0),
]


def table(spark, rows=DOCS):
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    with Index(spark, str(tmp_path_factory.mktemp("index") / "i"), create=True) as i:
        i.ingest(table(spark))
        i.refresh()
        yield i


def ask(index, q, **more):
    more.setdefault("timeout_ms", 5000)
    return [h["id"] for h in SearchEngine(index.snapshot(), synonyms=more.pop("rules", None)).search(SearchRequest(q, **more))["hits"]]


@pytest.mark.parametrize(("query", "ids"), [
    ('"distributed systems" AND reliability', "c"), ("title:(database OR storage)", "d"), ("rating:>=4 AND NOT kind:product", "bc"), ("NOT beginner", "abc"),
    ("storage OR earbuds AND kind:product", "acd"), ('title:"distributed systems"', "c"), ('"systems reliability"', ""), ("tags:missing", ""), ("rating:>=4 rating:<3", ""),
    ("NOT (storage AND distributed)", "ab"), ("(storage AND reliability) OR earbuds", "ac"), ("earbuds OR (storage AND reliability)", "ac"),
    ("repair AND (NOT (music AND wireless) OR music)", "b"),
])
def test_match_sets(spark, query, ids):
    docs = lexical.analyzed(table(spark))
    assert {r.id for r in docs.where(dsl.compile_node(dsl.parse(query))).select("id").collect()} == set(ids)


@pytest.mark.parametrize("query", ['"unclosed', "x AND", "()", "foo:", "rating:abc", "missing:foo", "title:(body:foo)", "x )", "NOT", "(" * 20 + "x" + ")" * 20, '"a\tb"', '"\\n"', "rating:"])
def test_bad_queries(query):
    with pytest.raises(SearchError):
        dsl.parse(query)


def test_quoted_punctuation_is_text():
    assert dsl.parse('"a" b').kind == "and"
    with pytest.raises(SearchError):
        dsl.parse('x ")"')  # no searchable text, not a bracket


def test_random_trees_match_set_algebra(spark):
    docs = lexical.analyzed(table(spark)).cache()
    words = ["storage", "systems", "repair", "music", "new", "absent"]
    held = {w: {d[0] for d in DOCS if w in f"{d[1]} {d[2]}".lower().split()} for w in words}
    rng = random.Random(3)

    def tree(depth):
        kind = rng.choice(["term", "and", "or", "not"]) if depth else "term"
        if kind == "term":
            w = rng.choice(words)
            return w, held[w]
        if kind == "not":
            q, s = tree(depth - 1)
            return f"NOT ({q})", set("abcd") - s
        (q, s), (r, t) = tree(depth - 1), tree(depth - 1)
        return f"(({q}) {kind.upper()} ({r}))", s & t if kind == "and" else s | t

    for q, want in [tree(3) for _ in range(15)]:
        assert {r.id for r in docs.where(dsl.compile_node(dsl.parse(q))).select("id").collect()} == want, q


def test_missing_rating_matches_negation(spark):
    docs = lexical.analyzed(table(spark, [("x", "t", "", "document", None, [], None, None)]))
    assert docs.where(dsl.compile_node(dsl.parse("NOT rating:>=4"))).count() == 1


def test_plain_dsl_typos_and_synonyms(index):
    assert sorted(ask(index, "storage OR earbuds", typo_tolerance=False)) == ["a", "c", "d"]
    assert ask(index, "bluetooh") == ["a"] and ask(index, "bluetooh", typo_tolerance=False) == []
    rules = {("chill", "room"): [("ac", "repair")]}
    assert ask(index, "chill room", rules=rules) == ["b"] and ask(index, '"chill room"', rules=rules) == []
    assert ask(index, "storage", filters=(Filter("rating", "gte", 4),)) == ["c"]
    assert ask(index, "kind:service", query_mode="dsl") == ["b"]


def test_bm25_by_hand(spark):
    rows = [("a", "term term", "", "document", None, [], None, None), ("b", "other", "", "document", None, [], None, None)]
    docs = lexical.analyzed(table(spark, rows))
    posted = lexical.postings(docs)
    q = spark.createDataFrame([("q", 0, 0, "term", None, 1.0)], lexical.QUERY_SCHEMA)
    got = lexical.score(q, posted, lexical.field_stats(docs), lexical.document_frequency(posted)).first().score
    assert got == pytest.approx(2 * math.log(2) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / 1.5)))


def test_fusion(spark):
    rows = [("q", "lexical", "a", 1), ("q", "lexical", "b", 2), ("q", "semantic", "b", 1), ("q", "semantic", "c", 2)]
    top = retrieval.fuse(spark.createDataFrame(rows, "query_id string, branch string, id string, rank int"), 10).orderBy("rank").first()
    assert top.id == "b" and top.score == pytest.approx(1 / 62 + 1 / 61) and top.ranks == {"lexical": 2, "semantic": 1}


def test_relevance(spark):
    run = spark.createDataFrame([("q", "bad", 1), ("q", "good", 2), ("q", "good", 3)], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("q", "good", 2), ("empty", "x", 0)], "query_id string, doc_id string, grade int")
    got = {r.query_id: r for r in retrieval.relevance(run, judged).collect()}
    assert (got["q"].mrr_10, got["q"].recall_10, got["q"].success_5) == (0.5, 1.0, 1.0) and got["q"].ndcg_10 == pytest.approx(1 / math.log2(3))
    assert list(got["empty"])[1:] == [0.0] * 5


def test_lifecycle_visibility_and_faults(spark, tmp_path):
    path = str(tmp_path / "i")
    with Index(spark, path, create=True) as i:
        assert i.ingest(table(spark)) == 4 and i.manifest() is None
        i.refresh()
        pinned = i.snapshot()
        with pytest.raises(SearchError, match="writer"):
            Index(spark, path)
        i.delete("a")
        i.ingest(table(spark, [("b", "new title", "", "document", None, [], None, None)]))
        assert i.snapshot().docs.count() == 4
        for at in ("generation", "manifest", "pointer"):
            def fail(place, at=at):
                if place == at:
                    raise RuntimeError(at)
            i.hook = fail
            with pytest.raises(RuntimeError):
                i.refresh()
            assert i.visible_revision() == 4
        i.hook = lambda at: None
        with pytest.raises(SearchError):
            i.refresh(through=99)
        assert i.refresh() == 6 and i.snapshot().docs.count() == 3 and pinned.docs.count() == 4
        assert {r.title for r in i.snapshot().docs.where("id = 'b'").collect()} == {"new title"}
        i.compact()
        assert i.stats()["live_documents"] == 3 and i.visible_revision() == 6
        i.garbage_collect()
        bad = [("ok", "t", "", "document", None, [], None, None), ("x", " ", "", "document", None, [], None, None)]
        for rows in (bad, [bad[0], bad[0]]):
            with pytest.raises(SearchError):
                i.ingest(table(spark, rows))
        assert i.durable_revision() == 6
        i.verify()
        victim = next((tmp_path / "i" / "generations" / i.manifest()["generation"] / "df").rglob("*.parquet"))
        victim.write_bytes(b"x")
        with pytest.raises(SearchError, match="checksum"):
            i.verify()


def test_streaming_refresh(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(x) for x in [{"id": "s", "title": "streamed"}, {"id": "t", "title": "x", "odd": 1}, {"id": "u", "title": "x", "price": "3"}]) + "\n")
    with Index(spark, str(tmp_path / "i"), create=True) as i:
        refresh_stream(i, str(source), str(tmp_path / "c"), interval=None).awaitTermination(120)
        assert [r.title for r in i.snapshot().docs.collect()] == ["streamed"]
        rejected = {r.id: r.violations for r in spark.read.json(str(tmp_path / "i/rejected/*")).collect()}
        assert set(rejected) == {"t", "u"} and rejected["t"] == ["unknown_field"]
        import shutil

        shutil.rmtree(tmp_path / "c")  # the same batch comes again
        refresh_stream(i, str(source), str(tmp_path / "c"), interval=None).awaitTermination(120)
        assert i.durable_revision() == 1


def test_explanations_add_up(index):
    out = SearchEngine(index.snapshot()).search(SearchRequest("storage systems", typo_tolerance=False, explain=True, timeout_ms=5000))
    assert [h["id"] for h in out["hits"]] and set(out["timings_ms"]) == {"plan", "score", "total"}
    for h in out["hits"]:
        why = h["explanation"]
        assert sum(t["contribution"] for t in why["terms"]) == pytest.approx(h["score"]) == why["bm25"] and why["cosine"] is None
    assert {(t["term"], t["field"], t["df"]) for h in out["hits"] for t in h["explanation"]["terms"]} == {("storage", "title", 1), ("storage", "body", 1), ("systems", "title", 1), ("systems", "body", 1)}


def test_pruned_postings_read_only_their_buckets(index):
    snap = index.snapshot()
    hits = lexical.pruned(snap.postings, ["storage", "earbuds"], snap.buckets)
    assert {(r.id, r.term) for r in hits.collect()} == {("c", "storage"), ("d", "storage"), ("a", "earbuds")}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "In(term" in plan


def test_postings_clauses_equal_array_clauses(spark, index):
    snap, arrays = index.snapshot(), lexical.analyzed(table(spark))
    for q in ['"distributed systems" OR (NOT storage AND kind:product)', "title:(database OR storage) AND NOT rating:<3", "NOT absent", "kind:service", 'body:"new systems"', "absent"]:
        node = dsl.parse(q)
        got = dsl.matching(snap.docs, snap.postings, node, snap.buckets)
        assert got.columns == snap.docs.columns
        assert {r.id for r in got.collect()} == {r.id for r in arrays.where(dsl.compile_node(node)).collect()}, q


def test_estimates_bound_the_matches():
    df = {"a": 5, "b": 3}
    for query, most in (("a", 5), ("a AND b", 3), ("a OR b", 8), ("NOT a", 10), ("absent", 0), ("kind:product", 10), ('"a b"', 3), ("title:a", 5)):
        assert dsl.estimate(dsl.parse(query), df, 10) == most, query


def test_deadline_and_names(spark, tmp_path, index):
    from tessera.plans import engine

    with pytest.raises(SearchError, match="name"):
        Index(spark, str(tmp_path / "bad name"), create=True)
    slow = SearchEngine(index.snapshot())
    slow.branches = lambda request: (_ for _ in ()).throw(RuntimeError("cancelled")) if engine.time.sleep(0.2) is None else None
    with pytest.raises(SearchError) as e:
        slow.search(SearchRequest("x", timeout_ms=10))
    assert e.value.code == "DEADLINE_EXCEEDED"


def test_command_line_refuses_a_whole_batch(spark, tmp_path, monkeypatch):
    from tessera import cli

    monkeypatch.setattr(cli, "BATCH", 2)
    f = tmp_path / "d.jsonl"
    f.write_text("\n".join(json.dumps(x) for x in [{"id": "a", "title": "t"}, {"id": "b", "title": "t"}, {"id": "c", "title": "t"}, {"id": "d", "title": " "}]))
    with Index(spark, str(tmp_path / "i"), create=True) as i:
        with pytest.raises(SearchError) as e:
            cli.ingest(i, str(f))
        assert e.value.code == "INVALID_DOCUMENT" and e.value.details["id"] == "d" and i.durable_revision() == 2


def test_offsets(spark):
    from tessera.functions.analyzer import analyze, token_offsets

    text = "Straße Ａb_c 9"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(token_offsets("t").alias("o")).collect()
    assert [tuple(x) for x in got[0].o] == analyze(text) == [("strasse", 0, 0, 7), ("ab", 1, 8, 10), ("c", 2, 11, 12), ("9", 3, 13, 14)] and got[1].o == []


def test_vectors_filter_before_top_k(spark, tmp_path):
    docs = table(spark).withColumn("vector", __import__("pyspark").sql.functions.expr("case when title like '%ear%' then array(1f, 0f) else array(0f, 1f) end"))
    with Index(spark, str(tmp_path / "i"), create=True, dimension=2, fingerprint="f") as i:
        i.ingest(docs, vectors=True)
        i.refresh()
        assert ask(i, "anything", mode="semantic", vector=(1.0, 0.0), top_k=1) == ["a"]
        assert ask(i, "anything", mode="semantic", vector=(1.0, 0.0), top_k=1, filters=(Filter("kind", "eq", "service"),)) == ["b"]
        with pytest.raises(SearchError):
            ask(i, "anything", mode="semantic")
        assert ask(i, "music", mode="hybrid", allow_lexical_fallback=True) == ["a"]


def test_strict_sources(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text("\n".join(json.dumps(x) for x in [{"id": "a", "title": "t"}, {"id": "b", "title": "t", "extra": 1}, {"id": "c", "title": "t", "price": "3"}, {"id": "d", "title": "t", "rating": 9}]) + "\n\nnot json\n")
    got = {r.id: r.violations for r in read_jsonl(spark, str(f)).collect()}
    assert got["a"] == [] and got["b"] == ["unknown_field"] and "price_type" in got["c"] and got["d"] == ["rating"] and "not_json" in got[None]
    q = tmp_path / "q.tsv"
    q.write_text("query-id corpus-id score\n1 a 2\n1 0 b 0\n")
    assert sorted((r.query_id, r.doc_id, r.grade) for r in read_qrels(spark, str(q)).collect()) == [("1", "a", 2), ("1", "b", 0)]
    for bad in ("1 a 2\nquery corpus score\n", "q d g\n1 a\n", "1 a 2\n1 a 3\n"):
        q.write_text(bad)
        with pytest.raises(SearchError):
            read_qrels(spark, str(q))
    s = tmp_path / "s.json"
    s.write_text(json.dumps({"version": 1, "rules": [{"from": "chill room", "to": ["AC repair"], "direction": "equivalent"}]}))
    assert load_synonyms(str(s)) == {("chill", "room"): [("ac", "repair")], ("ac", "repair"): [("chill", "room")]}


def test_shard_routing_matches_formula(spark):
    import hashlib

    from pyspark.sql import functions as F

    ids = ["a", "doc-1", "größe", "x" * 100]
    got = [r.s for r in spark.createDataFrame([(i,) for i in ids], "id string").select(retrieval.shard_of(F.col("id"), 7).alias("s")).collect()]
    assert got == [int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "big") % 7 for i in ids]


def test_requests_and_filters_are_checked():
    for bad in [lambda: SearchRequest(" "), lambda: SearchRequest("x", top_k=0), lambda: SearchRequest("x", top_k=50, candidate_k=10), lambda: Filter("rating", "in", [1]), lambda: Filter("kind", "gt", "x"), lambda: Filter("nope", "eq", "x"), lambda: Filter("price", "eq", True)]:
        with pytest.raises(SearchError):
            bad()


def test_catalogue_has_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(list(itertools.islice(entry.queries(), 30))) == 30
