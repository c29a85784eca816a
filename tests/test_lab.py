import json

from tessera.evaluation import lab
from tessera.plans.engine import SearchEngine
from tessera.sources.documents import DOC_SCHEMA
from tessera.sources.store import Index


def test_ablations_and_report(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Bluetooth <b>earbuds</b>", "music", "product", None, [], None, None), ("b", "AC repair", "cooling", "service", None, [], None, None)], DOC_SCHEMA)
    queries = [{"id": "q1", "text": "bluetooh", "subset": "typo"}, {"id": "q2", "text": "repair", "split": "dev"}]
    qrels = spark.createDataFrame([("q1", "a", 2), ("q2", "b", 1)], "query_id string, doc_id string, grade int")
    with Index(spark, str(tmp_path / "i"), create=True) as index:
        index.ingest(docs)
        index.refresh()
        found = lab.judged(lab.runs(SearchEngine(index.snapshot()), queries), qrels).persist()
        summary = lab.write_report(found, str(tmp_path / "out"))
    assert set(summary) == set(lab.settings(False))
    assert summary["exact_lexical"]["typo"]["ndcg_10"] == 0 and summary["fuzzy"]["typo"]["ndcg_10"] == 1
    assert summary["fuzzy"]["all"]["queries"] == 2 and summary["fuzzy"]["held_out"]["queries"] == 1
    text = (tmp_path / "out/report.html").read_text()
    assert "&lt;b&gt;earbuds" in text and "<b>" not in text
    assert set(json.loads((tmp_path / "out/report.json").read_text())["runs"]) == set(summary)


def test_inputs_belong_together(spark, tmp_path):
    import pytest

    from tessera.errors import SearchError

    docs = spark.createDataFrame([("a", "t", "", "document", None, [], None, None), ("b", "t", "", "document", None, [], None, None)], DOC_SCHEMA)
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "text": "t"}\n\n')
    queries = lab.load_queries(str(tmp_path / "q.jsonl"))
    qrels = lambda *rows: spark.createDataFrame(rows, "query_id string, doc_id string, grade int")
    with Index(spark, str(tmp_path / "i"), create=True) as index:
        index.ingest(docs)
        index.refresh()
        engine = SearchEngine(index.snapshot())
        lab.check_inputs(queries, qrels(("q1", "a", 1)), docs, engine)
        for code, given, corpus in (("UNKNOWN_QUERY", qrels(("q2", "a", 1)), docs), ("UNKNOWN_DOCUMENT", qrels(("q1", "z", 1)), docs), ("CORPUS_MISMATCH", qrels(("q1", "a", 1)), docs.where("id = 'a'"))):
            with pytest.raises(SearchError) as e:
                lab.check_inputs(queries, given, corpus, engine)
            assert e.value.code == code
    assert lab.spread([3.0, 1.0, 2.0]) == {"min": 1.0, "median": 2.0, "max": 3.0}
    assert len(lab.input_checksums(str(tmp_path / "q.jsonl"))["q.jsonl"]) == 64


def test_prepared_collection(spark, tmp_path):
    import hashlib
    import json
    import zipfile

    import pytest

    from tessera.errors import SearchError
    from tessera.evaluation.corpora import judged_grid, prepare_judged, synthetic_documents, unpack
    from tessera.evaluation.lab import load_queries
    from tessera.sources.documents import read_jsonl, violations

    archive = tmp_path / "c.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("s/corpus.jsonl", "\n".join(json.dumps(x) for x in [{"_id": "1", "title": "", "text": "x"}, {"_id": "2", "title": "T", "text": "y", "metadata": {}}]))
        z.writestr("s/queries.jsonl", "\n".join(json.dumps({"_id": i, "text": f"text {i}"}) for i in ("a", "b", "c")))
        z.writestr("s/qrels/test.tsv", "query-id\tcorpus-id\tscore\na\t1\t1\nc\t2\t1\n")
    with pytest.raises(SearchError):
        unpack(str(archive), str(tmp_path / "u"), "0" * 32)
    unpack(str(archive), str(tmp_path / "u"), hashlib.md5(archive.read_bytes()).hexdigest())
    assert prepare_judged(spark, str(tmp_path / "u" / "s"), str(tmp_path / "o"), "small") == {"documents": 2, "queries": 2}
    assert [q["id"] for q in load_queries(str(tmp_path / "o" / "queries.jsonl"))] == ["a", "c"]
    assert {(r.id, r.title, len(r.violations)) for r in read_jsonl(spark, str(tmp_path / "o" / "documents")).collect()} == {("1", "1", 0), ("2", "T", 0)}
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(SearchError, match="leaves"):
        unpack(str(archive), str(tmp_path / "v"), hashlib.md5(archive.read_bytes()).hexdigest())
    made = synthetic_documents(spark, 50)
    assert made.count() == 50 and made.select(violations().alias("v")).where("size(v) > 0").isEmpty()
    assert sorted(map(str, made.collect())) == sorted(map(str, synthetic_documents(spark, 50).repartition(7).collect()))
    documents, asked, grades = judged_grid(spark, [("a", "b", "c")] * 4)
    assert (documents.count(), asked.count(), grades.where("grade > 0").count()) == (24, 4, 12) and documents.select(violations().alias("v")).where("size(v) > 0").isEmpty()
