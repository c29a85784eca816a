import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.errors import SearchError
from tessera.functions.embedding import CachedQueries, TermSketch, encode
from tessera.operators import lexical
from tessera.plans.cluster import Cluster, export
from tessera.plans.engine import SearchEngine, SearchRequest
from tessera.settings import index_path, load_settings
from tessera.sources.documents import DOC_SCHEMA
from tessera.sources.store import Index
from tessera.telemetry import Telemetry

WORDS = ["harbour", "lantern", "copper", "meadow", "violin", "glacier", "saffron"]
ROWS = [(f"d{i}", f"{WORDS[i % 7]} report", " ".join(WORDS[(i * k) % 7] for k in range(1, 2 + i % 5)), "document", "x", [], None, float(i % 5)) for i in range(40)]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    provider = TermSketch(16)
    with Index(spark, str(tmp_path_factory.mktemp("c") / "i"), create=True, dimension=16, fingerprint=provider.fingerprint) as i:
        i.ingest(documents(spark), provider=provider)
        i.refresh()
        yield i


@pytest.fixture(scope="module")
def exported(index, tmp_path_factory):
    target = tmp_path_factory.mktemp("e") / "cluster"
    export(index.snapshot(), str(target), shards=3, replicas=1)
    return target


def ask(q="copper violin", **more):
    return SearchRequest(q, timeout_ms=5000, **more)


def pairs(out):
    return [(h["id"], round(h["score"], 9)) for h in out["hits"]]


@pytest.mark.parametrize("request_", [ask(mode="lexical"), ask(mode="semantic"), ask(), ask("copper AND NOT title:violin", query_mode="dsl", mode="lexical")])
def test_shards_answer_like_the_whole(spark, index, exported, request_):
    provider = CachedQueries(TermSketch(16))
    out = Cluster(spark, str(exported), provider).search(request_)
    assert pairs(out) == pairs(SearchEngine(index.snapshot(), provider).search(request_)) and out["hits"]
    assert not out["partial"] and out["coverage"] == {"successful": 3, "total": 3}


def test_lost_replicas_and_shards(spark, exported, tmp_path):
    root = tmp_path / "cluster"
    shutil.copytree(exported, root)
    cluster, request = Cluster(spark, str(root)), ask("report", mode="lexical", top_k=50)
    assert cluster.ready()
    everything = pairs(cluster.search(request))
    (root / "replica-0" / "shard-1.json").unlink()
    assert cluster.ready() and [s.replica for s in cluster.states()] == [0, 1, 0]
    assert pairs(cluster.search(request)) == everything
    wrong = root / "replica-1" / "shard-1.json"
    wrong.write_text(json.dumps(json.loads(wrong.read_text()) | {"epoch": "another"}))
    assert not cluster.ready() and cluster.states()[1].status == "EPOCH_MISMATCH"
    with pytest.raises(SearchError) as e:
        cluster.search(request)
    assert (e.value.code, e.value.status) == ("INCOMPLETE_COVERAGE", 503)
    part = cluster.search(request, allow_partial=True)
    assert part["partial"] and part["coverage"] == {"successful": 2, "total": 3} and "partial_results" in part["warnings"]
    from hashlib import sha256

    kept = [p for p in everything if int.from_bytes(sha256(p[0].encode()).digest()[:8], "big") % 3 != 1]
    assert pairs(part) == kept and len(kept) < len(everything)
    for k in range(3):
        for r in range(2):
            (root / f"replica-{r}" / f"shard-{k}.json").unlink(missing_ok=True)
    with pytest.raises(SearchError):
        cluster.search(request, allow_partial=True)


def test_export_checks(spark, index, exported, tmp_path):
    for bad in ({"shards": 0}, {"shards": 33}, {"replicas": 4}):
        with pytest.raises(SearchError) as e:
            export(index.snapshot(), str(tmp_path / "x"), **bad)
        assert e.value.code == "INVALID_TOPOLOGY"
    with pytest.raises(SearchError) as e:
        export(index.snapshot(), str(exported))
    assert e.value.code == "EXPORT_EXISTS"
    with pytest.raises(SearchError) as e:
        Cluster(spark, str(tmp_path))
    assert e.value.status == 404


def test_encoding(spark, index):
    provider = TermSketch(16, max_terms=3)
    rows = {r.id: r for r in encode(documents(spark, [*ROWS[:6], ("e", None, None, "document", "x", [], None, None)]), provider).collect()}
    assert np.allclose(rows["d4"].vector, provider.encode_query(f"{ROWS[4][1]}\n{ROWS[4][2]}"), atol=1e-6)
    assert rows["d4"].truncated and not rows["d0"].truncated and rows["e"].vector[0] == 1.0
    with pytest.raises(SearchError) as e:
        index.ingest(documents(spark, [("new", "t", "", "document", "x", [], None, None)]), provider=provider)
    assert e.value.code == "MODEL_MISMATCH"


def test_query_cache():
    class Counting(TermSketch):
        asked = 0

        def encode_query(self, text):
            self.asked += 1
            return super().encode_query(text)

    inner = Counting(8)
    cache = CachedQueries(inner, size=2)
    cache.encode_query("a")[0] = 9.0
    assert cache.encode_query("a")[0] != 9.0 and inner.asked == 1
    for q in ("b", "a", "c", "a"):
        cache.encode_query(q)
    assert inner.asked == 3
    cache.encode_query("b")
    assert inner.asked == 4


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"port": 9000, "index_name": "books"}')
    assert load_settings(str(f)).port == 9000 and index_path(load_settings(str(f))).endswith("data/books") and load_settings().workers == 4
    for bad in ('{"port": 0}', '{"port": true}', '{"nope": 1}', "[1]", "{", '{"role": "king"}', '{"data": null}'):
        f.write_text(bad)
        with pytest.raises(SearchError) as e:
            load_settings(str(f))
        assert e.value.code == "INVALID_SETTINGS"
    with pytest.raises(SearchError):
        index_path(load_settings(), "../up")


def test_telemetry(index, caplog):
    t = Telemetry()
    engine = SearchEngine(index.snapshot(), telemetry=t)
    with caplog.at_level("INFO", logger="tessera"):
        engine.search(ask(mode="lexical"))
        with pytest.raises(SearchError):
            engine.search(ask(mode="semantic"))
        t.request("lexical", "ok", 0.5, "secret words")
    t.index(index.stats())
    text = t.text()
    assert 'tessera_requests_total{mode="lexical",outcome="ok"} 2' in text and 'tessera_requests_total{mode="semantic",outcome="error"} 1' in text
    assert 'tessera_stage_seconds_count{stage="score"} 1' in text and "tessera_live_documents 40" in text and "tessera_pending_revisions 0" in text
    assert 'tessera_request_seconds_bucket{mode="lexical",le="+Inf"} 2' in text
    assert "query_sha256" in caplog.text and "secret" not in caplog.text


def test_damage_is_seen(spark, tmp_path):
    with Index(spark, str(tmp_path / "i"), create=True) as i:
        i.ingest(documents(spark))
        i.refresh()
        i.verify()
        name = next(n for n in i.manifest()["files"] if n.startswith("postings"))
        file = i.root / name
        body = bytearray(file.read_bytes())
        body[-1] ^= 1
        file.write_bytes(bytes(body))
        with pytest.raises(SearchError) as e:
            i.verify()
        assert e.value.code == "INDEX_CORRUPT" and e.value.details["file"] == name
        file.write_bytes(bytes(body[:-4]))
        with pytest.raises(SearchError):
            i.snapshot()


def test_command_line(spark, tmp_path, capsys):
    def run(path, *words):
        cli.main([str(path), *words])
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    path, lines = tmp_path / "books", tmp_path / "d.jsonl"
    lines.write_text("\n".join(json.dumps({"id": r[0], "title": r[1], "body": r[2], "category": "x"}) for r in ROWS))
    run(path, "create", "--dimension", "16")
    assert run(path, "ingest", str(lines)) == 40 and run(path, "refresh") == 40
    stats = run(path, "stats")
    assert stats["live_documents"] == 40 and set(stats["table_bytes"]) == {"docs", "postings", "df", "stats"}
    assert run(path, "search", "copper", "--explain")["mode"] == "hybrid"
    (tmp_path / "q.jsonl").write_text('{"id": "1", "text": "copper"}\n')
    (tmp_path / "q.tsv").write_text("1 d2 2\n")
    assert "hybrid" in run(path, "lab", str(lines), str(tmp_path / "q.jsonl"), str(tmp_path / "q.tsv"), str(tmp_path / "out"))
    run(path, "export", str(tmp_path / "cluster"), "--shards", "2", "--replicas", "0")
    assert run(tmp_path / "cluster", "cluster-status")["ready"]
    assert len(run(tmp_path / "cluster", "cluster-search", "copper", "--mode", "lexical")["hits"]) > 0
    with pytest.raises(SystemExit):
        cli.main([str(path), "search", "AND", "--dsl"])
    assert "error" in capsys.readouterr().err


def test_revisions_are_consecutive(spark, tmp_path):
    with Index(spark, str(tmp_path / "i"), create=True) as i:
        assert i.ingest(documents(spark, ROWS[:7])) == 7 and i.delete("d1") == 8
        assert sorted(r.revision for r in i.journal().select("revision").collect()) == list(range(1, 9))
        assert i.journal().where(F.col("document").isNull()).first().revision == 8


def test_segments_equal_a_rewrite(spark, tmp_path):
    """After every refresh the segments' tables are those of an index made of the live documents at once."""
    import random

    rng, live = random.Random(5), {}

    def made(i):
        return (f"d{i}", f"{rng.choice(WORDS)} {rng.choice(WORDS)}", " ".join(rng.choices(WORDS, k=rng.randrange(6))), "document", "x", [], None, float(rng.randrange(5)))

    def rows(t, *columns):
        return sorted(map(tuple, t.select(*columns).collect()), key=repr)

    with Index(spark, str(tmp_path / "i"), create=True) as i:
        for step in range(12):
            batch = {r[0]: r for r in ([made(k) for k in range(100)] if step == 0 else [made(100 + 3 * step + k) for k in range(3)] + [made(rng.randrange(100))])}
            i.ingest(documents(spark, list(batch.values())))
            live.update(batch)
            if step % 3 == 2:
                victim = rng.choice(sorted(live))
                i.delete(victim)
                del live[victim]
            i.refresh()
            if step in (0, 1, 5, 8, 9, 11):
                snap = i.snapshot()
                assert rows(snap.docs, *DOC_SCHEMA.names) == sorted(live.values(), key=repr) and snap.manifest["live"] == len(live)
                whole = lexical.index_postings(documents(spark, list(live.values())))
                assert rows(snap.postings, "id", "field", "term", "tf", "len", "positions") == rows(whole, "id", "field", "term", "tf", "len", "positions")
                assert rows(snap.stats, "field", "n", "total_length") == rows(lexical.stats_of(whole), "field", "n", "total_length")
                assert rows(snap.df, "field", "term", "df") == rows(lexical.document_frequency(whole), "field", "term", "df")
        held = i.manifest()["segments"]
        assert 1 < len(held) <= 8 and held[0]["documents"] == 100 and len(held) < 12  # the base stays, small ones were merged
        i.verify()
        i.garbage_collect()
        i.verify()
        assert i.snapshot().docs.count() == len(live)
        for k in sorted(live):
            if rng.random() < 0.5:
                i.delete(k)
                del live[k]
        i.refresh()
        assert len(i.manifest()["segments"]) == 1 and not i.manifest()["gone"] and i.snapshot().docs.count() == len(live)
        for k in sorted(live)[:3]:
            i.delete(k)
        i.compact()
        i.refresh()
        assert i.manifest()["live"] == len(live) - 3


def test_everything_deleted(spark, tmp_path):
    with Index(spark, str(tmp_path / "i"), create=True) as i:
        i.ingest(documents(spark, ROWS[:2]))
        i.refresh()
        for k in ("d0", "d1", "never"):
            i.delete(k)
        i.refresh()
        assert i.snapshot().docs.count() == 0 and i.stats()["live_documents"] == 0
        assert SearchEngine(i.snapshot()).search(ask("copper"))["hits"] == []
        i.ingest(documents(spark, ROWS[:1]))
        i.refresh()
        assert [r.id for r in i.snapshot().docs.collect()] == ["d0"]
