"""Operators without SQL, the pipeline and the url graph against plain versions; clashing columns and empty tables."""

import collections
import math
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, decontaminate, license_scan, line_dedup, ngram_join, packing, queries, substring_dedup, suffix_dedup, toxicity, url_filter

from test_llm import A_TO_Z, plain_components, table

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = ["touched", "evidence", "_body", "lines_removed", "chunks_removed", "_key", "_id", "_gone", "kept", "hits", "items", "which", "sums", "_ld_key", "_ld_gone", "print", "sid", "gone", "label", "removed", "par"]


def grams(word, order=5):
    padded = b" " * (order - 1) + word.encode() + b" "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def plain_ratios(texts, labels):
    """log P(toxic) - log P(ordinary) of every 5-gram, from the definition."""
    counts, types = {1: collections.Counter(), 0: collections.Counter()}, set()
    for i, text in texts.items():
        for word in ALNUM.findall((text or "").translate(A_TO_Z)):
            types.update(grams(word))
            if i in labels:
                counts[labels[i]].update(grams(word))
    d, shared, above = toxicity.DISCOUNT, {}, types
    levels = []
    for k in (4, 3, 2, 1):
        fans = collections.Counter(g[-k:] for g in above)
        levels.append(fans)
        above = set(fans)
    for fans in reversed(levels):
        total, kinds = collections.Counter(), collections.Counter()
        for g, n in fans.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        if len(next(iter(fans))) == 1:
            shared = {g: n / total[b""] for g, n in fans.items()}
        else:
            shared |= {g: max(n - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * shared[g[1:]] for g, n in fans.items()}
    totals = {c: collections.Counter() for c in (0, 1)}
    kinds = {c: collections.Counter() for c in (0, 1)}
    for c in (0, 1):
        for g, n in counts[c].items():
            totals[c][g[:-1]] += n
            kinds[c][g[:-1]] += 1

    def p(g, c):
        total = totals[c][g[:-1]]
        return (max(counts[c][g] - d, 0) + d * kinds[c][g[:-1]] * shared[g[1:]]) / total if total else shared[g[1:]]

    return {g: math.log(p(g, 1) / p(g, 0)) for g in types}


def plain_evidence(text, ratios):
    words = [sum(ratios.get(g, 0.0) for g in grams(w)) for w in ALNUM.findall((text or "").translate(A_TO_Z))]
    size = len(words) + toxicity.PRIOR_WORDS
    return [sum(words) / size, *(sum(max(w - m, 0) for w in words) / size for m in toxicity.MARGINS)]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def labelled(rng, n=150):
    vocabulary = ["".join(rng.choice("aeiourstäß") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    texts, labels = {}, {}
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(4, 40))]
        if i % 4 == 0:
            own[rng.randrange(len(own))] = "Zmq" + rng.choice(vocabulary)
            own[rng.randrange(len(own))] = "zMq" + rng.choice(vocabulary)
        texts[i] = " ".join(own)
        labels[i] = int(i % 4 == 0)
    return texts, labels


def test_toxicity_equals_plain_kneser_ney_at_every_part_size(spark):
    texts, labels = labelled(random.Random(31))
    texts |= {900: "", 901: None, 902: "-- ,,"}
    docs = table(spark, list(texts.values()), list(texts))
    lab = spark.createDataFrame([(i, x) for i, x in labels.items()], "doc_id long, toxic int")
    ratios = plain_ratios(texts, {i: x for i, x in labels.items() if not held(i)})
    found = []
    for part in (None, 200):
        model = toxicity.fit_toxicity(docs, lab, part=part)
        found.append({r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()})
        assert (len(model.parts) > 1) == (part is not None)
    for i, text in texts.items():
        assert found[0][i].mean_ratio == pytest.approx(plain_evidence(text, ratios)[0], abs=2e-6), i
        assert found[1][i].score == pytest.approx(found[0][i].score, abs=1e-6) and found[0][i].held_out == held(i)
    unseen = [i for i in labels if held(i)]
    assert sum(found[0][i].predicted == labels[i] for i in unseen) >= 0.9 * len(unseen)


def rule_sample(rng, regex):
    from re import _parser

    def sample(parts):
        out = ""
        for op, value in parts:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "IN":
                out += rng.choice(" \n_*-") if str(value[0][0]) == "NEGATE" else "1" if str(value[0][0]) == "CATEGORY" else chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])
            elif kind == "MAX_REPEAT":
                out += "".join(sample(value[2]) for _ in range(rng.randint(value[0], min(value[1], value[0] + 1))))
            elif kind == "SUBPATTERN":
                out += sample(value[3])
            elif kind == "BRANCH":
                out += sample(rng.choice(value[1]))
            elif kind == "ANY":
                out += "x"
        return out

    return sample(_parser.parse(regex))


def plain_scan(text, rules):
    text = text or ""
    words = ALNUM.findall(text.translate(A_TO_Z))
    places, base = [], set()
    for phrase, label in ("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"):
        want = phrase.split(" ")
        at = [i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]
        places += at
        base |= {label} if at else set()
    spans = []
    for number, label, priority, keyword, regex in rules:
        if any(k in text.lower() for k in keyword.split("|")):
            spans += [(m.start(), m.end(), priority, number, label) for m in regex.finditer(text)]
    spans.sort(key=lambda s: (s[0], -s[1], -s[2], s[3]))
    left = [s for i, s in enumerate(spans) if not any(e[1] >= s[1] and e[2] >= s[2] for e in spans[:i])]
    score = max([0.9 if base else 0.0, *(license_scan.CONFIDENCE[s[2]] for s in left)])
    join = lambda x: ",".join(sorted(x))
    return len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(base | {s[4] for s in left}), score


def test_license_scan_equals_plain_scanner(spark):
    rng = random.Random(41)
    python = lambda p: re.compile(p.replace(r"\x{80}", r"\x80").replace(r"\x{10FFFF}", r"\U0010FFFF"))
    rules = [(n, a, p, k, python(x)) for n, a, p, k, x in license_scan.signature_rules()]
    words = ["der", "Licensed", "under", "under the MIT license", "the", "MIT", "license", "cc", "BY", "nc", "apache", "License,", "Version", "2.0", "é", "all", "rights", "copyright"]
    texts = [None, "", " ".join(["under the mit license"] * 50), "cc by nc cc-by-nc 4.0 (cc by-nc-sa)"]
    for _ in range(70):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rule_sample(rng, rng.choice(rules)[4].pattern))
        texts.append(rng.choice([" ", " ", "\n"]).join(parts))
    docs = table(spark, [*texts, texts[3]], [*range(len(texts)), 3]).withColumn("_may", F.lit(1))
    got = collections.defaultdict(list)
    for r in license_scan.scan_licenses(docs).collect():
        got[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score))
    for i, text in enumerate(texts):
        assert got[i] == [plain_scan(text, rules)] * (2 if i == 3 else 1), (i, text)
    assert sum(bool(x[0][5]) for x in got.values()) > 40


def plain_pack(pieces, capacities):
    """``pieces`` of ``(n_words, doc_id, piece)``, longest first: bin, offset and final capacity of each."""
    bins, out = [], []
    rest = sum(n for n, _, _ in pieces)
    cost = lambda c: (packing.OVERHEAD + c + c * c / packing.QUADRATIC) / min(c, rest)
    for n, _, _ in pieces:
        fits = [k for k, (size, fill) in enumerate(bins) if size - fill >= n]
        if fits:
            k = min(fits, key=lambda k: (bins[k][0] - bins[k][1], -k))
        else:
            k = len(bins)
            bins.append([min((c for c in sorted(capacities) if c >= n), key=cost), 0])
        out.append((k, bins[k][1]))
        bins[k][1] += n
        rest -= n
    return [(k, at, min(c for c in capacities if c >= bins[k][1])) for k, at in out]


def packed_plainly(texts, capacities):
    most, pieces, rows = max(capacities), [], []
    for i, text in texts:
        count = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        pieces += [(min(most, count - at), i, k) for k, at in enumerate(range(0, count, most))]
        if not count:
            rows.append((i, 0, 0, 0, None, None, None))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    places = plain_pack(pieces, capacities)
    return rows + [(i, k, k * most, n, f"0-{b}", at, size) for (n, i, k), (b, at, size) in zip(pieces, places)]


def test_packing_equals_plain_best_fit_of_several_sizes(spark):
    rng = random.Random(51)
    texts = [(i, None if i == 7 else " ".join("w" for _ in range(rng.choice([0, 1, 3, 60, 64, 200, 300, 500, 512, 700, 1500, 5000, rng.randint(1, 1100)])))) for i in range(120)]
    texts += [(500, "same words"), (501, "same words"), (502, "same words")]
    for capacities in ((512, 1024, 4096), (64,), (100, 1000)):
        got = packing.best_fit_packing(table(spark, [t for _, t in texts], [i for i, _ in texts]), capacities).collect()
        key = lambda r: (r[0], r[1])
        assert sorted(map(tuple, got), key=key) == sorted(packed_plainly(texts, capacities), key=key), capacities
    twice = packing.best_fit_packing(table(spark, ["a b"] * 3, [1, 1, 1])).collect()
    assert sorted(r.offset for r in twice) == [0, 2, 4] and len({r.bin_id for r in twice}) == 1


def plain_runs(texts):
    seen, out = set(), []
    for i, t in texts:
        own, lost = (t or "").split("\n"), set()
        for k, window in enumerate(zip(own, own[1:])):
            lost |= {k, k + 1} if window in seen else set()
            seen.add(window)
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(own) if k not in lost)))
    return out


def plain_cut(text, items, window=8):
    spans = [m.span() for m in ALNUM.finditer((text or "").translate(A_TO_Z))]
    words, marked = [text.translate(A_TO_Z)[a:b] for a, b in spans] if text else [], set()
    for item in items:
        own = ALNUM.findall((item or "").translate(A_TO_Z))
        size = min(window, len(own))
        known = {tuple(own[q : q + size]) for q in range(len(own) - size + 1)} if size else set()
        for p in range(len(words) - size + 1):
            if size and tuple(words[p : p + size]) in known:
                marked.update(range(p, p + size))
    if not marked:
        return text
    out, at = "", 0
    for k in sorted(marked):
        if k - 1 not in marked:
            out += text[at : spans[k][0]]
        at = spans[k][1]
    return out + text[at:] if ALNUM.search((out + text[at:]).translate(A_TO_Z)) else False


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(61)
    texts, labels = labelled(rng, 120)
    line = lambda n: " ".join(rng.choice("uvwxyz") * 2 + rng.choice("abc") * rng.randint(1, 3) for _ in range(n))
    shared, items = [line(9), line(12), line(7)], [line(14), "tiny item", line(8)]
    for i in range(0, 120, 5):
        texts[i] += "\n" + "\n".join(shared[i % 2 :]) + "\n" + line(40)
    for i in range(0, 60, 7):
        texts[200 + i] = texts[i] + " tail"
        texts[300 + i] = texts[i].replace("\n", f"\n{items[i % 3]}\n", 1) + f", {items[(i + 1) % 3]} end"
    texts |= {900: "", 901: None, 902: items[1], 903: items[0]}
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, columns in (("documents", dict(zip(names, map(list, zip(*rows))))), ("labels", {"doc_id": list(labels), "toxic": list(labels.values())}), ("benchmark", {"item_id": [1, 2, 3], "text": items})):
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit_toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    ratios = plain_ratios(texts, {i: x for i, x in labels.items() if not held(i)})
    score = lambda t: 1 / (1 + math.exp(-(sum(s * e for s, e in zip(model.slopes, plain_evidence(t, ratios))) + model.offset)))
    left = plain_runs([(i, t) for i, t in sorted(texts.items()) if score(t) < 0.7])
    roots, _ = plain_components([t for _, t in left])
    left = [(i, t) for k, (i, t) in enumerate(left) if roots[k] == k]
    left = [(i, cut) for i, t in left if (cut := plain_cut(t, items)) is not False]
    want = packed_plainly(left, packing.CAPACITIES)
    key = lambda r: (r[0], r[1])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert 60 < len(left) < len(texts) - 20 and corpus_pipeline.ORACLE_SQL is None


def clashing(spark, texts):
    out = table(spark, texts)
    for c in CLASHES:
        out = out.withColumn(c, F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")))
    return out


def test_clashing_columns_stay_as_they_are(spark, tmp_path):
    import corpus_pipeline

    texts = ["a b c d e f g\nsecond line here\nthird", "a b c d e f g\nsecond line here\nfourth", "a b c d e f g\nsecond line here\nfourth", "mit license x y z", None, ""]
    docs = clashing(spark, texts)
    bench = spark.createDataFrame([(1, "b c d e f g second line"), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit_toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    stages = {
        "toxicity": toxicity.reject_toxic(docs, model, threshold=1.1), "runs": line_dedup.remove_repeated_runs(docs), "near": corpus_pipeline.near_duplicates(spark, docs, ""),
        "spans": corpus_pipeline.decontamination(spark, docs, str(tmp_path)), "paragraphs": substring_dedup.remove_repeated_paragraphs(docs),
    }
    for name, out in stages.items():
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in CLASHES), name
    ids = lambda name: sorted(r.doc_id for r in stages[name].collect())
    assert ids("toxicity") == ids("runs") == ids("spans") == ids("paragraphs") == list(range(6)) and ids("near") == [0, 3, 4, 5]
    runs = {r.doc_id: r.text for r in stages["runs"].collect()}
    assert runs == {0: texts[0], 1: "fourth", 2: "", 3: texts[3], 4: None, 5: ""}
    spans = {r.doc_id: r.text for r in stages["spans"].collect()}
    assert spans[0] == "a  here\nthird" and spans[3] == texts[3] and spans[4] is None and spans[5] == ""
    counted = line_dedup.dedup_runs(docs)
    assert counted.columns.count("lines_removed") == 1 and {r.doc_id: r.lines_removed for r in counted.collect()} == {0: 0, 1: 2, 2: 3, 3: 0, 4: 0, 5: 0}
    assert line_dedup.dedup_lines(docs).columns.count("chunks_removed") == 1
    for out in (ngram_join.ngram_jaccard_join(docs), suffix_dedup.repeated_passages(docs), substring_dedup.paragraph_report(docs), decontaminate.decontamination_report(docs, bench), license_scan.scan_licenses(docs), packing.best_fit_packing(docs), toxicity.score_toxicity(docs, model)):
        assert sorted({r.doc_id for r in out.collect()}) == list(range(6))


def test_values_of_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    docs = table(spark, [None, "", " \n ", "x", long_text, long_text, "null id", "twice", "twice"], [0, 1, 2, 3, 4, 5, None, 7, 7])
    key = lambda r: (r.doc_id is None, r.doc_id)
    rows = lambda df, *c: [tuple(r[x] for x in c) for r in sorted(df.collect(), key=key)]
    assert rows(ngram_join.ngram_jaccard_join(docs), "n_shingles", "component_id") == [(0, 0), (0, 1), (0, 2), (1, 3), (59_996, 4), (59_996, 4), (1, 7), (1, 7), (1, None)]
    assert rows(suffix_dedup.repeated_passages(docs), "n_words", "n_removed") == [(0, 0), (0, 0), (0, 0), (1, 0), (60_000, 0), (60_000, 60_000), (1, 0), (1, 0), (2, 0)]
    report = rows(substring_dedup.paragraph_report(docs), "doc_id", "n_removed", "words_removed", "n_passages")
    assert report[4][1:] == (0, 0, 0) and report[5][2:] == (60_000, 1) and report[5][1] > 50 and all(r[1:] == (0, 0, 0) for r in report[:4] + report[6:])
    assert rows(packing.best_fit_packing(docs.where("doc_id < 4")), "n_words", "bin_id") == [(0, None), (0, None), (0, None), (1, "0-0")]
    bench = spark.createDataFrame([(1, "x"), (1, "x"), (2, ""), (None, "twice")], "item_id long, text string")
    hits = decontaminate.decontamination_report(docs, bench)
    assert rows(hits, "n_words", "n_hit", "n_items", "contaminated") == [(0, 0, 0, False)] * 3 + [(1, 1, 1, False)] + [(60_000, 0, 0, False)] * 2 + [(1, 0, 0, False)] * 2 + [(2, 0, 0, False)]
    two = spark.createDataFrame([(1, "x"), (2, "X")], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontamination_report(docs.where("doc_id = 3"), two).collect()] == [True]
    lines = line_dedup.dedup_lines(docs)
    assert rows(lines, "text") == [(None,), ("",), (" \n ",), ("x",), (long_text,), (long_text,), ("twice",), ("twice",), ("null id",)]


def test_empty_tables(spark):
    import corpus_pipeline

    docs = table(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for out in (toxicity.reject_toxic(docs, model), line_dedup.remove_repeated_runs(docs), corpus_pipeline.near_duplicates(spark, docs, ""), decontaminate.remove_benchmark_spans(docs, bench), substring_dedup.remove_repeated_paragraphs(docs)):
        assert out.columns == docs.columns and out.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert packing.best_fit_packing(docs).count() == url_filter.filter_urls(pages, queries.URL_RULES).count() == 0
    full = table(spark, ["some text", None])
    assert decontaminate.remove_benchmark_spans(full, bench).count() == 2
    unlabelled = toxicity.fit_toxicity(full, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score_toxicity(full, unlabelled).collect()] == [0, 0]


def test_neighbours_of_few_and_repeated_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (4, [1.0]), (5, None), (40, [-1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect()
    own = {q: [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in (20, 40)}
    assert own[20] == [(3, 3.0), (1, 0.0), (2, 0.0), (40, 0.0)]  # asked once, with the least of its vectors
    assert own[40] == [(3, 0.0), (20, 0.0), (20, -1.0), (1, -2.0), (2, -2.0)]


def test_url_graph_equals_sql(spark, tmp_path):
    rng = random.Random(71)
    hosts = ["a.example.com", "b.test:8080", "c.net", "x.org:443", "y.example.net", "Z.de"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(12)}{rng.choice(['', '/', '?q=1', '?utm_x=2&q=1', '#top'])}"
    pages = []
    for i in range(120):
        to = url() if rng.random() < 0.7 else rng.choice(["/en/3", "//c.net/de/4?q=1", "/es/5?utm_s=1"])
        html = "" if rng.random() < 0.6 else rng.choice([f'<link rel="canonical" href="{to}">', f'<meta http-equiv="refresh" content="0; url={to}">'])
        pages.append((i, None if i == 5 else "no scheme" if i == 6 else url(), html))
    frame = spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = url_filter.filter_urls(frame, queries.URL_RULES).collect()
    con = duckdb.connect()
    pq.write_table(pa.table({k: [p[j] for p in pages] for j, k in enumerate(("page_id", "url", "html"))}), tmp_path / "pages.parquet")
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select page_id, host, path, rule, verdict, reason from ({queries.ORACLE_SQL['op7_url_filter']})").fetchall()}
    assert len(got) == 121 and {r.page_id: (r.host, r.path, r.rule, r.verdict, r.reason) for r in got} == want
    assert sum(r.reason == "alias" for r in got) > 10


def test_relative_targets(spark):
    page = "http://h.test/a/b/c.html?x=1"
    cases = {
        "d.html": "http://h.test/a/b/d.html", "../d": "http://h.test/a/d", "./d?y=1&amp;z=2": "http://h.test/a/b/d?y=1&z=2", "?id=3": "http://h.test/a/b/c.html?id=3",
        "/r/../s": "http://h.test/s", "../../../q": "http://h.test/q", "//o.test/p": "http://o.test/p", "mailto:a@b": None, "#top": None, "https://k.test/?u=http://m": "https://k.test/?u=http://m",
    }
    rows = [(i, page, f'<link rel="canonical" href="{c}">') for i, c in enumerate(cases)]
    got = url_filter.link_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.target for r in got) == sorted(v for v in cases.values() if v) and {r.source for r in got} == {page}
    rootless = url_filter.link_edges(spark.createDataFrame([(1, "http://h.test", '<link rel="canonical" href="x">')], "page_id long, url string, html string"))
    assert [r.target for r in rootless.collect()] == ["http://h.test/x"]
