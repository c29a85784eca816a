"""Operators of tessera.llm against plain versions, and on odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, decontaminate, license_scan, line_dedup, ngram_join, packing, pairing, substring_dedup, suffix_dedup, toxicity, url_filter
from tessera.llm.components import connected_components
from tessera.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    base = table(spark, [None, "", " \n ", "x", long_text, "same text of six words here", "same text of six words here", "null id", "twice", "twice"], [0, 1, 2, 3, 4, 5, 6, None, 7, 7])
    return base.withColumn("sid", F.lit(1)).withColumn("evidence", F.lit("x"))


def corpus(rng, n=60):
    """Texts with near copies, shared passages and repeated lines."""
    word = lambda: "".join(rng.choice("abcdefgäß") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(70)]
    out = []
    for i in range(n):
        own = [word() for _ in range(rng.randint(5, 160))]
        kind = rng.random()
        if kind < 0.35 and out:
            own = out[rng.randrange(len(out))].split(" ")
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
        elif kind < 0.6:
            at = rng.randint(0, len(own))
            own = own[:at] + passage[: rng.randint(40, 70)] + own[at:]
        out.append(" ".join(own))
    return out


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(texts):
    sets, parent = [shingles(t) for t in texts], {}
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return [find(parent, i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("block", [2048, 3])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pairing, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP_LEAST", 3)
    texts = corpus(random.Random(block))
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.ngram_jaccard_join(table(spark, texts)).collect()}
    roots, sizes = plain_components(texts)
    assert [got[i] for i in range(len(texts))] == list(zip(roots, sizes))


def test_signatures_never_miss_a_linked_pair():
    rng = np.random.default_rng(1)
    levels = np.array(ngram_join._levels(75)[:120])
    for trial in range(400):
        n = int(rng.integers(2, 80))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = rng.random(len(a)) > rng.random() * 0.25
        b = np.unique(np.r_[a[keep], rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or min(len(a), len(b)) < 2:
            continue
        frequent = np.sort(rng.choice(a, int(len(a) * rng.random()), replace=False))
        (s, left), (t, right) = (ngram_join.signatures(x, frequent, 75, levels) for x in (a, b))
        need = -(-75 * (len(a) + len(b)) // 175)
        bounds = [(dict(zip(s, left))[k], dict(zip(t, right))[k]) for k in np.intersect1d(s, t)]
        assert bounds and any(min(x) >= need for x in bounds), trial


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(5001, 5300)]
    parent = {}
    for u, v in edges:
        x, y = find(parent, u), find(parent, v)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(df, Workspace(spark, "t")).collect()}
    assert got == {x: find(parent, x) for x in parent if find(parent, x) != x}


def test_line_dedup_and_shifts(spark):
    rng = random.Random(2)
    lines = lambda k: ["".join(rng.choice("abc ") for _ in range(12)) for _ in range(k)]
    shared = lines(40)
    texts = ["\n".join(lines(rng.randint(0, 9)) + shared + lines(rng.randint(0, 9))) for _ in range(5)] + ["a\nb\n\nc", "", None]
    docs = table(spark, texts)
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    chunks = {r.doc_id: r._ld_chunks for r in line_dedup.line_chunks(docs, "text", 4).collect()}
    assert all("\n".join(chunks[i]) == t for i, t in enumerate(texts) if t is not None)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        own = [c for c in chunks[i] or [] if "\n" not in c or c not in seen and not seen.add(c)]
        want[i] = None if t is None else "\n".join(own)
    assert {i: r.text for i, r in kept.items()} == want
    assert all(kept[i].lines_removed >= 25 for i in range(1, 5)) and kept[0].lines_removed == 0


def test_every_embedded_run_is_found(spark):
    rng = random.Random(12)
    lines = lambda k: ["".join(rng.choice("abcdef ") for _ in range(20)) for _ in range(k)]
    passages = [lines(k) for k in range(2, 9) for _ in range(5)]
    texts = ["\n".join(lines(6) + p + lines(5)) for p in passages + passages] + ["x\n" * 5, "a\nb", "", None]
    got = {r.doc_id: r for r in line_dedup.dedup_runs(table(spark, texts)).collect()}
    seen, want = set(), []
    for t in texts:
        own, lost = (t or "").split("\n"), set()
        for i, window in enumerate(zip(own, own[1:])):
            lost |= {i, i + 1} if window in seen else set()
            seen.add(window)
        want.append(None if t is None else "\n".join(x for i, x in enumerate(own) if i not in lost))
    assert [got[i].text for i in range(len(texts))] == want
    n = len(passages)
    assert [got[n + i].lines_removed for i in range(n)] == [len(p) for p in passages]
    assert all(got[i].n_chars == (None if t is None else len(t)) for i, t in enumerate(want))


def test_pipeline_drops_a_short_run(spark):
    import corpus_pipeline

    rng = random.Random(13)
    lines = lambda k: ["".join(rng.choice("abcdef ") for _ in range(20)) for _ in range(k)]
    passages = [lines(3) for _ in range(20)]
    docs = table(spark, ["\n".join(lines(4) + p + lines(4)) for p in passages + passages])
    texts = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert not any(x in texts[20 + i].split("\n") for i, p in enumerate(passages) for x in p)


def run_places(texts):
    seen, out = set(), set()
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        out |= {(i, at) for at, w in enumerate(zip(own, own[1:])) if w in seen or seen.add(w)}
    return out


def test_runs_are_told_apart_by_bytes(spark, monkeypatch):
    import corpus_pipeline

    texts = ["a\nb\nc", "d\ne\nf\ng", "x\nd\ne", "a\nb\nc", "a\nb\n", "y", "", None]
    docs = table(spark, texts)
    for name in ("md5", "xxhash64"):  # every print is equal
        same = F.lit("0" * 32) if name == "md5" else F.lit(0).cast("long")
        monkeypatch.setattr(line_dedup.F, name, lambda *c, same=same: same)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: texts[1], 2: "x", 3: "", 4: "", 5: "y", 6: "", 7: None}


def test_runs_come_from_repeated_chunks_first(spark, monkeypatch):
    rng = random.Random(14)
    lines = lambda k: ["".join(rng.choice("abc ") for _ in range(9)) for _ in range(k)]
    shared = lines(40)
    texts = ["\n".join(lines(rng.randint(0, 9)) + shared[rng.randint(0, 9) :] + lines(rng.randint(0, 9))) for _ in range(8)]
    docs, taken, chunks = table(spark, texts), [], line_dedup.repeated_chunks

    def watched(*args):
        lost = chunks(*args)
        taken.extend(lost.collect())
        return lost

    monkeypatch.setattr(line_dedup, "repeated_chunks", watched)
    got = line_dedup.repeated_runs(docs, Workspace(spark, "t")).collect()
    assert {(r._ld_id, r.at) for r in got} == run_places(texts) and len(got) == len(run_places(texts))
    assert len(taken) > 20
    starts = {r.doc_id: (r._ld_starts, [len(c.split("\n")) for c in r._ld_chunks]) for r in line_dedup.line_chunks(docs, "text", 4).collect()}
    assert all(a == [sum(n[:k]) for k in range(len(n))] for a, n in starts.values())


def test_suffix_dedup_equals_marking_windows(spark):
    texts = [*corpus(random.Random(9)), "one two " * 120, "two one " * 90, None]
    docs = table(spark, texts)
    first, want = {}, []
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A_TO_Z)) for t in texts]
    for i, w in enumerate(words):
        lost = set()
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), (i, p)) != (i, p):
                lost.update(range(p, p + 50))
        want.append(len(lost))
    for block in (2048, 2):
        got = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_passages(docs, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want, block


def plain_paragraphs(text):
    """Line by line, word by word: cut where the print is least among eight on either side."""
    out = []
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line.translate(A_TO_Z))
        lead = [int.from_bytes(w.encode()[:4], "big") for w in words]
        prints = [(a * 1812433253 + b * 1664525) % 2147483647 for a, b in zip(lead, lead[1:])]
        at = 0
        for i in range(8, len(words) - 9):
            if all(prints[i] < prints[j] for j in range(i - 8, i + 9) if j != i):
                out.append(words[at : i + 1])
                at = i + 1
        out += [words[at:]] if words else []
    return out


def test_paragraphs_equal_all_pairs(spark):
    rng = random.Random(11)
    texts = [*corpus(rng, 70), "a " * 20, "a " * 30 + "\nb c", "", None, "one two three four", "one two three four"]
    texts = [t if t is None or i % 3 else t.replace(" ", "\n", 2) for i, t in enumerate(texts)]
    places = [(i, k, p) for i, t in enumerate(texts) for k, p in enumerate(plain_paragraphs(t)) if len(p) >= 5]
    roots, _ = plain_components([" ".join(p) for _, _, p in places])
    lost = {}
    for root, at, (i, k, p) in zip(roots, range(len(places)), places):
        if root != at:
            lost.setdefault(i, []).append((k, len(p)))
    docs = table(spark, texts).withColumn("_key", F.lit(1)).withColumn("removed", F.lit("x"))
    got = {r.doc_id: r for r in substring_dedup.paragraph_report(docs).collect()}
    assert [(got[i].n_removed, got[i].words_removed, got[i].removed) for i in range(len(texts))] == [
        (len(x), sum(n for _, n in x), ",".join(str(k) for k, _ in x)) for x in (lost.get(i, []) for i in range(len(texts)))
    ]
    assert sum(len(x) for x in lost.values()) > 50
    kept = substring_dedup.remove_repeated_paragraphs(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        gone = {k for k, _ in lost.get(r.doc_id, [])}
        left = [w for k, p in enumerate(plain_paragraphs(texts[r.doc_id])) if k not in gone for w in p]
        assert r.text is None if texts[r.doc_id] is None else r.text.translate(A_TO_Z).split() == left


def test_passages_spliced_into_lines_are_found(spark):
    rng = random.Random(21)
    words = lambda k: ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(k)]
    passages = [words(rng.randint(55, 80)) for _ in range(40)]
    holders = [" ".join(words(rng.randint(10, 60)) + passages[i % 40] + words(rng.randint(10, 60))) for i in range(80)]
    clean = [" ".join(words(rng.randint(20, 200))) for _ in range(40)]
    got = {r.doc_id: r for r in substring_dedup.paragraph_report(table(spark, holders + clean)).collect()}
    assert sum(got[i].n_passages > 0 for i in range(40, 80)) >= 39
    assert all(got[i].n_removed == 0 for i in [*range(40), *range(80, 120)])


def test_decontamination_equals_plain_scan(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "cd", "éf", "g1", "h", "İx"])
    items = [" ".join(word() for _ in range(k)) for k in (3, 8, 12, 0, 6)]
    texts = [" - ".join(word() for _ in range(40)) for _ in range(12)] + [f"x {items[2]}, y {items[4]} z", None, ""]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, "ab")], "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_TO_Z))
    for part in (1 << 20, 10):
        hits = decontaminate.benchmark_hits(table(spark, texts), bench, part_words=part)
        got = {r.doc_id: (r.n_words, r.hits, r["items"]) for r in hits.select("kept.doc_id", "n_words", "hits", "items").collect()}
        for i, t in enumerate(texts):
            w, marked, found = split(t), set(), set()
            for k, item in enumerate(map(split, items)):
                size = min(8, len(item))
                for p in range(len(w) - size + 1):
                    if size and any(w[p : p + size] == item[q : q + size] for q in range(len(item) - size + 1)):
                        marked.update(range(p, p + size))
                        found.add(str(k))
            assert got[i] == (len(w), sorted(marked), sorted(found)), (i, part)
    clean = {r.doc_id: r.text for r in decontaminate.remove_benchmark_spans(table(spark, texts[-3:]), bench).collect()}
    assert "".join(clean[0].split()) in ("x,yz", "x,y") and clean[1] is None and clean[2] == ""


def test_toxicity_learns_only_from_training_rows_and_generalises(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeiourst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    word = lambda: rng.choice(vocabulary)
    texts, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        own = [word() for _ in range(rng.randint(20, 60))]
        if toxic:
            own[rng.randrange(len(own))] = "zmq" + word()
            own[rng.randrange(len(own))] = "zmq" + word()
        texts.append(" ".join(own))
        labels.append((i, 0, int(toxic)))
    docs = table(spark, texts)
    lab = spark.createDataFrame([*labels, (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, lab)
    rows = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit_toxicity(docs, flipped)
    assert np.allclose(model.slopes, again.slopes) and model.offset == pytest.approx(again.offset)
    empty = toxicity.fit_toxicity(docs.limit(0), lab.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd(spark), empty).collect())


def test_licenses(spark):
    texts = ["Released under the MIT License.", "Under the mit-LICENSE; Apache License, Version 2.0! under_the mit license", "cc by nc", "permit licenses", "SPDX-License-Identifier: GPL-3.0", None, ""]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels) == (1, 1, 1, "mit")
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 9, "apache-2,mit")
    assert got[2].base_labels == "cc-by-nc" and got[3].n_base == 0 and got[3].labels == "" and got[4].labels == "gpl-3"
    assert got[5].n_words == got[6].n_words == 0 and got[5].first_word is None and got[5].score == 0
    assert len(license_scan.signature_rules()) > 200
    bare = license_scan.scan_licenses(table(spark, ["The MIT license."])).first()
    assert (bare.n_base, bare.first_word, bare.base_labels, bare.labels) == (0, None, "", "mit")
    spans = license_scan.detections(table(spark, texts[:1])).collect()
    assert [(s.start, s.end, s.priority) for s in spans] == [(0, 30, 4)]


def test_every_license_rule_passes_prefilter_and_keyword():
    from re import _parser

    rng = random.Random(14)
    python = lambda p: p.replace(r"\x{80}", r"\x80").replace(r"\x{10FFFF}", r"\U0010FFFF")

    def sample(items):
        out = ""
        for op, value in items:
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
            else:
                assert kind == "ASSERT_NOT", kind
        return out

    prefilter = re.compile(python(license_scan.PREFILTER))
    for number, label, _, keyword, regex in license_scan.signature_rules():
        regex = python(regex)
        for _ in range(20):
            text = "_" + sample(_parser.parse(regex)) + "_"
            assert re.search(regex, text), (number, label, text)
            assert prefilter.search(text) and any(k in text.lower() for k in keyword.split("|")), (number, label, text)


def test_licenses_between_marks_and_over_line_ends(spark):
    texts = ["_CC BY-NC_ photo", "Redistribution and\nuse in source and binary forms", "All rights\nreserved", "free\nsoftware: you can redistribute it and/or modify it",
             "placed in the public\ndomain", "see scripts.sil.org/OFL", "joinup.ec.europa.eu/x/eupl", "the Expat License"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (1, 0, 0, "cc-by-nc")
    assert [got[i].labels for i in range(1, 8)] == ["bsd", "proprietary", "gpl", "public-domain", "ofl", "eupl", "mit"]


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.example.com/en/1", ""), (2, "https://Shop.test/x#f", link.format("http://a.example.com/en/1")), (3, "http://shop.test/x/?utm_a=1", None),
        (4, "http://example.com/en/77", ""), (5, "http://other.test/", ""), (6, None, "h"), (7, "no scheme", ""), (8, "http://xexample.com/en/7", "<meta http-equiv='refresh' content='0; url=/en/7'>"),
    ]
    rules = [("com/en/", "block"), ("example.com/en/7", "allow")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block"]
    assert got[2].host == "shop.test" and got[2].path == "/x" and got[2].rule is None and got[4].rule == "example.com/en/7" and got[6].host == got[7].path == ""


def test_packing(spark):
    rng = random.Random(6)
    texts = [" ".join("w" * 1 for _ in range(rng.choice([0, 3, 50, 400, 1500, 9000]))) for _ in range(60)] + [None]
    rows = packing.best_fit_packing(table(spark, texts), (512, 1024, 4096), shard=20).collect()
    by_bin, by_doc = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.n_words))
        if r.n_words:
            by_bin.setdefault(r.bin_id, []).append(r)
    for i, t in enumerate(texts):
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len((t or "").split())
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.n_words for r in own)
        assert all(a.offset + a.n_words == b.offset for a, b in zip(own, own[1:])) and own[0].capacity == min(c for c in (512, 1024, 4096) if c >= total)


def test_best_fit_chooses_the_fullest_bin():
    assert [p[0] for p in packing.pack([600, 500, 400, 100], (700, 1000))][2] in (0, 1)
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    fill, left = {}, {}
    for n, (k, offset, _) in zip(lengths, packing.pack(lengths, (100,))):
        fits = [b for b, f in fill.items() if 100 - f >= n]
        assert (k in fill and fill[k] == max(fill[b] for b in fits)) if fits else k not in fill
        fill[k] = fill.get(k, 0) + n


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0, None])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=10).collect()
    hits = 0
    for q in range(0, 800, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        hits += len({r.vec_id for r in own} & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.9 * 400 and {r.query_id for r in got} == set(range(0, 800, 20))


def test_neighbours_in_a_hot_group_of_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    hot = np.sort(rng.permutation(3000)[:1500])
    x[hot] = 3 * x[hot[0]]
    order = rng.permutation(3000)
    rows = [(int(i), [float(v) for v in x[i]]) for i in order]
    asked = [int(i) for i in hot[[0, 7, 700, 1499]]]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(asked), k=10).collect()
    for q in asked:
        own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [i for _, i in own] == [int(i) for i in hot if i != q][:10], q


def test_neighbours_visit_further_lists_until_k(spark, monkeypatch):
    monkeypatch.setattr(ann, "COVERAGE", 0.0)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(60)] + [(0, [float(v) for v in rng.normal(size=8)]) for _ in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k, n in ((20, 20), (70, 59)):
        got = ann.nearest(df, F.col("vec_id").isin(0, 1), k=k).collect()
        assert sum(r.query_id == 0 for r in got) == n
        assert sum(r.query_id == 1 for r in got) == min(k, 74)


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_and_empty_tables(spark, rows):
    docs = odd(spark) if rows == "odd" else odd(spark).limit(0)
    n = docs.count()
    bench = spark.createDataFrame([(1, "null id"), (2, None)], "item_id long, text string")
    for out in (
        line_dedup.dedup_lines(docs), ngram_join.ngram_jaccard_join(docs), suffix_dedup.repeated_passages(docs), substring_dedup.paragraph_report(docs),
        substring_dedup.remove_repeated_paragraphs(docs), decontaminate.decontamination_report(docs, bench), license_scan.scan_licenses(docs),
    ):
        assert out.count() == n
    assert packing.best_fit_packing(docs).select("doc_id").count() >= n
    assert decontaminate.remove_benchmark_spans(docs, bench).columns == docs.columns
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    work = Workspace(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = work.save(stage(spark, docs, d))
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = after
    roots, _ = plain_components([r.text for r in docs.orderBy("doc_id").collect()])
    assert roots == list(range(len(roots)))  # near copies are gone
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
