"""License scan: ordered signature rules behind a keyword prefilter, in DataFrame operations only.

Three base phrases are found as consecutive words. Beside them stand several hundred signature
rules, each a regex with a label, a priority and a keyword. One cheap regex selects texts that can
match at all; in these, a rule runs only if its keyword occurs. A detection goes if it lies within an
earlier or equal one of the same or a higher priority (order: start, longer first, higher priority
first, rule number), and the labels of the rest are added to the base labels.

Null and empty texts have no words and no labels. Rows repeat as in the input; rows that share
doc_id and text share their result. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A letter or digit of a word, before lower-casing; all non-ASCII characters count.
_W = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORD = rf"[{_W}]+"
_GAP = rf"[^{_W}]+"
_BEFORE, _AFTER = rf"(?<![{_W}])", rf"(?![{_W}])"

#: Phrase and label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, SPDX identifier, keyword (or several, with | between), name pattern (spaces stand for any gap), address.
LICENSES = (
    ("mit", "MIT", "mit|expat", r"(?:mit|expat) licen[cs]e", r"opensource\.org/licenses?/mit"),
    ("apache-2", "Apache-2.0", "apache", r"apache (?:software )?licen[cs]e,? (?:version |v)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "Apache-1.1", "apache", r"apache (?:software )?licen[cs]e,? (?:version |v)?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("gpl-2", "GPL-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)?2", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3", "GPL-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)?3", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "GPL", "general public", r"(?:gnu )?general public licen[cs]e", r"gnu\.org/licenses/gpl"),
    ("lgpl-2.1", "LGPL-2.1", "general public", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3", "LGPL-3.0", "general public", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)?3", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3", "AGPL-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?:,? (?:version |v)?3)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", "GFDL-1.3", "free documentation", r"(?:gnu )?free documentation licen[cs]e", r"gnu\.org/licenses/fdl"),
    ("bsd-2", "BSD-2-Clause", "bsd", r"(?:(?:two|2) clause|simplified|freebsd) bsd licen[cs]e", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3", "BSD-3-Clause", "bsd", r"(?:(?:three|3) clause|new|modified|revised) bsd licen[cs]e", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4", "BSD-4-Clause", "bsd", r"(?:(?:four|4) clause|original) bsd licen[cs]e", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", "0BSD", "bsd", r"bsd(?: style)? licen[cs]e", r"opensource\.org/licenses?/0bsd"),
    ("mpl-1.1", "MPL-1.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2", "MPL-2.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1", "EPL-1.0", "eclipse", r"eclipse public licen[cs]e,? (?:version |v)?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2", "EPL-2.0", "eclipse", r"eclipse public licen[cs]e,? (?:version |v)?2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl", "CDDL-1.0", "common development", r"common development and distribution licen[cs]e", r"opensource\.org/licenses?/cddl"),
    ("isc", "ISC", "isc", r"isc licen[cs]e", r"opensource\.org/licenses?/isc"),
    ("zlib", "Zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib\.net/zlib_license"),
    ("boost", "BSL-1.0", "boost", r"boost software licen[cs]e", r"boost\.org/license_1_0"),
    ("unlicense", "Unlicense", "unlicen", r"the unlicen[cs]e", r"unlicense\.org"),
    ("wtfpl", "WTFPL", "wtfpl", r"wtfpl(?: licen[cs]e)?", r"wtfpl\.net"),
    ("artistic-1", "Artistic-1.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?1(?:\.0)?", r"opensource\.org/licenses?/artistic-1\.0"),
    ("artistic-2", "Artistic-2.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?2(?:\.0)?", r"opensource\.org/licenses?/artistic-2\.0"),
    ("psf", "PSF-2.0", "python", r"python software foundation licen[cs]e", r"docs\.python\.org/\d/license"),
    ("php", "PHP-3.01", "php", r"php licen[cs]e", r"php\.net/license"),
    ("ruby", "Ruby", "ruby", r"ruby licen[cs]e", r"ruby-lang\.org/[a-z]+/license"),
    ("openssl", "OpenSSL", "openssl", r"openssl licen[cs]e", r"openssl\.org/source/license"),
    ("eupl", "EUPL-1.2", "european union", r"european union public licen[cs]e", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("ofl", "OFL-1.1", "open font", r"(?:sil )?open font licen[cs]e", r"scripts\.sil\.org/ofl"),
    ("odbl", "ODbL-1.0", "database", r"open (?:data commons )?(?:open )?database licen[cs]e", r"opendatacommons\.org/licenses/odbl"),
    ("pddl", "PDDL-1.0", "public domain", r"public domain dedication and licen[cs]e", r"opendatacommons\.org/licenses/pddl"),
    ("cc0", "CC0-1.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", "CC-BY-4.0", "cc by", r"cc by(?: \d\.\d)?", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "CC-BY-SA-4.0", "cc by", r"cc by sa(?: \d\.\d)?", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", "CC-BY-ND-4.0", "cc by", r"cc by nd(?: \d\.\d)?", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc", "CC-BY-NC-4.0", "cc by", r"cc by nc(?: \d\.\d)?", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", "cc by", r"cc by nc sa(?: \d\.\d)?", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", "cc by", r"cc by nc nd(?: \d\.\d)?", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by", "CC-BY-3.0", "creative commons", r"creative commons attribution(?: licen[cs]e)?", r"creativecommons\.org/licenses/by/3"),
    ("cc-by-sa", "CC-BY-SA-3.0", "creative commons", r"creative commons attribution share ?alike", r"creativecommons\.org/licenses/by-sa/3"),
    ("cc-by-nc", "CC-BY-NC-3.0", "creative commons", r"creative commons attribution non ?commercial", r"creativecommons\.org/licenses/by-nc/3"),
)

#: Priority, confidence, and the pattern around a license's ID, NAME or URL.
FORMS = (
    (4, r"spdx license identifier:? ID"),
    (4, r"(?:released|licen[cs]ed|distributed|published|available) (?:to you )?under (?:the )?(?:terms of )?(?:the )?NAME"),
    (4, r"(?:work|file|program|software|library|project|document|code) is (?:licen[cs]ed|covered|governed) (?:under|by) (?:the )?NAME"),
    (3, r"subject to the (?:terms (?:and conditions )?of the )?NAME"),
    (3, r"under the (?:terms|conditions) of the NAME"),
    (3, r"licen[cs]e:? (?:is )?(?:the )?NAME"),
    (3, r"licen[cs]e:? ID"),
    (3, "URL"),
    (2, r"(?:the )?NAME"),
)
#: Label, priority, keyword and pattern of notices that name no license.
NOTICES = (
    ("mit", 3, "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("isc", 3, "permission to use", r"permission to use,? copy,? modify,? and or distribute this software for any purpose"),
    ("bsd", 3, "redistribution and use", r"redistribution and use in source and binary forms"),
    ("gpl", 2, "free software", r"free software:? you can redistribute it and or modify it"),
    ("public-domain", 2, "public domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("proprietary", 1, "all rights reserved", r"all rights reserved"),
    ("proprietary", 1, "confidential", r"proprietary and confidential"),
    ("copyright", 1, "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
)
CONFIDENCE = {1: 0.4, 2: 0.7, 3: 0.9, 4: 1.0}


def _bodies() -> list[tuple[str, int, str, str]]:
    """``(label, priority, keyword, pattern)`` of every rule, in order; the keyword may have several words."""
    out = []
    for label, spdx, keyword, name, url in LICENSES:
        for priority, form in FORMS:
            own = spdx.lower().split("-")[0] if form.endswith(" ID") else url.split("\\")[0] if form == "URL" else keyword
            body = form.replace("NAME", name).replace("ID", spdx.replace(".", r"\.")).replace("URL", url)
            out.append((label, priority, own, body))
    return out + [(label, priority, keyword, body) for label, priority, keyword, body in NOTICES]


def signature_rules() -> list[tuple[int, str, int, str, str]]:
    """``(number, label, priority, keyword, regex)`` of every rule, in order."""
    spaced = lambda p: p.replace(" ?", rf"(?:{_GAP})?").replace(" ", _GAP)
    first = lambda k: "|".join(x.split(" ")[0] for x in k.split("|"))
    return [(i, label, priority, first(keyword), f"(?i){_BEFORE}(?:{spaced(body)}){_AFTER}") for i, (label, priority, keyword, body) in enumerate(_bodies())]


def _prefilter() -> str:
    """Selects the texts in which any rule can match: where "licen" is no must, by the rule's whole keyword, with any gap."""
    needs = set()
    for _, _, keyword, body in _bodies():
        must = body
        while (shorter := re.sub(r"\(\?:[^()]*\)\?", "", must)) != must:
            must = shorter
        if "licen" not in must:
            needs.update(keyword.split("|"))
    return rf"(?i)licen[cs]|{_BEFORE}(?:{'|'.join(sorted(_phrase(k) for k in needs))})"


def _phrase(words: str) -> str:
    return _GAP.join(words.split(" "))


PREFILTER = _prefilter()


def scan_licenses(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row."""
    any_base = f"{_BEFORE}(?:{'|'.join(_phrase(p) for p, _ in BASE)}){_AFTER}"
    words = lambda c: F.regexp_count(c, F.lit(WORD)).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select("doc_id", text.alias("text")).withColumn("_key", F.xxhash64("text")).withColumn("_may", F.col("text").rlike(PREFILTER))
    detections = _detections(docs.where("_may"))
    some = F.col("n_base") > 0
    before = lambda pattern: F.regexp_extract("text", f"(?is)^({pattern}){any_base}", 1)
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){_BEFORE}{_phrase(p)}{_AFTER}"), F.lit(label)) for p, label in BASE]))
    base = (
        docs.withColumn("n_words", words(F.col("text")))
        .withColumn("n_base", F.regexp_count("text", F.lit(f"(?i){any_base}")).cast("long"))
        .select(
            F.col("doc_id"), F.col("_key"), F.col("n_words"), F.col("n_base"),
            F.when(some, words(before(".*?"))).alias("first_word"),
            F.when(some, words(before(".*"))).alias("last_word"),
            F.when(some, F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>")).alias("_base"),
        )
    )
    beside = detections.withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
    both = base.join(beside, base["doc_id"].eqNullSafe(beside["_id"]) & (base["_key"] == beside["_k"]), "left")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.when(some, F.lit(0.9)).otherwise(F.lit(0.0)), F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def detections(documents: DataFrame) -> DataFrame:
    """Every surviving detection: ``doc_id, _key, rule, label, priority, start, end`` (characters)."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_key", F.xxhash64("text"))
    return _survivors(docs.where(F.col("text").rlike(PREFILTER)))


def _survivors(docs: DataFrame) -> DataFrame:
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(a).alias("label"), F.lit(p).alias("priority"), F.array(*map(F.lit, k.split("|"))).alias("keywords"), F.lit(x).alias("regex")) for i, a, p, k, x in signature_rules()])
    low = docs.withColumn("_low", F.lower("text"))
    tried = low.select("doc_id", "_key", "text", F.explode(F.filter(rules, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("_low"), k)))).alias("r"))
    matched = tried.withColumn("_m", F.expr("regexp_extract_all(text, r.regex, 0)")).where("size(_m) > 0")
    places = matched.withColumn("_gap", F.slice(F.split("text", F.col("r.regex"), -1), F.lit(1), F.size("_m"))).select(
        "doc_id", "_key", "r.rule", "r.label", "r.priority",
        F.posexplode(F.zip_with("_gap", "_m", lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))).alias("i", "p"),
    ).distinct()
    along = Window.partitionBy("doc_id", "_key", "rule").orderBy("i")
    spans = places.select(
        "doc_id", "_key", "rule", "label", "priority",
        (F.sum(F.col("p.gap") + F.col("p.size")).over(along) - F.col("p.size")).alias("start"),
        F.sum(F.col("p.gap") + F.col("p.size")).over(along).alias("end"),
    )
    earlier = Window.partitionBy("doc_id", "_key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    for p in sorted(CONFIDENCE):
        spans = spans.withColumn(f"_end{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(earlier))
    within = F.coalesce(*[F.when(F.col("priority") == p, F.coalesce(F.col(f"_end{p}") >= F.col("end"), F.lit(False))) for p in sorted(CONFIDENCE)])
    return spans.where(~within).drop(*[f"_end{p}" for p in CONFIDENCE])


def _detections(docs: DataFrame) -> DataFrame:
    confidence = F.coalesce(*[F.when(F.col("priority") == p, F.lit(c)) for p, c in CONFIDENCE.items()])
    return _survivors(docs.select("doc_id", "text", "_key")).groupBy("doc_id", "_key").agg(
        F.collect_set("label").alias("_found"), F.max(confidence).alias("_score")
    )
