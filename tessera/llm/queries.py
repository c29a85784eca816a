"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontaminate import decontamination_report
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .ngram_join import ngram_jaccard_join
from .packing import CAPACITIES, best_fit_packing
from .substring_dedup import paragraph_report
from .suffix_dedup import repeated_passages
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import filter_urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_removed", "chunks_removed", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return score_toxicity(documents, fit_toxicity(documents, labels), threshold=0.7)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), threshold=75, size=5)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return repeated_passages(_table(spark, sf_dir, "documents")).withColumn("spans", spans)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


#: Fixed values of the url query.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_report(_table(spark, sf_dir, "documents"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express: words and places of the base phrases."""
    return scan_licenses(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 must keep, by document: all words, in adjoining pieces of at most the largest length, each inside a permitted bin."""
    placed = best_fit_packing(_table(spark, sf_dir, "documents"))
    inside = (F.col("n_words") == 0) | ((F.col("offset") + F.col("n_words") <= F.col("capacity")) & F.col("capacity").isin(*CAPACITIES))
    adjoining = (F.col("start") == F.col("piece") * max(CAPACITIES)) & (F.col("n_words") <= max(CAPACITIES))
    return placed.groupBy("doc_id").agg(
        F.sum("n_words").alias("n_words"), F.count("*").alias("pieces"), F.count(F.when(F.col("n_words") == 0, 1)).alias("wordless"),
        F.count(F.when(~(inside & adjoining), 1)).alias("misplaced"),
    )


def packing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8's bins: none holds overlapping pieces or gaps, and none would fit a smaller permitted size."""
    placed = best_fit_packing(_table(spark, sf_dir, "documents")).where("bin_id is not null")
    bins = placed.groupBy("bin_id", "capacity").agg(F.sum("n_words").alias("held"), F.max(F.col("offset") + F.col("n_words")).alias("reach"), F.count("*").alias("n"), F.countDistinct("offset").alias("places"))
    least = F.coalesce(*[F.when(F.col("held") <= c, F.lit(c)) for c in sorted(CAPACITIES)])
    return bins.agg(
        F.sum("held").alias("n_words"), F.count(F.when((F.col("held") != F.col("reach")) | (F.col("n") != F.col("places")), 1)).alias("broken"),
        F.count(F.when(F.col("capacity") != least, 1)).alias("oversized"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_url_filter": op7_url_filter,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "license_base_places": license_base_places,
    "packing_totals": packing_totals,
    "packing_bins": packing_bins,
}

ORACLE_SQL: dict[str, str] = {
    "op5_suffix_array_dedup": rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 48)) as p, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) as g from d where len(w) >= 50),
x as (select doc_id, p from (select *, row_number() over (partition by g order by doc_id, p) as k from g) where k > 1),
y as (select distinct doc_id, unnest(range(p - 1, p + 49)) as i from x),
z as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as run from y),
s as (select doc_id, min(i) as a, max(i) + 1 as b from z group by doc_id, run),
r as (select doc_id, cast(sum(b - a) as bigint) as n_removed, string_agg(a || '-' || b, ',' order by a) as spans from s group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(spans, '') as spans from d left join r using (doc_id)
""",
    "op7_url_filter": rf"""
with recursive t as (
  select page_id, url, unnest(list_concat(regexp_extract_all(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]+)"', 1),
    regexp_extract_all(html, '(?is)<meta[^>]*http-equiv="refresh"[^>]*content="[^">]*url=([^">]+)"', 1))) as t from pages),
l as (select distinct url, case when contains(t, '://') then t when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') then regexp_extract(url, '^[^/?#]*://[^/?#]*') || t end as t from t),
w as (select url from pages union select t from l),
p as (select url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from w where url is not null),
h as (select url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
a as (select *, case when host <> '' then regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || coalesce('?' || nullif(array_to_string(
    list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: not starts_with(x, 'utm_') and x <> ''), '&'), ''), '') end as node from h),
n as (select page_id, coalesce(host, '') as host, coalesce(path, '') as path, node from pages left join a using (url)),
rules(rule, verdict) as (values ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
s as (select rule, verdict, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rp from rules),
f as (select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule) desc, rule desc) as k
  from n join s on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
o as (select n.*, f.rule, f.verdict from n left join f on f.page_id = n.page_id and f.k = 1),
g as (select distinct x.node as u, y.node as v from l join a x on x.url = l.url join a y on y.url = l.t where x.node is not null and y.node is not null),
e as (select u, v from g union select v, u from g),
r(node, other) as (select distinct node, node from a where node is not null union select r.node, e.v from r join e on e.u = r.other),
c as (select node, min(other) as c from r group by 1),
v as (select c.c, bool_or(o.verdict = 'allow') as allowed, bool_or(o.verdict = 'block') as blocked from o join c using (node) where o.rule is not null group by 1)
select o.page_id, o.host, o.path, o.rule,
  coalesce(o.verdict, case when v.allowed then 'allow' when v.blocked then 'block' else 'allow' end) as verdict,
  case when o.rule is not null then 'rule' when v.allowed is not null then 'alias' else 'default' end as reason
from o left join c using (node) left join v on v.c = c.c
""",
    "op10_substring_dedup": rf"""
with recursive l as (
  select doc_id, unnest(range(len(string_split(text, chr(10))))) as ln, unnest(string_split(text, chr(10))) as line from documents where text is not null),
v as (select doc_id, ln, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from l),
y as (select doc_id, ln, len(w) as n, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from v where len(w) > 0),
f as (select *, cast(cast('0x' || substr(hex(word), 1, 8) as bigint) as hugeint) as f from y),
x as (select *, case when i < n then (f * 1812433253 + lead(f) over (partition by doc_id, ln order by i) * 1664525) % 2147483647 end as x from f),
b as (select *, coalesce(i > 8 and n - i > 8 and x < min(x) over (partition by doc_id, ln order by i rows between 8 preceding and 1 preceding)
  and x < min(x) over (partition by doc_id, ln order by i rows between 1 following and 8 following), false) as cut from x),
k as (select *, coalesce(sum(cast(cut as int)) over (partition by doc_id, ln order by i rows between unbounded preceding and 1 preceding), 0) as k from b),
g as (select doc_id, ln, k, count(*) as words, list(word order by i) as w from k group by 1, 2, 3),
q as (select *, array_to_string(w, ' ') as body from (select *, row_number() over (partition by doc_id order by ln, k) - 1 as par from g) where words >= 5),
t as (select body, row_number() over (order by body) as t, w from (select body, any_value(w) as w from q group by 1)),
s as (select t, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as g from t),
n as (select t, count(*) as n from s group by 1),
o as (select a.t as u, b.t as v, count(*) as k from s a join s b on a.g = b.g and a.t <> b.t group by 1, 2),
e as (select u, v from o join n x on x.t = u join n y on y.t = v where 100 * k >= 75 * (x.n + y.n - k)),
r(t, node) as (select t, t from t union select r.t, e.v from r join e on e.u = r.node),
c as (select t, min(node) as c from r group by 1),
p as (select q.*, row_number() over (partition by c.c order by q.doc_id, q.par) > 1 as gone from q join t on q.body = t.body join c on c.t = t.t),
a as (select doc_id, count(*) as n_paragraphs, count(*) filter (gone) as n_removed, cast(coalesce(sum(words) filter (gone), 0) as bigint) as words_removed,
  coalesce(string_agg(par, ',' order by par) filter (gone), '') as removed from p group by 1),
h as (select doc_id, words, par - row_number() over (partition by doc_id order by par) as run from p where gone),
m as (select doc_id, count(*) as n_passages from (select doc_id from h group by doc_id, run having sum(words) >= 20) group by 1)
select doc_id, coalesce(n_paragraphs, 0) as n_paragraphs, coalesce(n_removed, 0) as n_removed, coalesce(words_removed, 0) as words_removed, coalesce(n_passages, 0) as n_passages,
  coalesce(removed, '') as removed
from documents left join a using (doc_id) left join m using (doc_id)
""",
    "op1_line_dedup": r"""
with l as (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i, unnest(string_split(text, chr(10))) as line,
    from documents where text is not null),
h as (select *, cast('0x' || substr(md5(line), 1, 8) as bigint) as h from l),
r as (select *, (h + 31 * coalesce(lag(h) over (partition by doc_id order by i), 0)) % 4 = 0 as c from h),
e as (select *, c and not coalesce(lag(c) over (partition by doc_id order by i), false) as e from r),
k as (select *, coalesce(sum(cast(e as int)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from e),
c as (select doc_id, k, count(*) as n, string_agg(line, chr(10) order by i) as body from k group by 1, 2),
d as (select *, n >= 2 and row_number() over (partition by body order by doc_id, k) > 1 as gone from c),
t as (select doc_id, coalesce(sum(n) filter (gone), 0) as lines_removed, count(*) filter (gone) as chunks_removed,
    coalesce(string_agg(body, chr(10) order by k) filter (not gone), '') as text from d group by 1)
select doc_id, cast(lines_removed as bigint) as lines_removed, chunks_removed, length(text) as n_chars_kept, md5(text) as text_md5 from t
union all select doc_id, 0, 0, null, null from documents where text is null
""",
    "op9_decontamination": rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
g as (
  select distinct item_id, least(8, len(w)) as n, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i + least(8, len(w)) - 1], ' '))) as g
  from b where len(w) > 0),
n as (select distinct n from g),
p as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as g
  from d, n where len(w) >= n),
h as (select p.doc_id, p.p, p.n, g.item_id from p join g on p.g = g.g and p.n = g.n),
k as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p, p + n)) as at from h) group by 1),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, cast(item_id as varchar) as item from h) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join k using (doc_id) left join i using (doc_id)
""",
    "op4_ngram_jaccard_join": rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select u, v from o join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, node) as (select doc_id, doc_id from w union select r.doc_id, l.v from r join l on l.u = r.node)
select r.doc_id, cast(coalesce(max(n.n), 0) as bigint) as n_shingles, min(r.node) as component_id
from r left join n using (doc_id) group by r.doc_id
""",
    "license_base_places": rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i:i + 3] = ['under', 'the', 'mit', 'license']) as a,
  list_filter(range(1, len(w) + 1), lambda i: w[i:i + 3] = ['apache', 'license', 'version', '2']) as b, list_filter(range(1, len(w) + 1), lambda i: w[i:i + 2] = ['cc', 'by', 'nc']) as c from d),
q as (select *, list_sort(list_concat(a, b, c)) as s from p)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(s) as bigint) as n_base, s[1] - 1 as first_word, s[len(s)] - 1 as last_word,
  array_to_string(list_filter([case when len(b) > 0 then 'apache-2' end, case when len(c) > 0 then 'cc-by-nc' end, case when len(a) > 0 then 'mit' end], lambda x: x is not null), ',') as base_labels
from q
""",
    "packing_totals": r"""
with d as (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n from documents)
select doc_id, n as n_words, greatest((n + 4095) // 4096, 1) as pieces, case when n = 0 then 1 else 0 end as wordless, 0 as misplaced from d
""",
    "packing_bins": r"""
select cast(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as bigint) as n_words, 0 as broken, 0 as oversized from documents
""",
}
