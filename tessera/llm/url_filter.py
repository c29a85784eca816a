"""URL rules whose block decisions spread to aliases.

A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's; the longest
fitting rule decides. Pages without a rule take the decision of their aliases: pages whose
normalised address is equal, or that redirects, meta refreshes and canonical links connect, directly
or through others (distributed connected components). Among the aliases an explicit allow comes
before a block; without either the page is allowed.

The normalised address drops the scheme, the default port, the fragment, ``utm_`` parameters and
trailing slashes. A null url, or one without ``://``, has empty host and path, no rule and no
aliases. Null html has no links; urls and html of any length are read whole. Of fitting rules of equal
length the greater text counts. Rows repeat as in the input, also with equal page_ids; extra columns,
whatever their names, are ignored; an empty table gives no rows. The rule list is a literal of at most
MAX_RULES rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import Workspace

MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*([^\"'\s>]+)"


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.expr(f"case when instr(`{url}`, '://') > 0 then substring(`{url}`, instr(`{url}`, '://') + 3) else '' end")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def address(url: str) -> Column:
    """Normalised address of a url column, null where it has none."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.col(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.startswith(p, F.lit("utm_")) & (p != "")), "&")
    whole = F.concat(F.regexp_replace(host, r":(?:80|443)$", ""), F.regexp_replace(path, r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", whole)


def fitting_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """``struct<size, rule, verdict>`` of the longest fitting rule, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    options = []
    for rule, verdict in rules:
        own, slash, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        options.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*options))


def _without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments resolved."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    parts = F.split(path, "/")
    return F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step), "/")


def link_edges(pages: DataFrame) -> DataFrame:
    """``source, target`` urls of canonical links and meta refreshes; relative targets are resolved against the page.

    Targets of other schemes (``mailto:``) and references into the page itself have no edge.
    """
    found = pages.select("url", F.array_union(F.regexp_extract_all("html", F.lit(_CANONICAL), 1), F.regexp_extract_all("html", F.lit(_REFRESH), 1)).alias("to"))
    links = found.where("size(to) > 0").select(F.col("url").alias("source"), F.explode("to").alias("to")).withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    base, path = F.regexp_extract("source", r"^[^/?#]*://[^/?#]*", 0), F.regexp_extract("source", r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract("to", r"^[^?#]*", 0), F.regexp_extract("to", r"^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?", 1))
    target = (
        F.when(F.col("to").rlike(r"^[A-Za-z][0-9A-Za-z+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").rlike(r"^(?:[A-Za-z][0-9A-Za-z+.-]*:|#|$)") | (base == ""), F.lit(None).cast("string"))
        .when(F.col("to").startswith("/"), F.concat(base, _without_dots(own), rest))
        .when(F.col("to").startswith("?"), F.concat(base, path, "to"))
        .otherwise(F.concat(base, _without_dots(F.concat(folder, own)), rest))
    )
    return links.select("source", target.alias("target")).where("target is not null")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, reason``; ``redirects(source, target)`` adds edges."""
    work = Workspace(pages.sparkSession, "url-filter")
    host, path = host_and_path("url")
    pick = fitting_rule(rules, F.col("host"), F.col("path"))
    judged = (
        pages.select("page_id", "url").withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
        .withColumn("pick", pick).withColumn("node", F.xxhash64(address("url"))).withColumn("node", F.when(F.col("host") != "", F.col("node")))
    )
    links = link_edges(pages)
    if redirects is not None:
        links = links.union(redirects.select("source", "target"))
    edges = links.withColumn("u", address("source")).withColumn("v", address("target")).where("u is not null and v is not null")
    roots = connected_components(edges.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")), work)
    grouped = judged.join(roots, "node", "left").withColumn("alias", F.coalesce("root", "node"))
    voices = grouped.where("pick is not null and alias is not null").groupBy("alias").agg(
        F.max(F.col("pick.verdict") == "allow").alias("allowed"), F.max(F.col("pick.verdict") == "block").alias("blocked")
    )
    both = grouped.join(voices, "alias", "left")
    spread = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    reason = F.when(F.col("pick").isNotNull(), "rule").when(F.col("allowed").isNotNull(), "alias").otherwise("default")
    return both.select("page_id", "host", "path", F.col("pick.rule").alias("rule"), F.coalesce("pick.verdict", spread).alias("verdict"), reason.alias("reason"))
