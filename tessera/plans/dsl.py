"""The query language: lexer, parser, AST, and its compilation to a boolean Column.

``NOT`` binds tighter than ``AND``, which binds tighter than ``OR``; adjacent clauses are AND-ed.
``field:value``, ``title:(...)``, ``rating:>=4`` and quoted phrases are clauses. A missing value makes
every predicate false and its negation true.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import SearchError
from tessera.functions.analyzer import normalize, terms
from tessera.operators import lexical
from tessera.sources.documents import KEYWORD_FIELDS, NUMERIC_FIELDS, TEXT_FIELDS

MAX_LEXEMES, MAX_DEPTH, MAX_TERMS = 200, 16, 64
_OPERATORS = {">=": "gte", "<=": "lte", ">": "gt", "<": "lt", "=": "eq"}
_SPECIAL = set('():"<>=')


@dataclass(frozen=True)
class Node:
    kind: str  # term, phrase, filter, scope, and, or, not
    value: object = None
    field: str | None = None
    op: str | None = None
    children: tuple[Node, ...] = ()

    def to_dict(self) -> dict:
        return asdict(self)


def _fail(message: str, at: int, code: str = "QUERY_SYNTAX_ERROR"):
    raise SearchError(code, message, start=at)


def lex(text: str) -> list[tuple[str, str, int]]:
    """``(kind, value, start)`` with kinds word, phrase, punct, comp, AND, OR, NOT and end."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c == '"':
            at, value = i + 1, []
            while at < len(text) and text[at] != '"':
                if text[at] == "\\":
                    at += 1
                    if at >= len(text) or text[at] not in '"\\':
                        _fail("only quotes and backslashes can be escaped", i)
                if ord(text[at]) < 32:
                    _fail("control character in a phrase", i)
                value.append(text[at])
                at += 1
            if at >= len(text):
                _fail("unclosed quote", i)
            out.append(("phrase", "".join(value), i))
            i = at + 1
        elif c in "():":
            out.append(("punct", c, i))
            i += 1
        elif c in "<>=":
            op = text[i : i + 2] if text[i : i + 2] in _OPERATORS else c
            out.append(("comp", op, i))
            i += len(op)
        else:
            at = i
            while at < len(text) and not text[at].isspace() and text[at] not in _SPECIAL:
                at += 1
            word = text[i:at]
            out.append((word if word in ("AND", "OR", "NOT") else "word", word, i))
            i = at
    if len(out) >= MAX_LEXEMES:
        _fail("too many lexemes", 0, "QUERY_TOO_COMPLEX")
    return [*out, ("end", "", len(text))]


def parse(text: str) -> Node:
    lexemes, at = lex(text), 0

    def peek(offset: int = 0) -> tuple[str, str, int]:
        return lexemes[min(at + offset, len(lexemes) - 1)]

    def punct(mark: str, offset: int = 0) -> bool:
        return peek(offset)[:2] == ("punct", mark)

    def advance() -> tuple[str, str, int]:
        nonlocal at
        at += 1
        return lexemes[at - 1]

    def joined(kind: str, parts: list[Node]) -> Node:
        return parts[0] if len(parts) == 1 else Node(kind, children=tuple(parts))

    def disjunction(field: str | None, depth: int) -> Node:
        parts = [conjunction(field, depth)]
        while peek()[0] == "OR":
            advance()
            parts.append(conjunction(field, depth))
        return joined("or", parts)

    def conjunction(field: str | None, depth: int) -> Node:
        parts = [negation(field, depth)]
        while peek()[0] not in ("OR", "end") and not punct(")"):
            if peek()[0] == "AND":
                advance()
            parts.append(negation(field, depth))
        return joined("and", parts)

    def negation(field: str | None, depth: int) -> Node:
        if depth > MAX_DEPTH:
            _fail("nested too deeply", peek()[2], "QUERY_TOO_COMPLEX")
        if peek()[0] == "NOT":
            advance()
            return Node("not", children=(negation(field, depth + 1),))
        return clause(field, depth)

    def group(field: str | None, depth: int) -> Node:
        advance()
        inner = disjunction(field, depth + 1)
        if not punct(")"):
            _fail("expected )", peek()[2])
        advance()
        return inner

    def clause(field: str | None, depth: int) -> Node:
        kind, value, start = peek()
        if punct("("):
            return group(field, depth)
        if kind not in ("word", "phrase"):
            _fail("expected a term, phrase, field or group", start)
        if kind == "word" and punct(":", 1):
            if field:
                _fail("fields cannot be nested", start)
            advance(), advance()
            return scoped(value, start, depth)
        advance()
        return text_clause(kind, value, start)

    def scoped(field: str, start: int, depth: int) -> Node:
        if field in TEXT_FIELDS:
            inner = group(field, depth) if punct("(") else plain(start)
            return Node("scope", field=field, children=(inner,))
        if field in KEYWORD_FIELDS:
            kind, value, at_value = advance()
            if kind not in ("word", "phrase"):
                _fail("expected a value", at_value)
            return Node("filter", value, field, "eq")
        if field in NUMERIC_FIELDS:
            op = _OPERATORS[advance()[1]] if peek()[0] == "comp" else "eq"
            kind, value, at_value = advance()
            try:
                number = float(value) if kind == "word" else math.nan
            except ValueError:
                number = math.nan
            if not math.isfinite(number):
                _fail("expected a finite number", at_value, "QUERY_TYPE_ERROR")
            return Node("filter", number, field, op)
        return _fail("unknown field", start, "QUERY_TYPE_ERROR")

    def plain(start: int) -> Node:
        kind, value, at_value = advance()
        if kind not in ("word", "phrase"):
            _fail("expected a term or phrase", at_value)
        return text_clause(kind, value, start)

    def text_clause(kind: str, value: str, start: int) -> Node:
        found = terms(value)
        if not found:
            _fail("no searchable text", start, "QUERY_TYPE_ERROR")
        if kind == "phrase":
            return Node("phrase", " ".join(found))
        return joined("and", [Node("term", t) for t in found])

    root = disjunction(None, 1)
    if peek()[0] != "end":
        _fail("unexpected token", peek()[2])
    return root


def positive_clauses(node: Node, field: str | None = None, positive: bool = True) -> list[tuple[str, str | None, bool]]:
    """``(value, field, is_phrase)`` of the text clauses under an even number of negations."""
    if node.kind in ("term", "phrase"):
        return [(node.value, field, node.kind == "phrase")] if positive else []
    return [c for child in node.children for c in positive_clauses(child, node.field if node.kind == "scope" else field, positive != (node.kind == "not"))]


def has_term(field: str, term: str) -> Column:
    return F.array_contains(f"{field}_terms", term)


def has_phrase(field: str, phrase: list[str]) -> Column:
    words, size = F.col(f"{field}_terms"), len(phrase)
    literal = F.array(*[F.lit(p) for p in phrase])
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    found = F.exists(starts, lambda i: F.slice(words, i, F.lit(size)) == literal)
    possible = F.size(words) >= size
    for p in dict.fromkeys(phrase):
        possible = possible & F.array_contains(words, p)
    return F.when(possible, found).otherwise(False)


def filter_predicate(field: str, op: str, value) -> Column:
    """Predicate over ``kind_n``, ``category_n``, ``tags_n`` (normalised) or a numeric column."""
    if field in NUMERIC_FIELDS:
        c, v = F.col(field), F.lit(float(value))
        out = {"eq": c == v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    else:
        values = [normalize(v) for v in (value if op == "in" else [value])]
        c = F.col(f"{field}_n")
        out = F.arrays_overlap(c, F.array(*[F.lit(v) for v in values])) if field == "tags" else c.isin(*values)
    return F.coalesce(out, F.lit(False))


def compile_node(node: Node, field: str | None = None, leaf: Callable[[str, str, str | None], Column] | None = None) -> Column:
    """A boolean column over documents; ``leaf(kind, value, field)`` gives the text clauses' columns, by default over term arrays."""
    if node.kind == "scope":
        return compile_node(node.children[0], node.field, leaf)
    if node.kind == "filter":
        return filter_predicate(node.field, node.op, node.value)
    if node.kind in ("term", "phrase") and leaf:
        return leaf(node.kind, node.value, field)
    if node.kind in ("term", "phrase"):
        test = (lambda f: has_term(f, node.value)) if node.kind == "term" else (lambda f: has_phrase(f, node.value.split(" ")))
        out = F.lit(False)
        for f in (field,) if field else TEXT_FIELDS:
            out = out | F.coalesce(test(f), F.lit(False))
        return out
    parts = [compile_node(c, field, leaf) for c in node.children]
    if node.kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.kind == "and" else out | p
    return out


def text_leaves(node: Node, field: str | None = None) -> list[tuple[str, str, str | None]]:
    """``(kind, value, field)`` of every text clause, once."""
    if node.kind in ("term", "phrase"):
        return [(node.kind, node.value, field)]
    return list(dict.fromkeys(x for c in node.children for x in text_leaves(c, node.field if node.kind == "scope" else field)))


def matching(docs: DataFrame, posted: DataFrame, node: Node, buckets: int) -> DataFrame:
    """The rows of ``docs`` that the query selects; text clauses are looked up in the postings of their own terms."""
    leaves = text_leaves(node)
    name = {x: f"_leaf{i}" for i, x in enumerate(leaves)}
    if leaves:
        hits = lexical.pruned(posted, [t for _, value, _ in leaves for t in value.split(" ")], buckets)
        inside = lambda field: F.col("field") == field if field else F.lit(True)
        plain = [F.when((F.col("term") == value) & inside(field), F.lit(i)) for i, (kind, value, field) in enumerate(leaves) if kind == "term"]
        found = [hits.select("id", F.explode(F.array_compact(F.array(*plain))).alias("leaf"))] if plain else []
        for i, (kind, value, field) in enumerate(leaves):
            if kind == "phrase":
                found.append(lexical.phrase_matches(hits, value.split(" "), (field,) if field else TEXT_FIELDS).select("id", F.lit(i).alias("leaf")))
        rows = functools.reduce(DataFrame.union, found)
        docs = docs.join(rows.groupBy("id").agg(*[F.max(F.col("leaf") == i).alias(name[x]) for i, x in enumerate(leaves)]), "id", "left")
    out = docs.where(compile_node(node, leaf=lambda *x: F.coalesce(F.col(name[x]), F.lit(False))))
    return out.drop(*name.values())


def estimate(node: Node, df: dict[str, int], live: int) -> int:
    """Upper estimate of how many documents match: the terms' document frequencies where these bound it, else all."""
    if node.kind in ("term", "phrase"):
        return min((df.get(t, 0) for t in node.value.split(" ")), default=live)
    if node.kind == "scope":
        return estimate(node.children[0], df, live)
    parts = [estimate(c, df, live) for c in node.children]
    return min(parts) if node.kind == "and" else min(live, sum(parts)) if node.kind == "or" else live


def plain_pieces(text: str) -> list[tuple[bool, list[str]]]:
    """Quoted and unquoted pieces of a plain query, as terms."""
    return [(piece.startswith('"'), terms(piece)) for piece in re.findall(r'"[^"]*"|[^"]+', text)]
