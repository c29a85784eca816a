"""Tokens: NFKC and case folding, then maximal runs of letters and digits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, marks excluded, and numbers: what remains of ``\w`` without the underscore.
TOKEN = r"[\p{L}\p{N}]+"
_TOKENS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("position", "start", "end")]]))
_PYTHON_TOKEN = re.compile(r"[^\W_]+")


def normalize(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def terms(text: str) -> list[str]:
    return _PYTHON_TOKEN.findall(normalize(text))


def analyze(text: str) -> list[tuple[str, int, int, int]]:
    """``(term, position, start, end)``; offsets are of the normalised text."""
    return [(m[0], i, m.start(), m.end()) for i, m in enumerate(_PYTHON_TOKEN.finditer(normalize(text)))]


@F.pandas_udf(T.StringType())
def nfkc_casefold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(lambda x: None if x is None else normalize(x))


@F.pandas_udf(_TOKENS)
def token_offsets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(lambda x: [dict(zip(("term", "position", "start", "end"), t)) for t in analyze(x or "")])


def simple_fold(column: Column) -> Column:
    """JVM-side folding, equal to NFKC and case folding for texts whose only special letter is the sharp s."""
    return F.replace(F.lower(column), F.lit("ß"), F.lit("ss"))


def term_array(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(TOKEN), 0)


def protected(term: str) -> bool:
    """Terms with a digit and overlong terms are never respelled."""
    return len(term) > 64 or any(c.isdigit() for c in term)


def bigrams(column: Column) -> Column:
    padded = F.concat(F.lit("^"), column, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
