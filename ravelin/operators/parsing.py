"""Validation and analysis of raw queries, one at a time on the driver or a table of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.text import tokens, trim_spaces

MAX_QUERY_BYTES = 4096
MAX_QUERY_TERMS = 64


class QueryError(ValueError):
    """A query or request that can't be answered."""


class InvalidUTF8(QueryError):
    pass


class EmptyQuery(QueryError):
    pass


class QueryTooLong(QueryError):
    pass


class TooManyTerms(QueryError):
    pass


class InvalidTopK(QueryError):
    pass


class EngineInit(QueryError):
    pass


@dataclass(frozen=True)
class ParsedQuery:
    raw: str
    terms: tuple[str, ...]


def _words(text: str) -> list[str]:
    low = "".join({"İ": "i", "Σ": "σ"}.get(c, c.lower()) for c in text)
    # letters and numbers only: marks and connectors split words
    return "".join(c if c.isalpha() or c.isnumeric() else " " for c in low).split()


def _stem(token: str) -> str:
    def undouble(stem: str) -> str:
        return stem[:-1] if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1].isascii() else stem

    size = len(token.encode())
    if size <= 3:
        return token
    if token.endswith("ing") and size > 6:
        return undouble(token[:-3])
    if token.endswith("ed") and size > 5:
        return undouble(token[:-2])
    if token.endswith("ies") and size > 4:
        return token[:-3] + "y"
    if token.endswith("s") and not token.endswith("ss") and size > 4:
        return token[:-1]
    return token


def parse_query(raw: str | bytes) -> ParsedQuery:
    """Check a query and give its distinct stemmed words in order of first appearance; raises a ``QueryError``."""
    if isinstance(raw, bytes):
        try:
            raw = raw.decode("utf-8")
        except UnicodeDecodeError:
            raise InvalidUTF8("the query isn't valid UTF-8") from None
    trimmed = raw.strip()
    if not trimmed:
        raise EmptyQuery("the query is empty")
    if len(trimmed.encode()) > MAX_QUERY_BYTES:
        raise QueryTooLong(f"the query has more than {MAX_QUERY_BYTES} bytes")
    terms = tuple(dict.fromkeys(_stem(w) for w in _words(trimmed)))
    if not terms:
        raise EmptyQuery("the query has no words")
    if len(terms) > MAX_QUERY_TERMS:
        raise TooManyTerms(f"the query has more than {MAX_QUERY_TERMS} distinct terms")
    return ParsedQuery(trimmed, terms)


def query_terms(raw: Column) -> Column:
    """Distinct stemmed words in order of first appearance."""
    return F.array_distinct(tokens(raw))


def parse_queries(queries: DataFrame) -> DataFrame:
    """``qid``, ``raw`` (trimmed), ``terms`` (null unless ok), ``status``: ``ok``, ``empty``, ``too_long``, ``invalid_utf8`` or ``too_many_terms``.

    Null queries are empty. Extra columns are dropped.
    """
    valid = queries.select("qid", F.col("raw").alias("_raw"), trim_spaces(F.col("raw")).alias("raw"))
    with_terms = valid.withColumn("_terms", query_terms(F.col("raw")))
    status = (
        F.when(F.col("_raw").isNotNull() & ~F.is_valid_utf8("_raw"), "invalid_utf8")
        .when(F.coalesce(F.col("raw"), F.lit("")) == "", "empty")
        .when(F.octet_length("raw") > MAX_QUERY_BYTES, "too_long")
        .when(F.size("_terms") == 0, "empty")
        .when(F.size("_terms") > MAX_QUERY_TERMS, "too_many_terms")
        .otherwise("ok")
    )
    return with_terms.withColumn("status", status).select("qid", "raw", F.when(F.col("status") == "ok", F.col("_terms")).alias("terms"), "status")
