"""Validation of queries, one at a time and as a table."""

import pytest
from pyspark.sql import functions as F

from ravelin.operators.parsing import (
    EmptyQuery,
    InvalidUTF8,
    QueryTooLong,
    TooManyTerms,
    parse_queries,
    parse_query,
)

BAD = [(b"\xff", InvalidUTF8), ("", EmptyQuery), ("  　", EmptyQuery), ("?!", EmptyQuery), ("a" * 4097, QueryTooLong), (" ".join(f"w{i}" for i in range(65)), TooManyTerms)]
GOOD = [("  " + "a" * 4096 + " ", ("a" * 4096,)), ("same " * 100, ("same",)), ("Dogs dogs RUN", ("dogs", "run")), ("runs running run", ("runs", "run")), ("x² café", ("x²", "café"))]


@pytest.mark.parametrize(("raw", "error"), BAD)
def test_refused(raw, error):
    with pytest.raises(error):
        parse_query(raw)


@pytest.mark.parametrize(("raw", "terms"), GOOD)
def test_parsed(raw, terms):
    assert parse_query(raw).terms == terms


def test_table(spark):
    names = {EmptyQuery: "empty", QueryTooLong: "too_long", TooManyTerms: "too_many_terms"}
    rows = [(i, raw, names[e], None) for i, (raw, e) in enumerate(BAD) if isinstance(raw, str)]
    rows += [(100 + i, raw, "ok", list(t)) for i, (raw, t) in enumerate(GOOD)] + [(999, None, "empty", None)]
    table = spark.createDataFrame(rows, "qid long, raw string, want string, terms array<string>")
    got = {r.qid: (r.status, r.terms) for r in parse_queries(table).collect()}
    assert got == {qid: (want, terms) for qid, _, want, terms in rows}


def test_invalid_bytes_in_a_table(spark):
    rows = spark.createDataFrame([(1, bytearray(b"ab\xff"))], "qid long, b binary").select("qid", F.col("b").cast("string").alias("raw"))
    assert parse_queries(rows).first().status == "invalid_utf8"
