"""Snippets, wrapping and truncation, as columns and on the driver."""

import pytest
from pyspark.sql import functions as F

from ravelin.cli import render, truncate, wrap
from ravelin.functions.formatting import snippet, truncate_lines, wrap_text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]




@pytest.mark.parametrize(("text", "width", "want"), [("aaa bb cccc", 6, "aaa bb\ncccc"), ("toolongword x", 4, "toolongword\nx"), ("a  b\tc", 0, "a  b\tc"),
                                                     ("éé é", 4, "éé\né"), ("éé é", 7, "éé é"), ("", 5, ""), ("  ", 5, "")])
def test_wrap(spark, text, width, want):
    assert one(spark, text, lambda v: wrap_text(v, width)) == want
    assert wrap(text, width) == want


@pytest.mark.parametrize(("text", "lines", "want"), [("a\nb\nc", 2, "a\nb..."), ("a\n  \nc", 2, "a\n..."), ("a\nb", 2, "a\nb"), ("a\nb", 0, ""), ("a\nb", 1, "a...")])
def test_truncate(spark, text, lines, want):
    assert one(spark, text, lambda v: truncate_lines(v, lines)) == want
    assert truncate(text, lines) == want


def test_snippets(spark):
    assert one(spark, " a \n b ", snippet) == "a b"
    assert one(spark, "x" * 500, snippet) == "x" * 500
    assert one(spark, "x" * 501, snippet) == "x" * 500 + "..."
    assert one(spark, "x" * 499 + "éy", snippet) == "x" * 499 + "�..."
    assert one(spark, "x" * 600, lambda v: snippet(v, 0)) == "x" * 600
    assert one(spark, None, snippet) == ""


def test_render():
    rows = [{"rank": 1, "title": "T", "url": "u", "score": 0.5, "snippet": "a b"}]
    assert render(rows, "q", 1, 1) == '\nTop 1 results for query: "q"\n\n1) T\n   URL: u\n   Score: 0.500000\n   a...\n'
    assert render([], "q", 1, 1) == "No results found"
