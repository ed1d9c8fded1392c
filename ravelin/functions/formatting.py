"""Snippets, wrapping and truncation of output text. Widths are in bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.text import collapse_spaces

SNIPPET_BYTES = 500


def snippet(body: Column, max_bytes: int = SNIPPET_BYTES) -> Column:
    """The first ``max_bytes`` bytes of the text with single spaces, and ``...`` if something was cut; 0 or less: no limit.

    A character cut in the middle becomes U+FFFD. Null gives an empty text.
    """
    text = F.coalesce(collapse_spaces(body), F.lit(""))
    if max_bytes <= 0:
        return text
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, max_bytes).cast("string"))
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.concat(head, F.lit("...")))


def wrap_text(text: Column, width: int) -> Column:
    """Fill lines of at most ``width`` bytes with whole words; longer words stay whole; 0 or less: unchanged."""
    if width <= 0:
        return text
    words = F.filter(F.split(collapse_spaces(text), " "), lambda w: w != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(state: Column, word: Column) -> Column:
        size = F.octet_length(word)
        first, breaks = state["n"] == 0, state["n"] + 1 + size > width
        out = F.concat(state["out"], F.when(first, F.lit("")).when(breaks, F.lit("\n")).otherwise(F.lit(" ")), word)
        return F.struct(out.alias("out"), F.when(first | breaks, size).otherwise(state["n"] + 1 + size).alias("n"))

    return F.aggregate(words, start, put, lambda state: state["out"])


def truncate_lines(text: Column, max_lines: int) -> Column:
    """The first ``max_lines`` lines; the last one, trimmed, gets ``...`` if lines were dropped; 0 or less: empty."""
    if max_lines <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    lines = F.split(text, "\n")
    last = F.regexp_replace(F.get(lines, F.lit(max_lines - 1)), r"(?U)^\s+|\s+$", "")
    cut = F.concat(F.slice(lines, 1, max_lines - 1), F.array(F.concat(last, F.lit("..."))))
    return F.when(F.size(lines) <= max_lines, text).otherwise(F.array_join(cut, "\n"))
