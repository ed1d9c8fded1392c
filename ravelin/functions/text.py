"""Text normalisation, tokenisation and stemming as Column expressions.

Everything here is built from JVM-side functions. Null input gives null, empty input gives an empty string or array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space; ``trim`` alone strips U+0020 only.
SPACES = r"(?U)\s+"
WORD_GAP = r"[^\p{L}\p{N}]+"


def lower_runes(text: Column) -> Column:
    """Lower-case one character at a time: the dotted capital I becomes ``i`` and the capital sigma ``σ``, whatever follows."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def trim_spaces(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def canonical_term(term: Column) -> Column:
    """A written form of a term without spaces and tabs at its ends, in lower case."""
    return lower_runes(F.trim(term, F.lit(" \t")))


def normalize_text(text: Column) -> Column:
    """Lower case, every run of characters that are neither letters nor numbers becomes one space."""
    return F.trim(F.regexp_replace(lower_runes(text), WORD_GAP, " "))


def words(text: Column) -> Column:
    """The words of a text in order, before stemming; an empty array for wordless text."""
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def _undouble(stem: Column) -> Column:
    last = F.substring(stem, -1, 1)
    doubled = (F.char_length(stem) >= 2) & (last == F.substring(stem, -2, 1)) & (F.octet_length(last) == 1)
    return F.when(doubled, _drop(stem, 1)).otherwise(stem)


def _drop(token: Column, n: int) -> Column:
    return token.substr(F.lit(1), F.char_length(token) - n)


def stem(token: Column) -> Column:
    """Strip one English suffix of a lower-case word; lengths are in bytes. Not idempotent: apply it once.

    A stem that ends in a doubled ASCII character after ``ing`` or ``ed`` loses one of the two.
    """
    size = F.octet_length(token)
    return (
        F.when(size <= 3, token)
        .when(token.endswith("ing") & (size > 6), _undouble(_drop(token, 3)))
        .when(token.endswith("ed") & (size > 5), _undouble(_drop(token, 2)))
        .when(token.endswith("ies") & (size > 4), F.concat(_drop(token, 3), F.lit("y")))
        .when(token.endswith("s") & ~token.endswith("ss") & (size > 4), _drop(token, 1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """The stemmed words of a text in order, repeats kept."""
    return F.filter(F.transform(words(text), stem), lambda t: t != "")
