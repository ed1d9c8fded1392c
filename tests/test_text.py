"""Normalisation, tokens and stems against hand-made vectors and an independent model."""

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions.text import canonical_term, collapse_spaces, normalize_text, stem, tokens, trim_spaces
from ravelin.operators.indexer import token_count

STEMS = """playing play,connecting connect,running run,falling fal,freeing fre,meetings meeting,meeting meet,seeing seeing,
being being,string string,king king,sing sing,ñing ñing,played play,stopped stop,agreed agre,need need,speed speed,flies fly,
cities city,series sery,ties ties,books book,buses buse,übers über,cats cats,bus bus,was was,glass glass,process process,
éééing ééé""".replace("\n", "")
TOKENS = [
    ("Don't stop_running, PLAYED!", "don t stop run play"),
    ("C++ & C#", "c c"),
    ("x² 3.14 Ⅷ", "x² 3 14 ⅷ"),
    ("café tée", "cafe te e"),
    ("Übers naïve", "über naïve"),
    ("東京 tower", "東京 tower"),
    ("İSTANBUL ΟΔΟΣ", "istanbul οδοσ"),
    ("   ", ""),
    ("--- ?", ""),
    ("", ""),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_stems(spark):
    pairs = [p.strip().split(" ") for p in STEMS.split(",")]
    rows = spark.createDataFrame([(a, b) for a, b in pairs], "word string, want string")
    assert [(r.word, r.got) for r in rows.select("word", "want", stem(F.col("word")).alias("got")).filter("got != want").collect()] == []


@pytest.mark.parametrize(("text", "want"), TOKENS)
def test_tokens(spark, text, want):
    assert one(spark, text, tokens) == want.split()


def test_nulls_stay_null(spark):
    for f in (normalize_text, stem, tokens, canonical_term, collapse_spaces, trim_spaces):
        assert one(spark, None, f) is None


def test_canonical_terms(spark):
    assert one(spark, " \tThe\t ", canonical_term) == "the"
    assert one(spark, "\nx", canonical_term) == "\nx"  # only spaces and tabs


def test_unicode_spaces(spark):
    assert one(spark, "　a   b\u0085", collapse_spaces) == "a b"
    assert one(spark, "　a b ", trim_spaces) == "a b"


def model(text):
    low = "".join({"İ": "i", "Σ": "σ"}.get(c, c.lower()) for c in text)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", low).strip()


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=30))
def test_model(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    norm = normalize_text(F.col("v"))
    got = {r.i: (r.norm, r.n) for r in rows.select("i", norm.alias("norm"), token_count(norm).alias("n")).collect()}
    assert got == {i: (model(t), len(model(t).split())) for i, t in enumerate(texts)}
