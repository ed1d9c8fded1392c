"""Fixed schemas of the engine's tables; nothing is ever inferred."""

from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


PAGES_IN = _struct(("ord", LongType(), False), ("url", StringType(), True), ("title", StringType(), True), ("body", StringType(), True))
DOCUMENTS = _struct(
    ("doc_id", LongType(), False),
    ("url", StringType(), False),
    ("title", StringType(), True),
    ("body", StringType(), True),
    ("length", LongType(), False),
    ("created_at", TimestampType(), True),
)
TERMS = _struct(("term", StringType(), False), ("doc_id", LongType(), False), ("freq", LongType(), False))
#: Terms as they are stored: with the length of the document, so that ranking needs no other table.
POSTINGS = _struct(("term", StringType(), False), ("doc_id", LongType(), False), ("freq", LongType(), False), ("dl", LongType(), True))
STATS = _struct(("id", IntegerType(), False), ("total_docs", LongType(), False), ("total_doc_len", LongType(), False), ("next_doc_id", LongType(), False))
OUTCOMES = _struct(("ord", LongType(), False), ("url", StringType(), True), ("doc_id", LongType(), True), ("status", StringType(), False))
WEB = _struct(("url", StringType(), False), ("status", IntegerType(), True), ("content_type", StringType(), True), ("html", StringType(), True))
PAGE_RESULT = _struct(
    ("url", StringType(), False),
    ("depth", IntegerType(), False),
    ("status", IntegerType(), True),
    ("bytes", LongType(), True),
    ("links", ArrayType(StringType()), True),
    ("title", StringType(), True),
    ("body", StringType(), True),
    ("err", StringType(), True),
)
CRAWL_STATS = _struct(
    ("scheduled", LongType(), False),
    ("successful", LongType(), False),
    ("failed", LongType(), False),
    ("total_bytes", LongType(), False),
    ("started_at", TimestampType(), True),
    ("finished_at", TimestampType(), True),
)
