"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.distinctive import distinctive_terms, shared_by_few
from ravelin.llm.encoding import decode_corpus, encode_corpus
from ravelin.llm.leakage import leak_spans, leaked_items
from ravelin.llm.near_dup import NearDuplicates
from ravelin.llm.quality import not_prose, text_statistics
from ravelin.llm.spam import spam_pages, spam_share
from ravelin.llm.sql import oracle_sql  # noqa: F401
from ravelin.llm.term_counts import mark_extremes, term_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_term_counts(spark, sf_dir).filter(F.col("mark").isNotNull()).select("term", "mark")


def p1_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_extremes(term_counts(_table(spark, sf_dir, "terms")), _table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_by_few(_distinctive(spark, sf_dir)).select("doc_id", "term")


def p2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinctive(spark, sf_dir).select("doc_id", "term", "tf", "df", "length", F.round("weight", 6).alias("weight"))


def _distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(_table(spark, sf_dir, "terms"), _table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(_table(spark, sf_dir, "documents")).pairs()


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(_table(spark, sf_dir, "documents")).classes()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(p5_statistics(spark, sf_dir)).select("doc_id")


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(_table(spark, sf_dir, "documents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return decode_corpus(p6_ids(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(p8_scores(spark, sf_dir)).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_share(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_term_counts, p2_found, p2_weights, p4_found, p4_classes, p5_found, p5_statistics, p6_ids, p6_round_trip, p7_found, p7_spans, p8_found, p8_scores)}
