"""Postings as delivered: block rows, repeats and spelling variants turned into one row per term and document.

Input columns: ``term``, ``doc_id``, ``seg``, ``freq``; further columns are ignored. Rows with a null term, a term that is
blank after trimming, or a null ``doc_id`` are no postings. A null ``seg`` counts as a block of its own, a null ``freq``
as 0. Repeated deliveries of one (term, doc_id, seg) count once, with the largest ``freq`` where they disagree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.text import canonical_term


def clean_postings(terms: DataFrame) -> DataFrame:
    """``term``, ``doc_id``, ``seg``, ``freq`` with the term in its canonical form; repeats are still there."""
    rows = terms.select(
        canonical_term(F.col("term")).alias("term"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("seg").cast("int").alias("seg"),
        F.coalesce(F.col("freq").cast("long"), F.lit(0).cast("long")).alias("freq"),
    )
    return rows.filter((F.col("term") != "") & F.col("doc_id").isNotNull())


def merge_blocks(postings: DataFrame) -> DataFrame:
    """One row per (term, doc_id) with ``tf``, the occurrences over its distinct blocks.

    Partitioned once by (term, doc_id), which serves both levels of aggregation and splits frequent terms over all
    partitions.
    """
    placed = postings.repartition("term", "doc_id")
    blocks = placed.groupBy("term", "doc_id", "seg").agg(F.max("freq").alias("freq"))
    return blocks.groupBy("term", "doc_id").agg(F.sum("freq").alias("tf"))
