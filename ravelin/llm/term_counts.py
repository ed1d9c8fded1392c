"""How often every term occurs and in how many documents: a range-partitioned sort, then one run-length scan.

Pairs of term and document are placed by ranges of the *pair*, so a term that owns a third of all rows is spread over as
many partitions as its rows fill, and equal pairs still meet in one partition. Each partition is sorted externally and
scanned once, keeping nothing but the last row seen. A term cut by a range boundary gives one partial count per side,
which add up because no pair lies on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.postings import clean_postings

#: A term is too rare to help a search in at most so many documents, too common in at least this percentage of them.
RARE_DOCS = 2
COMMON_PERCENT = 55

_NO_SEG = -(2**31)
_PARTIAL = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("docs", pa.int64())])


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of sorted postings. A run of equal (term, doc_id, seg) counts once; its first row has the largest freq."""
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        term = batch.column("term").cast(pa.large_string())
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        seg = pc.fill_null(batch.column("seg"), _NO_SEG).to_numpy(zero_copy_only=False)
        freq = batch.column("freq").to_numpy(zero_copy_only=False)
        new_term, new_doc, new_block = (np.ones(n, bool) for _ in range(3))
        new_term[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        new_doc[1:] = new_term[1:] | (doc[1:] != doc[:-1])
        new_block[1:] = new_doc[1:] | (seg[1:] != seg[:-1])
        if last is not None and term[0].as_py() == last[0]:  # the run goes on from the batch before
            new_doc[0] = doc[0] != last[1]
            new_block[0] = new_doc[0] or seg[0] != last[2]
        last = (term[n - 1].as_py(), doc[n - 1], seg[n - 1])
        starts = np.flatnonzero(new_term)
        yield pa.record_batch(
            [
                term.take(pa.array(starts)).cast(pa.string()),
                pa.array(np.add.reduceat(np.where(new_block, freq, 0), starts)),
                pa.array(np.add.reduceat(new_doc.astype(np.int64), starts)),
            ],
            schema=_PARTIAL,
        )


def term_counts(terms: DataFrame) -> DataFrame:
    """``term``, ``occurrences``, ``docs``: exact counts for every distinct term of postings ``terms``.

    Terms are compared in canonical form; repeated deliveries of a block count once; null and blank terms and rows
    without a document are no postings (see ``clean_postings``). An empty table gives no rows. Extra columns are ignored.
    """
    pairs = clean_postings(terms).repartitionByRange("term", "doc_id")
    runs = pairs.sortWithinPartitions("term", "doc_id", "seg", F.desc("freq"))
    partial = runs.mapInArrow(_scan_runs, "term string, occurrences long, docs long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("docs"))


def mark_extremes(counts: DataFrame, documents: DataFrame, rare_docs: int = RARE_DOCS, common_percent: int = COMMON_PERCENT) -> DataFrame:
    """Adds ``mark``: ``rare``, ``common`` or null. All rows of ``documents`` count. In a tiny collection ``rare`` goes first."""
    n = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    mark = F.when(F.col("docs") <= rare_docs, "rare").when(F.col("docs") * 100 >= n * common_percent, "common")
    return counts.withColumn("mark", mark)
