"""How characteristic each term is of its document: a parsimonious language model per document.

A document's occurrences are a mixture of its own model and the background model of the whole collection. Expectation
maximisation moves the mass that the background explains out of the document's model; what stays, when it has converged,
ranks its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.postings import clean_postings, merge_blocks
from ravelin.operators.skew import hot_keys
from ravelin.session import written

#: Weight of the document's own model in the mixture.
OWN_WEIGHT = 0.1
#: A model has converged when a step of expectation-maximisation moves no probability by more.
TOLERANCE = 1e-9
#: Terms with at least 1 % of the rows, one per term and document: never more than 100, so their statistics may be broadcast.
HOT_PERCENT = 1
#: Documents are handled together up to so many rows; one document is never divided.
CHUNK_ROWS = 200_000

_TINY = 1e-300
_OUT = pa.schema([("doc_id", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64()), ("length", pa.int64()), ("weight", pa.float64()), ("rank", pa.int32())])


def em_step(p: np.ndarray, tf: np.ndarray, background: np.ndarray, group: np.ndarray, groups: int, own_weight: float = OWN_WEIGHT) -> np.ndarray:
    """One step of expectation-maximisation: what each term's occurrences owe to the document's own model, as a distribution."""
    mass = own_weight * p
    share = tf * mass / np.maximum(mass + (1 - own_weight) * background, _TINY)
    return share / np.maximum(np.bincount(group, share, groups), _TINY)[group]


def own_model(tf: np.ndarray, background: np.ndarray, starts: np.ndarray, own_weight: float = OWN_WEIGHT, tolerance: float = TOLERANCE) -> np.ndarray:
    """Converged term probabilities of several documents at once; ``starts`` has the first row of each.

    Plain steps creep towards their limit where a term's mass goes to zero, so each round jumps: among the terms that
    still have mass, the limit must have ``p = c tf - r background`` with ``r`` the odds of the background and ``c`` such
    that the sum is 1; terms for which that is negative have no mass in the limit and leave, after which ``c`` can only
    fall, so none comes back. A document ends when no term leaves, after no more rounds than it has terms and mostly fewer
    than ten. The result is a point that ``em_step`` doesn't move, which is checked. Each document ends on its own, so the
    result doesn't depend on what it is handled with.
    """
    sizes = np.diff(np.append(starts, len(tf)))
    n = len(starts)
    group = np.repeat(np.arange(n), sizes)
    odds = (1 - own_weight) / own_weight
    active = np.arange(len(tf))
    p = np.zeros(len(tf))
    while len(active):
        g = group[active]
        c = (1 + odds * np.bincount(g, background[active], n)) / np.maximum(np.bincount(g, tf[active], n), _TINY)
        limit = c[g] * tf[active] - odds * background[active]
        leaves = limit <= 0
        still = np.zeros(n, bool)
        still[g[leaves]] = True
        done = ~still[g]
        p[active[done]] = limit[done]
        active = active[~done & ~leaves]
    moved = np.abs(em_step(p, tf, background, group, n, own_weight) - p)
    if moved.size and moved.max() > tolerance:
        raise ArithmeticError(f"a model moves by {moved.max()} after its end")
    return p


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc_id, term nulls first); the row without a term has the document's length."""

    def fitted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc = table.column("doc_id").to_numpy()
        no_term = table.column("term").is_null().to_numpy()
        bounds = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ids = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(doc))))
        length = table.column("length").to_numpy()
        longest = np.full(len(bounds), -1, np.int64)
        np.maximum.at(longest, ids[no_term], length[no_term])
        rows = np.flatnonzero(~no_term)
        if len(rows) == 0:
            return
        group = ids[rows]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sub = table.take(pa.array(rows)).combine_chunks()
        weight = own_model(sub.column("tf").to_numpy().astype(float), sub.column("background").to_numpy(), starts)
        order = np.lexsort((-weight, group))  # stable: ties stay in the order of terms
        rank = np.empty(len(rows), np.int32)
        rank[order] = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) + 1
        known = longest[group]
        out = [sub.column("doc_id"), sub.column("term"), sub.column("tf"), sub.column("df"), pa.array(known, mask=known < 0), pa.array(weight), pa.array(rank)]
        yield from pa.table(out, schema=_OUT).to_batches(50_000)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK_ROWS:
            table = pa.Table.from_batches(held)
            doc = table.column("doc_id").to_numpy()
            cut = int(np.searchsorted(doc, doc[-1]))  # the last document may go on
            if cut:
                yield from fitted(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
    if held:
        yield from fitted(pa.Table.from_batches(held))


def distinctive_terms(terms: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id``, ``term``, ``tf``, ``df``, ``length``, ``weight``, ``rank`` of every term of every document.

    ``weight`` is the term's probability in the document's own model and ``rank`` its place by weight, ties in the order
    of terms. The background probability is the term's occurrences in the collection over the sum of
    ``documents.length``, at most 1. ``length`` is null for documents that ``documents`` doesn't have; with repeated
    document rows the largest counts. Postings are cleaned as in ``clean_postings``; empty tables give no rows.
    """
    counts = written(merge_blocks(clean_postings(terms)))  # read four times
    words = documents.agg(F.greatest(F.sum("length"), F.lit(1)).alias("words")).scalar()
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.least(F.lit(1.0), F.sum("tf") / words).alias("background"))
    hot = F.broadcast(hot_keys(counts, "term", HOT_PERCENT).select("term"))
    frequent = counts.join(F.broadcast(stats.join(hot, "term", "left_semi")), "term")  # stays where it is
    others = counts.join(hot, "term", "left_anti").join(stats.join(hot, "term", "left_anti"), "term")
    columns = ["doc_id", "term", "tf", "df", "background"]
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in zip(columns[1:], ("string", "long", "long", "double"), strict=True)]
    lengths = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *nothing, F.coalesce(F.col("length").cast("long"), F.lit(0).cast("long")).alias("length"))
    no_length = F.lit(None).cast("long").alias("length")
    rows = frequent.select(*columns, no_length).unionByName(others.select(*columns, no_length)).unionByName(lengths)
    placed = rows.repartition("doc_id").sortWithinPartitions("doc_id", "term")
    return placed.mapInArrow(_fit, "doc_id long, term string, tf long, df long, length long, weight double, rank int")


def shared_by_few(scored: DataFrame, min_df: int = 2, max_df: int = 10, min_tf: int = 3, min_percent: int = 2) -> DataFrame:
    """Scored terms that few other documents share and that make up at least ``min_percent`` per cent of their document."""
    return scored.filter(
        F.col("df").between(min_df, max_df) & (F.col("tf") >= min_tf) & (F.col("tf") * 100 >= F.col("length") * min_percent)
    )
