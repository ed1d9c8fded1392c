"""The arithmetic of BM25 as Column expressions, in double precision throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def idf(df: Column, total_docs: Column) -> Column:
    """``ln(1 + (N - df + 0.5) / (df + 0.5))``; 0 where ``df`` or ``N`` isn't positive or is null."""
    d, n = df.cast("double"), total_docs.cast("double")
    return F.when((d > 0) & (n > 0), F.log(F.lit(1.0) + ((n - d) + F.lit(0.5)) / (d + F.lit(0.5)))).otherwise(F.lit(0.0))


def tf_norm(tf: Column, length: Column, avg_length: Column, k1: float = K1, b: float = B) -> Column:
    """Saturated term frequency of a document of ``length`` terms; 0 where any input isn't positive or is null."""
    t, dl, avg = tf.cast("double"), length.cast("double"), avg_length.cast("double")
    scale = F.lit(1.0 - b) + F.lit(b) * (dl / F.when(avg > 0, avg))
    return F.when((t > 0) & (dl > 0) & (avg > 0), (t * F.lit(k1 + 1.0)) / (t + F.lit(k1) * scale)).otherwise(F.lit(0.0))


def ordered_sum(pos: Column, weight: Column) -> Column:
    """Aggregate: the weights of a group added from left to right by ``pos``, so that equal inputs give equal doubles."""
    by_pos = F.array_sort(F.collect_list(F.struct(pos.alias("pos"), weight.alias("w"))))
    return F.aggregate(F.transform(by_pos, lambda x: x["w"]), F.lit(0.0), lambda total, w: total + w)
