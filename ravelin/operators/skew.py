"""Per-key results where a few keys own most rows: eager aggregation on both sides of a join, then a roll-up.

No step puts the rows of one key into one task. Rows are first reduced to compact states by (key, record), which spreads
a hot key by its records; states of a key meet only after each partition has kept its own best few.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_shares(rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``rows``, ``all_rows``: rows of each key as stored, and of the input (rows without a key included)."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.count(F.lit(1)).alias("all_rows")).scalar()  # reads no column
    return counts.filter(F.col(key).isNotNull()).withColumn("all_rows", total)


def hot_keys(rows: DataFrame, key: str, min_share_percent: int) -> DataFrame:
    """Keys to which at least ``min_share_percent`` per cent of all rows belong; never more than 100 / that rows.

    An empty input has no hot keys. The key column can't be named ``rows`` or ``all_rows``.
    """
    if not 0 < min_share_percent <= 100:
        raise ValueError("min_share_percent must be in 1..100")
    return key_shares(rows, key).filter(F.col("rows") * 100 >= F.col("all_rows") * min_share_percent).select(key, "rows")


def join_states(rows: DataFrame, states: DataFrame, key: str, how: str = "inner", hot_percent: int = 1) -> DataFrame:
    """Join ``rows`` with ``states``, which has at most one row per key, without gathering the rows of a hot key.

    Keys with at least ``hot_percent`` per cent of the rows (no more than 100 / ``hot_percent``) have their states
    broadcast to where the rows are; the rest is shuffled and has no key above that share. Which keys these are is counted
    first, and without any there is one plain join. ``rows`` should be stored, as it is read for the count and again.
    ``how`` is ``inner`` or ``left``; rows with a null key match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if how == "inner":
        rows = rows.filter(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all")).scalar()
    frequent = counts.filter(F.col("_n") * 100 >= total * hot_percent).select(key).collect()
    if not frequent:
        return rows.join(states, key, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame([r for r in frequent if r[0] is not None], rows.select(key).schema))
    known = rows.filter(F.col(key).isNotNull())
    there = known.join(hot, key, "left_semi").join(F.broadcast(states.join(hot, key, "left_semi")), key, how)
    others = known.join(hot, key, "left_anti").join(states, key, how)
    result = there.unionByName(others)
    if how == "left":
        added = [f for f in states.schema.fields if f.name != key]
        result = result.unionByName(rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added]))
    return result


def top_records(states: DataFrame, key: str, record: str, value: str, k: int, salts: int = 64) -> DataFrame:
    """``key``, ``record``, ``value``, ``rank``: the ``k`` records of each key with the largest ``value``, on ties the smaller ``record``.

    ``states`` has one row per (key, record); its other columns don't pass. ``rank`` counts from 1. A key's records are ranked in ``salts`` groups first, so the last ranking
    sees at most ``salts * k`` rows of a key, however many it has. Null values rank last.
    """
    order = (F.col(value).desc_nulls_last(), F.col(record).asc())
    salted = states.select(key, record, value).withColumn("_salt", F.pmod(F.xxhash64(record), F.lit(salts)))
    partial = salted.withColumn("rank", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    final = partial.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return final.filter(F.col("rank") <= k).drop("_salt")


def eager_join_aggregate(left: DataFrame, right: DataFrame, key: str, left_sums: Mapping[str, str], right_sums: Mapping[str, str]) -> DataFrame:
    """Sums over the inner join of ``left`` and ``right`` on ``key``, without forming the join's rows.

    Both inputs are reduced by key before they meet: with counts ``l`` and ``r`` of a key, the join has ``l * r`` rows, a
    sum over a left column is that column's own sum times ``r``, and the reverse. ``left_sums`` and ``right_sums`` map
    result names to columns. Result: ``key``, ``pairs`` and the named sums; null keys join nothing; null values add 0.
    """

    if len({key, "pairs", *left_sums, *right_sums}) < 2 + len(left_sums) + len(right_sums):
        raise ValueError("names of results must differ")

    def state(rows: DataFrame, sums: Mapping[str, str], n: str) -> DataFrame:
        sums_of = [F.coalesce(F.sum(column), F.lit(0)).alias(f"_{n}_{name}") for name, column in sums.items()]
        return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n), *sums_of)

    joined = state(left, left_sums, "_l").join(state(right, right_sums, "_r"), key)
    return joined.select(
        key,
        (F.col("_l") * F.col("_r")).alias("pairs"),
        *[(F.col(f"__l_{name}") * F.col("_r")).alias(name) for name in left_sums],
        *[(F.col(f"__r_{name}") * F.col("_l")).alias(name) for name in right_sums],
    )


def top_records_of_hot_keys(stored: DataFrame, states_of: Callable[[DataFrame], DataFrame], key: str, record: str, value: str, k: int, min_share_percent: int) -> DataFrame:
    """The ``k`` best records of every key with at least ``min_share_percent`` per cent of the stored rows.

    Two compact states meet after both are aggregated: rows per key (at most 100 / ``min_share_percent`` of them pass, so
    that side is broadcast) and, from ``states_of(stored)``, one row per (key, record) of every key.
    """
    hot = hot_keys(stored, key, min_share_percent).select(key)
    # an inner join, as the optimizer would move a semi-join below the aggregation
    return top_records(states_of(stored).join(F.broadcast(hot), key), key, record, value, k)
