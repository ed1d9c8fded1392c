"""Counts of terms and parsimonious weights against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm.distinctive import OWN_WEIGHT, distinctive_terms, em_step, own_model, shared_by_few
from ravelin.llm.term_counts import mark_extremes, term_counts

TERMS = "term string, doc_id long, seg int, freq long, docs int, mark string, occurrences string, length int, df int"
DOCS = "doc_id long, length long, term string, df int, tf int, weight int"


def tables(spark, rows, lengths):
    return spark.createDataFrame([(*r, 7, "m", "o", 1, 2) for r in rows], TERMS), spark.createDataFrame([(d, n, "t", 1, 2, 3) for d, n in lengths], DOCS)


def form(t):
    return t.strip(" \t").lower() if t is not None else ""


def merged(rows):
    blocks = {}
    for t, d, s, f in rows:
        if form(t) and d is not None:
            blocks[form(t), d, s] = max(blocks.get((form(t), d, s), 0), f or 0)
    tf = {}
    for (t, d, _), f in blocks.items():
        tf[t, d] = tf.get((t, d), 0) + f
    return tf


def sample(n, seed, docs=50):
    r = random.Random(seed)
    terms = ["hot", "Hot ", "\tHOT"] * 4 + [f"t{i}" for i in range(60)] + ["Éa", "éa ", None, "", "\t"]
    rows = [(r.choice(terms), r.choice([*range(docs), None]), r.choice([0, 1, 2, None]), r.choice([1, 2, 5, None])) for _ in range(n)]
    return rows + r.sample(rows, n // 3)


@pytest.mark.parametrize("seed", range(3))
def test_counts(spark, seed):
    rows = sample(1500, seed)
    terms, docs = tables(spark, rows, [(d, 1) for d in range(50)])
    want = {}
    for (t, _), f in merged(rows).items():
        o, d = want.get(t, (0, 0))
        want[t] = (o + f, d + 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # runs go on over batches
    try:
        counts = {r.term: (r.occurrences, r.docs) for r in term_counts(terms).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert counts == want
    marks = {r.term: r.mark for r in mark_extremes(term_counts(terms), docs).collect()}
    assert marks == {t: "rare" if d <= 2 else "common" if d * 100 >= 50 * 55 else None for t, (_, d) in want.items()}


def test_one_term_owns_everything(spark):
    rows = [("a", d, 0, 2) for d in range(4000)] * 2
    terms, docs = tables(spark, rows, [(d, 2) for d in range(4000)])
    assert [tuple(r) for r in mark_extremes(term_counts(terms), docs).collect()] == [("a", 8000, 4000, "common")]


def test_empty_tables(spark):
    terms, docs = tables(spark, [], [])
    assert mark_extremes(term_counts(terms), docs).count() == 0
    assert distinctive_terms(terms, docs).count() == 0
    terms, _ = tables(spark, [("a", 1, 0, 1)], [])
    assert [r.mark for r in mark_extremes(term_counts(terms), docs).collect()] == ["rare"]
    assert [(r.length, r.weight) for r in distinctive_terms(terms, docs).collect()] == [(None, 1.0)]


def plain_model(tf, background, rounds=500):
    p = tf / tf.sum()
    for _ in range(rounds):
        e = tf * OWN_WEIGHT * p / (OWN_WEIGHT * p + (1 - OWN_WEIGHT) * background)
        p = e / e.sum()
    return p


def test_model_of_many_equals_model_of_each():
    r = np.random.default_rng(3)
    sizes = [1, 7, 300, 2, 40]
    tf = r.integers(1, 30, sum(sizes)).astype(float)
    background = r.random(sum(sizes)) * 0.1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    together = own_model(tf, background, starts)
    for a, n in zip(starts, sizes, strict=True):
        np.testing.assert_array_equal(together[a : a + n], own_model(tf[a : a + n], background[a : a + n], np.array([0])))
        assert abs(together[a : a + n].sum() - 1) < 1e-9
    np.testing.assert_allclose(together[8:308], plain_model(tf[8:308], background[8:308], 5000), atol=5e-5)


@pytest.mark.parametrize("seed", range(5))
def test_model_is_the_limit_of_plain_steps(seed):
    r = np.random.default_rng(seed)
    tf, background = r.integers(1, 20, 200).astype(float), r.random(200) ** 4 * 0.2 + 1e-6
    p = own_model(tf, background, np.array([0]))
    steps = plain_model(tf, background, 100_000)
    np.testing.assert_allclose(p, steps, atol=2e-6)
    assert (p == 0).any()
    np.testing.assert_allclose(em_step(p, tf, background, np.zeros(200, int), 1), p, atol=1e-12)


def test_model_of_odd_counts():
    assert own_model(np.array([0.0, 0.0]), np.array([0.5, 0.5]), np.array([0])).sum() == 0  # nothing counted: nothing to weigh
    np.testing.assert_array_equal(own_model(np.array([3.0]), np.array([1.0]), np.array([0])), [1.0])


def test_weights(spark):
    rows = sample(1500, 9)
    tf = merged(rows)
    lengths = {d: sum(f for (_, e), f in tf.items() if e == d) for d in range(49)}  # one document is unknown
    terms, docs = tables(spark, rows, [*lengths.items(), (None, 5)])
    got = {(r.term, r.doc_id): r for r in distinctive_terms(terms, docs).collect()}
    assert got.keys() == tf.keys()
    cf = {}
    for (t, _), f in tf.items():
        cf[t] = cf.get(t, 0) + f
    total = sum(lengths.values()) + 5
    for d in (0, 17, 49):
        mine = sorted(t for t, e in tf if e == d)
        p = plain_model(np.array([tf[t, d] for t in mine], float), np.array([min(1, cf[t] / total) for t in mine]), 20_000)
        np.testing.assert_allclose([got[t, d].weight for t in mine], p, atol=1e-4)
        by_rank = sorted(mine, key=lambda t: got[t, d]["rank"])
        assert by_rank == sorted(mine, key=lambda t: (-got[t, d].weight, t))
        assert {got[t, d].length for t in mine} == {lengths.get(d)}
    found = {(r.doc_id, r.term) for r in shared_by_few(distinctive_terms(terms, docs), 2, 20, 3, 2).collect()}
    df = {t: sum(1 for u, _ in tf if u == t) for t, _ in tf}
    assert found == {(d, t) for (t, d), f in tf.items() if 2 <= df[t] <= 20 and f >= 3 and d in lengths and f * 100 >= lengths[d] * 2}


def test_long_document(spark):
    rows = [(f"w{i}", 1, 0, 1 + i % 3) for i in range(30_000)] + [("w1", 2, 0, 4), ("own", 2, 0, 4)]
    terms, docs = tables(spark, rows, [(1, 60_000), (2, 8)])
    scored = distinctive_terms(terms, docs).cache()
    assert scored.count() == 30_002
    two = {r.term: r for r in scored.filter("doc_id = 2").collect()}
    assert two["own"]["rank"] == 1
    assert abs(scored.filter("doc_id = 1").agg(F.sum("weight")).first()[0] - 1) < 1e-6
    scored.unpersist()
