"""Per-key results where one key owns most rows."""

import random

import pytest

from ravelin.operators.postings import clean_postings, merge_blocks
from ravelin.operators.skew import eager_join_aggregate, hot_keys, join_states, key_shares, top_records, top_records_of_hot_keys
from ravelin.plans.skew_queries import stored_postings

SCHEMA = "term string, doc_id long, seg int, freq long, rank int, rows string, _salt long, tf double"


def postings(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 0.5) for r in rows], SCHEMA)


def brute(rows, k, percent):
    form = lambda t: t.strip(" \t").lower() if t is not None else None
    blocks, stored = {}, {}
    for t, d, s, f in rows:
        t = form(t)
        if t is not None:
            stored[t] = stored.get(t, 0) + 1
        if t and d is not None:
            blocks[t, d, s] = max(blocks.get((t, d, s), 0), f or 0)
    tf = {}
    for (t, d, _), f in blocks.items():
        tf[t, d] = tf.get((t, d), 0) + f
    out = set()
    for t in {t for t, _ in tf}:
        if stored[t] * 100 >= len(rows) * percent:
            best = sorted((-n, d) for (u, d), n in tf.items() if u == t)[:k]
            out |= {(t, d) for _, d in best}
    return out


def sample(n, seed):
    r = random.Random(seed)
    terms = ["hot", "Hot", " hot\t"] * 3 + [f"t{i}" for i in range(40)] + [None, "", " \t"]
    rows = [(r.choice(terms), r.choice([*range(60), None]), r.choice([0, 1, 2, None]), r.choice([1, 2, 3, None])) for _ in range(n)]
    return rows + r.sample(rows, n // 3)


def found(spark, rows, k=3, percent=2):
    stored = stored_postings(postings(spark, rows))
    best = top_records_of_hot_keys(stored, lambda x: merge_blocks(clean_postings(x)), "term", "doc_id", "tf", k, percent)
    return {(r.term, r.doc_id) for r in best.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_hot_terms_against_brute_force(spark, seed):
    rows = sample(900, seed)
    assert found(spark, rows) == brute(rows, 3, 2)


def test_states_of_all_rows_meet_hot_keys(spark):
    rows, seen = sample(900, 0), []
    stored = stored_postings(postings(spark, rows))

    def states_of(x):
        seen.append(x.count())
        return merge_blocks(clean_postings(x))

    best = top_records_of_hot_keys(stored, states_of, "term", "doc_id", "tf", 3, 2)
    assert seen == [stored.count()]
    assert {(r.term, r.doc_id) for r in best.collect()} == brute(rows, 3, 2)


def test_all_one_key_and_ties(spark):
    rows = [("a", d, 0, 1) for d in range(500, 0, -1)] * 2
    assert found(spark, rows) == {("a", 1), ("a", 2), ("a", 3)}


def test_empty_table(spark):
    assert found(spark, []) == set()
    assert key_shares(postings(spark, []), "term").count() == 0


def test_hot_keys(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [("b",)] * 49 + [(None,)], "k string")
    assert [r.k for r in hot_keys(rows, "k", 50).collect()] == ["a"]
    with pytest.raises(ValueError, match="percent"):
        hot_keys(rows, "k", 0)


def test_top_records_ignores_other_columns(spark):
    states = spark.createDataFrame([("a", i, float(i % 7) if i else None, 9, 9) for i in range(200)], "k string, r long, v double, rank int, _salt int")
    got = [(r.r, r["rank"]) for r in top_records(states, "k", "r", "v", 3, salts=4).orderBy("rank").collect()]
    assert got == [(6, 1), (13, 2), (20, 3)]


def test_eager_aggregation_equals_the_join(spark):
    r = random.Random(5)
    left = [(r.choice(["h", "h", "h", "x", "y", None]), r.choice([1, 2, None]), "z") for _ in range(300)]
    right = [(r.choice(["h", "x", "q", None]), r.choice([10, None]), "z") for _ in range(200)]
    a, b = spark.createDataFrame(left, "k string, n long, pairs string"), spark.createDataFrame(right, "k string, m long, pairs string")
    got = {x.k: (x.pairs, x.ns, x.ms) for x in eager_join_aggregate(a, b, "k", {"ns": "n"}, {"ms": "m"}).collect()}
    want = {}
    for k, n, _ in left:
        for j, m, _ in right:
            if k is not None and k == j:
                p, ns, ms = want.get(k, (0, 0, 0))
                want[k] = (p + 1, ns + (n or 0), ms + (m or 0))
    assert got == want
    assert eager_join_aggregate(a.limit(0), b, "k", {}, {}).count() == 0


def test_join_states(spark):
    rows = spark.createDataFrame([("h", i) for i in range(90)] + [("c", 90), ("n", 91), (None, 92)], "k string, i int")
    states = spark.createDataFrame([("h", 1), ("c", 2)], "k string, s int")
    assert sorted((r.i, r.s) for r in join_states(rows, states, "k").collect()) == [(i, 1) for i in range(90)] + [(90, 2)]
    left = {r.i: r.s for r in join_states(rows, states, "k", "left").collect()}
    assert left == {**dict.fromkeys(range(90), 1), 90: 2, 91: None, 92: None}
    with pytest.raises(ValueError, match="how"):
        join_states(rows, states, "k", "full")
