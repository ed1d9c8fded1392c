"""Near-duplicates against all pairs, sketches and alignment against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import near_dup
from ravelin.llm.near_dup import SKETCHES, NearDuplicates, edit_distance_within, order_sketches, similar

SCHEMA = "doc_id long, body string, rep int, sketches string, words int, norm string, h1 int, n int"


def table(spark, rows):
    return spark.createDataFrame([(d, b, 1, "s", 2, "x", 3, 4) for d, b in rows], SCHEMA)


def shingles(body):
    w = "".join(c if c.isalnum() else " " for c in (body or "").lower()).split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def all_pairs(rows):
    s = [(d, shingles(b)) for d, b in rows if shingles(b)]
    return {(min(d, e), max(d, e)) for i, (d, x) in enumerate(s) for e, y in s[:i] if d != e and len(x & y) * 10 >= len(x | y) * 7}


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        base = r.choices(words, k=r.choice([15, 20, 25, 60, 200, 500]))
        rows.append(base)
        for _ in range(r.choice([0, 0, 1, 3])):
            new = list(base)
            for _ in range(r.choice([0, 1, 2, len(base) // 15, len(base) // 10])):
                at = r.randrange(len(new))
                edit = r.choice(["put", "cut", "swap"])
                if edit == "put":
                    new.insert(at, r.choice(words))
                elif edit == "cut" and len(new) > 3:
                    del new[at]
                else:
                    new[at] = r.choice(words)
            kind = r.random()
            if kind < 0.2:
                new = new[len(new) // 2 :] + new[: len(new) // 2]  # halves change places
            elif kind < 0.3:
                new = new + new[: len(new) // 3]  # a part said twice
            rows.append(new)
    styles = [" ".join, "\n".join, lambda w: " ".join(w).upper() + "!", lambda w: ", ".join(w)]
    rows = [(i, r.choice(styles)(w)) for i, w in enumerate(rows)]
    return rows + [(1000, None), (1001, ""), (1002, "?! ..."), (1003, "too few words")]


@pytest.mark.parametrize("seed", range(2))
def test_pairs(spark, seed):
    rows = corpus(seed)
    found = NearDuplicates(table(spark, rows))
    assert {tuple(r) for r in found.pairs().collect()} == all_pairs(rows)


def test_moved_passages(spark):
    """Pairs near the limit whose passages stand in another order; order-sensitive sketches alone miss some."""
    r = random.Random(3)
    rows = []
    for i in range(150):
        base = [f"w{i}x{n}" for n in range(240)]
        parts = [base[at : at + 20] for at in range(0, 240, 20)]
        r.shuffle(parts)
        new = [w for part in parts for w in part]
        for at in r.sample(range(240), 6):
            new[at] += "y"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(new))]
    rows += [(1000, "a b " * 12), (1001, "b a " * 12)]  # two distinct k-mers
    true = all_pairs(rows)
    assert len(true) > 100 and (1000, 1001) in true
    assert {tuple(x) for x in NearDuplicates(table(spark, rows)).pairs().collect()} == true


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 3)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(12):
        w = list(base)
        w[i * 20] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert {tuple(r) for r in NearDuplicates(table(spark, rows)).pairs().collect()} == all_pairs(rows) == {(a, b) for b in range(12) for a in range(b)}


def test_hot_bucket_is_enough(spark, monkeypatch):
    """Records whose only common sketch is that of a hot bucket still meet, each pair once."""
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 3)
    found = NearDuplicates.__new__(NearDuplicates)
    rows = [(i, [7, 100 + i]) for i in range(11)] + [(20, [8, 200]), (21, [8, 201]), (30, [300, 7])]
    found._classes = spark.createDataFrame(rows, "rep long, sketches array<long>")
    got = [tuple(r) for r in found._candidates().collect()]
    assert sorted(got) == sorted([(a, b) for b in range(11) for a in range(b)] + [(20, 21)])


def test_only_keys_that_stand_twice_go_on():
    def rows(*keys):
        return pa.RecordBatch.from_pydict({"rep": pa.array(range(len(keys)), pa.int64()), "key": pa.array(keys, pa.int64())})

    def kept(*batches):
        return [k for b in near_dup._repeated(iter(batches)) for k in b.column("key").to_pylist()]

    assert kept(rows(1, 2, 3, 3, 4, 5)) == [1, 3, 3, 5]  # the first and the last may go on elsewhere
    assert kept(rows(1, 1), rows(1, 2), rows(2, 3), rows(4), rows(), rows(5)) == [1, 1, 1, 2, 2, 5]
    assert kept(rows(7), rows(7), rows(7)) == [7, 7, 7]
    assert kept() == []


def test_copies_and_classes(spark):
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(i, text) for i in range(5)] + [(9, text + " more"), (20, other), (None, text)]
    found = NearDuplicates(table(spark, rows))
    got = {r.doc_id: (r.class_id, r.copies, r.links) for r in found.classes().collect()}
    assert got == {**{i: (0, 5, 1) for i in range(5)}, 9: (9, 1, 1), 20: (20, 1, 0)}
    assert {tuple(r) for r in found.pairs().collect()} == {(a, b) for b in (1, 2, 3, 4, 9) for a in (0, 1, 2, 3, 4) if a < b}


def test_empty(spark):
    found = NearDuplicates(table(spark, []))
    assert found.pairs().count() == found.classes().count() == 0
    assert NearDuplicates(table(spark, [(1, None), (2, "few")])).pairs().count() == 0


def test_one_word_for_ever(spark):
    rows = [(1, "a " * 5000), (2, "a " * 21), (3, "a " * 20 + "b"), (4, "b " * 30)]
    assert {tuple(r) for r in NearDuplicates(table(spark, rows)).pairs().collect()} == all_pairs(rows)


def test_sketches_do_not_depend_on_company():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 50, n).astype(np.uint64) for n in (5, 80, 21, 3000)]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    together = order_sketches(np.concatenate(parts), starts)
    assert together.shape == (4, SKETCHES)
    for i, p in enumerate(parts):
        np.testing.assert_array_equal(together[i], order_sketches(p, np.array([0]))[0])


def test_sketches_see_the_order():
    a = np.arange(300).astype(np.uint64)
    b = np.concatenate((a[150:], a[:150]))
    same = (order_sketches(a, np.array([0]))[0] == order_sketches(b, np.array([0]))[0]).mean()
    assert 0 < same < 0.8


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_distances(seed):
    r = np.random.default_rng(seed)
    a = r.integers(0, 4, r.integers(0, 25))
    b = np.array([x for x in a if r.random() > 0.2] + list(r.integers(0, 4, r.integers(0, 6))), dtype=a.dtype)
    true = plain_distance(a, b)
    for most in (0, 1, 3, 8, 40):
        assert edit_distance_within(a, b, most) == (true if true <= most else None)


def test_alignment_never_contradicts_the_share():
    r = np.random.default_rng(7)
    for _ in range(300):
        a = r.integers(0, 30, r.integers(20, 200)).astype(np.uint64)
        b = a.copy()
        for _ in range(r.integers(0, 12)):
            b[r.integers(0, len(b))] = r.integers(0, 30)
        x, y = {tuple(a[i : i + 3]) for i in range(len(a) - 2)}, {tuple(b[i : i + 3]) for i in range(len(b) - 2)}
        assert similar(a, b)[0] == (len(x & y) * 100 >= len(x | y) * 70)
