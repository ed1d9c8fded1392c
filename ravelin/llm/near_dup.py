"""Near-duplicate records that differ by small edits, insertions or reordering: Order MinHash and banded alignment.

A record is a sequence of words, its k-mers are ``K`` consecutive words, and equal k-mers of one record are told apart by
the number of their occurrence. A sketch draws the ``L`` k-mers with the smallest values of one hash function. The first
``ORDERED`` sketches keep them *in the order of the text*, so two records share one with a probability near the L-th power
of the Jaccard similarity of their labelled k-mers, times the share of k-mer tuples that stand in the same order. What a
case is depends neither on order nor on repeats, so the other ``FREE`` sketches draw from first occurrences only and keep
the k-mers in the order of their hash values: a pair at similarity J shares each with a probability near the L-th power of
J, wherever its passages stand, and at 0.7 has none of them in common about once in twenty million pairs.

Exact copies form one class first, so only different texts meet. Candidate pairs come from equal sketches, however
many records share one, and are verified one by one: the exact share of distinct k-mers decides, and an alignment within a
narrow band counts the edits of most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.text import WORD_GAP, lower_runes
from ravelin.operators.skew import join_states
from ravelin.session import cut_lineage

#: Words of a k-mer, k-mers of a sketch, and sketches of a record that do and don't see the order of its k-mers.
K, L, ORDERED, FREE = 3, 3, 16, 40
SKETCHES = ORDERED + FREE
#: Records of fewer words are never similar to anything.
MIN_WORDS = 20
#: Least share, in per cent, of the distinct k-mers of either record that stand in both.
MIN_PERCENT = 70
#: Edits that the alignment looks for at most; beyond, the k-mers decide.
BAND = 48
#: Words that are sketched together.
CHUNK_WORDS = 1_000_000
#: Buckets of one sketch with more records are cut into blocks of about so many, and every two blocks meet.
HOT_BUCKET = 200

_FULL = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kmers(word: np.ndarray) -> np.ndarray:
    """Hash of the k-mer at each position; the last K - 1 positions have none."""
    out = np.zeros(max(0, len(word) - K + 1), np.uint64)
    for i in range(K):
        out = _mix(out + word[i : len(word) - K + 1 + i] + np.uint64(i + 1))
    return out


def _draw(labelled: np.ndarray, sizes: np.ndarray, numbers: range, ordered: bool) -> np.ndarray:
    """Sketches ``numbers`` of records of ``sizes`` labelled k-mers each, in the order of the text or else of their hash values."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    record = np.repeat(np.arange(len(sizes)), sizes)
    out = np.empty((len(sizes), len(numbers)), np.uint64)
    for column, j in enumerate(numbers):
        value = labelled * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) | 1) % 2**64)
        value ^= value >> np.uint64(32)
        value *= np.uint64((0xD6E8FEB86659FD93 * (2 * j + 3) | 1) % 2**64)
        picked = np.empty((len(sizes), L), np.int64)
        for pick in range(L):
            least = np.minimum.reduceat(value, first)
            hits = np.flatnonzero(value == np.repeat(least, sizes))
            _, one = np.unique(record[hits], return_index=True)
            picked[:, pick] = hits[one]
            if pick and not ordered:  # no k-mer left: the last again, wherever the first stands
                picked[:, pick] = np.where(least == _FULL, picked[:, pick - 1], picked[:, pick])
            value[picked[:, pick]] = _FULL
        if ordered:
            picked.sort(axis=1)  # back to the order of the text
        key = np.full(len(sizes), j + 1, np.uint64)
        for pick in range(L):
            key = _mix(key + labelled[picked[:, pick]])
        out[:, column] = key
    return out


def order_sketches(word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sketches of several records, one row each: ``word`` has the hashed words of all end to end, ``starts`` where each begins.

    Every record needs at least K words; one of fewer than L k-mers repeats one of them in the sketch.
    """
    sizes = np.diff(np.append(starts, len(word)))
    kmer = _kmers(word)
    keep = np.ones(len(word), bool)
    for i in range(1, K):  # k-mers that run into the next record
        keep[np.append(starts[1:], len(word)) - i] = False
    kmer, sizes = kmer[np.flatnonzero(keep)], sizes - K + 1
    record = np.repeat(np.arange(len(sizes)), sizes)
    # the number of the occurrence: places of equal k-mers of a record are consecutive after a stable sort
    order = np.lexsort((kmer, record))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (kmer[order][1:] != kmer[order][:-1]) | (record[order][1:] != record[order][:-1])
    begin = np.flatnonzero(fresh)
    label = np.empty(len(order), np.uint64)
    label[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    labelled = _mix(kmer + label * np.uint64(0x9E3779B97F4A7C15))
    firsts = label == 0
    every = _draw(labelled, sizes, range(ORDERED), ordered=True)
    once = _draw(labelled[firsts], np.bincount(record[firsts], minlength=len(sizes)), range(ORDERED, SKETCHES), ordered=False)
    return np.concatenate((every, once), axis=1)


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``, else None; looks at 2 ``most`` + 1 diagonals only.

    On each diagonal the furthest place reached with one more edit is kept; stretches of equal words are jumped over.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    breaks: dict[int, np.ndarray] = {}

    def slide(diagonal: int, i: int) -> int:
        """The first place from ``i`` on where the diagonal has different words, or its end."""
        if diagonal not in breaks:
            lo, hi = max(0, -diagonal), min(n, m - diagonal)
            breaks[diagonal] = np.append(lo + np.flatnonzero(a[lo:hi] != b[lo + diagonal : hi + diagonal]), hi)
        places = breaks[diagonal]
        return int(places[min(np.searchsorted(places, i), len(places) - 1)])

    reach = {0: slide(0, 0)}
    for edits in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return edits
        new = {}
        for d in range(-edits - 1, edits + 2):
            best = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)  # replace, insert, delete
            best = min(best, n, m - d)
            if best >= max(0, -d):
                new[d] = max(best, slide(d, best))
        reach = new
    return None


def _distinct(words: np.ndarray) -> np.ndarray:
    """Distinct k-mers in order."""
    return np.unique(_kmers(words))


def similar(a: np.ndarray, b: np.ndarray, min_percent: int = MIN_PERCENT, kmers: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[bool, int | None]:
    """Whether two records reach the similarity, and their edit distance if the alignment has proved it.

    One edit changes at most K k-mers of either side. With x distinct k-mers on the larger side and d edits, at least
    x - K d are in both and at most x + K d in either, so the alignment looks for no more edits than prove the case.
    ``kmers`` are the distinct k-mers of both, if they are known.
    """
    ka, kb = kmers or (_distinct(a), _distinct(b))
    larger = max(len(ka), len(kb))
    if min(len(ka), len(kb)) * 100 < larger * min_percent:
        return False, None
    merged = np.concatenate((ka, kb))
    merged.sort(kind="stable")  # two runs in order: a merge
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    if both * 100 < (len(ka) + len(kb) - both) * min_percent:  # cheaper than an alignment that can't succeed
        return False, None
    return True, edit_distance_within(a, b, min(BAND, larger * (100 - min_percent) // (K * (100 + min_percent))))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end as unsigned, and the bounds of the rows."""
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    return values.view(np.uint64), bounds - bounds[0]


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        batch = batch.filter(pc.greater_equal(pc.fill_null(pc.list_value_length(batch.column("words")), 0), MIN_WORDS))
        if batch.num_rows == 0:
            continue
        word, bounds = _lists(batch.column("words"))
        cuts = np.flatnonzero(np.diff(bounds[:-1] // CHUNK_WORDS, prepend=-1)).tolist() + [batch.num_rows]
        some = [order_sketches(word[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        keys = np.concatenate(some).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SKETCHES), pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), lists], ["doc_id", "text", "sketches"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of (key, rep) in order: rows whose key stands more than once, and the first and last row of the range.

    The first and the last key may go on in the ranges beside, so their rows are kept in any case. One row is held.
    """
    held: pa.RecordBatch | None = None
    before = True  # whether the held row is kept because of what stands before it
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        key = rows.column("key").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(same, False) | np.append(before, same)
        held, before = rows.slice(rows.num_rows - 1), bool(keep[-1])
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
    if held is not None:
        yield held


class _Known:
    """Distinct k-mers of records seen lately: a record is in many candidate pairs."""

    MOST = 2_000_000

    def __init__(self):
        self.size, self.held = 0, {}

    def of(self, record: int, words: np.ndarray) -> np.ndarray:
        key = (record, len(words), words.tobytes() if len(words) < 64 else hash(words.tobytes()))
        if key not in self.held:
            if self.size > self.MOST:
                self.size, self.held = 0, {}
            self.held[key] = _distinct(words)
            self.size += len(words)
        return self.held[key]


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Known()
    for batch in batches:
        ids_a, ids_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, at_left = _lists(batch.column("words_a"))
        right, at_right = _lists(batch.column("words_b"))
        keep, edits = [], []
        for i in range(batch.num_rows):
            a, b = left[at_left[i] : at_left[i + 1]], right[at_right[i] : at_right[i + 1]]
            if min(len(a), len(b)) < MIN_WORDS:  # another text under the same id
                continue
            ok, distance = similar(a, b, kmers=(known.of(ids_a[i], a), known.of(ids_b[i], b)))
            if ok:
                keep.append(i)
                edits.append(distance)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(edits, pa.int32())], ["a", "b", "edits"])


def _split(bodies: DataFrame) -> DataFrame:
    """``doc_id``, ``split``: the words in order. Short bodies are left out later: a filter here would split every body twice."""
    return bodies.select("doc_id", F.array_remove(F.split(lower_runes(F.col("body")), WORD_GAP), "").alias("split"))


def _words() -> Column:
    """Hashes of the words in order."""
    return F.transform("split", lambda w: F.xxhash64(w))


class NearDuplicates:
    """Near-duplicates of ``body`` in a table of documents.

    * ``members``: ``doc_id``, ``rep`` of every document with at least ``MIN_WORDS`` words; ``rep`` is the smallest
      ``doc_id`` with the same words in the same order. A ``doc_id`` that is there twice counts once for each text.
    * ``links``: ``a``, ``b``, ``edits``: similar pairs of such representatives, ``a < b``; ``edits`` is the number of
      word edits where the alignment proved the pair, else null.

    Null, empty and short bodies and null ids take no part; empty tables give empty results; extra columns are ignored.
    The sketches are written once to the checkpoint folder, so lost executors cost no second pass.
    """

    def __init__(self, documents: DataFrame):
        known = documents.filter(F.col("doc_id").isNotNull() & F.col("body").isNotNull())
        self._bodies = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("body").cast("string").alias("body"))
        text_hash = F.struct(F.xxhash64("split").alias("h1"), F.xxhash64("split", F.lit(1)).alias("h2"))
        drawn = _split(self._bodies).select("doc_id", text_hash.alias("text"), _words().alias("words"))
        schema = "doc_id long, text struct<h1: long, h2: long>, sketches array<long>"
        sketches = cut_lineage(drawn.mapInArrow(_sketch_batches, schema))
        self._classes = sketches.groupBy("text").agg(F.min("doc_id").alias("rep"), F.first("sketches").alias("sketches"), F.count(F.lit(1)).alias("n"))
        copies = self._classes.filter("n > 1").select("text", "rep")
        found = join_states(sketches.select("doc_id", "text"), copies, "text", how="left")  # a text may own a third of the rows
        self.members = found.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct()
        self.links = self._verified(self._candidates())

    def _candidates(self) -> DataFrame:
        """Pairs of representatives with an equal sketch, each pair once.

        Keys are placed by ranges of (key, representative), so a key that many records share fills as many ranges as it
        needs, and only rows whose key stands more than once go on.
        """
        drawn = self._classes.select("rep", F.posexplode("sketches").alias("j", "key")).select("rep", F.xxhash64("j", "key").alias("key"))
        ranges = drawn.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
        shared = cut_lineage(ranges.mapInArrow(_repeated, "rep long, key long"))
        sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        placed = shared.join(sizes, "key")
        small, hot = placed.filter(F.col("size") <= HOT_BUCKET), placed.filter(F.col("size") > HOT_BUCKET)
        blocks = F.ceil(F.col("size") / HOT_BUCKET).cast("int")
        blocked = hot.select("rep", "key", (blocks - 1).alias("last"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))

        def pairs(left: DataFrame, right: DataFrame, on: list[str], kept: str) -> DataFrame:
            met = left.withColumnRenamed("rep", "a").join(right.withColumnRenamed("rep", "b"), on).filter(kept)
            return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

        # blocks x <= y meet in one place (x, y): a record is there as x for its own and all later blocks, as y for all up to its own
        left = blocked.select("rep", "key", F.col("block").alias("x"), F.explode(F.sequence("block", "last")).alias("y"))
        right = blocked.select("rep", "key", F.explode(F.sequence(F.lit(0), "block")).alias("x"), F.col("block").alias("y"))
        within = pairs(small.select("rep", "key"), small.select("rep", "key"), ["key"], "a < b")
        return within.unionByName(pairs(left, right, ["key", "x", "y"], "x < y OR a < b")).distinct()

    def _verified(self, candidates: DataFrame) -> DataFrame:
        candidates = cut_lineage(candidates)  # small, and used twice
        wanted = candidates.select(F.col("a").alias("doc_id")).unionByName(candidates.select(F.col("b").alias("doc_id"))).distinct()
        # bodies meet the ids before they are split again: most have no candidate, and texts shuffle smaller than hashes
        texts = _split(self._bodies.join(wanted, "doc_id", "left_semi")).select("doc_id", _words().alias("words"))
        left = texts.select(F.col("doc_id").alias("a"), F.col("words").alias("words_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("words").alias("words_b"))
        rows = candidates.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b")
        return rows.mapInArrow(_verify_batches, "a long, b long, edits int").groupBy("a", "b").agg(F.min("edits").alias("edits"))

    def pairs(self) -> DataFrame:
        """``doc_id_a``, ``doc_id_b``: every similar pair of documents, copies written out."""
        a = self.members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
        b = self.members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
        across = self.links.join(a, "a").join(b, "b").select("x", "y")
        within = a.join(b, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
        both = across.unionByName(within).filter("x != y")
        return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

    def classes(self) -> DataFrame:
        """``doc_id``, ``class_id``, ``copies``, ``links``: one row per document with its class of copies, the size of the class and the similar classes."""
        sizes = self.members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
        ends = self.links.select(F.col("a").alias("rep")).unionByName(self.links.select(F.col("b").alias("rep")))
        degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        known = sizes.join(degree, "rep", "left").select("rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
        return join_states(self.members, known, "rep").select("doc_id", F.col("rep").alias("class_id"), "copies", "links")
