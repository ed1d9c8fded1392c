"""Keyword-stuffed and link-list pages, by the perplexity of their word classes under a model of prose.

A text is read as a sequence of classes: kinds of function words, words that stand for the first time, words that the same
text has again within 24, 12 or 8 words, links and tags. A trigram model of such sequences, trained on prose, scores every
segment. Prose seldom says a word again at once and has few links, so runs of keywords, lists of links and rows of tags or
goods are surprising at nearly every step, whatever stands between them. What the model has no class for, numbers, signs
and short unknown words, says nothing: it counts as surprising as prose is on average. So honest lists, tables and junk,
which are made of ever new words, numbers and signs, stay within the band that prose keeps to.

The perplexity decides alone. Only the upper end of the band flags a segment: sequences that are easier than any prose
are those of new words only, which lists of names and random tokens are made of, and those are no spam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.quality import of_prose
from ravelin.llm.structure import AUX, CLASSES, CLOSE, CONJ, DET, LINK, MID, MIXED, NEAR, ODD, PREP, PROSE, PRON, SKIP, TAG, WORD, Batch, portions, read_texts

#: A document is a case if more than this share of its characters stands in spam segments.
SPAM_SHARE = 0.5
#: A segment is abnormal if a token surprises by so many bits more than one of prose does on average.
EXCESS_BITS = 1.2
#: Weights of each neighbour of a segment.
NEIGHBOURS = 0.35

_STATE = np.full(len(CLASSES), -1)  # the model's number of each class; the others say nothing
for _number, _class in enumerate((DET, PREP, CONJ, PRON, AUX, WORD, MID, CLOSE, NEAR, LINK, TAG)):
    _STATE[_class] = _number
_STATE[[MIXED, ODD]] = _STATE[WORD]
_N = _STATE.max() + 1
_START = _N  # stands before the first token of a text and where something the model has no class for stands
_SMOOTHING = (0.57, 0.285, 0.095)  # trigrams, bigrams, unigrams; the rest is spread evenly, which bounds the surprise of a token


def _context(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens that have a state, the states two before and one before (of the same text), and their own."""
    use = np.flatnonzero(batch.kind != SKIP)
    now, doc = _STATE[batch.kind[use]], batch.doc[use]
    now = np.where(now < 0, _START, now)
    one, two = np.full(len(use), _START), np.full(len(use), _START)
    one[1:] = np.where(doc[1:] == doc[:-1], now[:-1], _START)
    two[2:] = np.where((doc[2:] == doc[:-2]) & (one[2:] != _START), now[:-2], _START)
    told = now != _START
    return use[told], two[told], one[told], now[told]


def trigrams(batch: Batch, wanted: np.ndarray | None = None) -> np.ndarray:
    """How often each state follows each two, in segments that are ``wanted`` (all by default), as a flat table."""
    use, two, one, now = _context(batch)
    n = _N + 1
    keep = slice(None) if wanted is None else wanted[batch.segment[use]]
    return np.bincount(((two * n + one) * _N + now)[keep], minlength=n * n * _N)


@dataclass(frozen=True)
class ProseModel:
    """``bits``: surprise of each state after each two; ``mean``: the average over the prose that the model is from."""

    bits: np.ndarray
    mean: float

    @staticmethod
    def of(counts: np.ndarray) -> ProseModel:
        """Interpolated from trigrams, bigrams and unigrams."""
        tri = counts.reshape(_N + 1, _N + 1, _N).astype(float)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1)) + 0.5
        p_uni = uni / uni.sum()
        p_bi = (bi + p_uni) / (bi.sum(axis=1, keepdims=True) + 1)
        p_tri = (tri + p_bi) / (tri.sum(axis=2, keepdims=True) + 1)
        bits = -np.log2(_SMOOTHING[0] * p_tri + _SMOOTHING[1] * p_bi + _SMOOTHING[2] * p_uni + (1 - sum(_SMOOTHING)) / _N)
        return ProseModel(bits, float((tri * bits).sum() / tri.sum()))


@lru_cache(maxsize=1)
def sample_counts() -> np.ndarray:
    """Trigrams of the samples of prose in the code."""
    return trigrams(read_texts(PROSE.values()))


def fit(documents: DataFrame, text: str = "text") -> ProseModel:
    """The model of the prose in all rows of ``documents`` and in the samples of the code.

    Prose are the texts of which nine tenths are nearest to a profile of prose. Only the table of trigrams, whose size is fixed, comes
    to the driver. A table without prose gives the model of the samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((_N + 1) * (_N + 1) * _N, np.int64)
        for whole in batches:
            for part in portions(whole, "text"):
                batch = read_texts(part.column("text").to_pylist())
                counts += trigrams(batch, of_prose(batch))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["place", "n"])

    counted = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "place long, n long")
    counts = sample_counts().copy()
    for place, n in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[place] += n
    return ProseModel.of(counts)


def segment_bits(batch: Batch, model: ProseModel) -> np.ndarray:
    """Mean surprise of a token of each segment; its neighbours in the text count in part."""
    use, two, one, now = _context(batch)
    n = len(batch.segment_doc)
    tokens = batch.by_segment((batch.kind != SKIP).astype(float))
    told = np.bincount(batch.segment[use], minlength=n)
    bits = np.bincount(batch.segment[use], model.bits[two, one, now], n) + (tokens - told) * model.mean
    total, weight = bits.astype(float), tokens.astype(float)
    same = batch.segment_doc[1:] == batch.segment_doc[:-1]
    for to, of in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        total[to][same] += NEIGHBOURS * bits[of][same]
        weight[to][same] += NEIGHBOURS * tokens[of][same]
    return np.where(weight > 0, total / np.maximum(weight, 1e-9), model.mean)


def spam_segments(bits: np.ndarray, model: ProseModel, excess: float = EXCESS_BITS) -> np.ndarray:
    """Segments whose perplexity is abnormally high."""
    return bits > model.mean + excess


def spam_share(documents: DataFrame, text: str = "text", model: ProseModel | None = None) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``chars``, ``perplexity``, ``spam_share``, over the whole text.

    ``chars`` counts the characters of all tokens, ``perplexity`` is that of the whole text, segments weighted by characters
    (null for a text without a token), and ``spam_share`` the share of the characters in spam segments, 0 for a null or
    empty text. Without ``model`` one is fitted first (see ``fit``). Extra columns are ignored.
    """
    prose = model or fit(documents, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in portions(whole, "text"):
                batch = read_texts(part.column("text").to_pylist())
                bits = segment_bits(batch, prose)
                weight = batch.by_segment(batch.size)
                chars = batch.by_doc(weight)
                mean = 2 ** (batch.by_doc(bits * weight) / np.maximum(chars, 1))
                spam = batch.by_doc(weight * spam_segments(bits, prose)) / np.maximum(chars, 1)
                columns = [pa.array(chars.astype(np.int64)), pa.array(mean, mask=chars == 0), pa.array(spam)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "chars", "perplexity", "spam_share"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, chars long, perplexity double, spam_share double")


def spam_pages(scored: DataFrame, share: float = SPAM_SHARE) -> DataFrame:
    """Rows of texts that are mostly spam."""
    return scored.filter(F.col("spam_share") > share)
