"""Encoding of a corpus with a byte-level BPE vocabulary, by backtracking over longest matches.

A sequence of tokens is what the merges give exactly when every neighbouring pair is: when merging the pair's joined bytes
gives that pair again. So a text is encoded from left to right without a single merge: take the longest token that
matches (all matches come from one Aho-Corasick pass), keep it if it is compatible with the token before, else try the
next shorter match, else go back one token. A position from which no way on was found is never tried twice, which bounds
the work by the text's length times the number of matches at a place. Compatibility is a table over pairs of tokens,
filled as pairs turn up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern published with the vocabulary. White space is Unicode White_Space, as in the public encoders.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces and pairs that a worker remembers; a full table is emptied, which changes the speed only.
REMEMBERED = 400_000


class Vocabulary:
    """A rank file: one base64 token and its id per line; a smaller id is merged earlier."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # all tokens end to end; token i is data[offsets[i]:offsets[i + 1]]
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens]))).astype(np.int64)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.splitter = regex.compile(SPLIT_PATTERN)
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of ``piece`` by the definition: merge the pair of the smallest id, leftmost first, until none is left."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def _matches(self, piece: bytes) -> list[list[tuple[int, int]]]:
        """The tokens that begin at each position as (id, length), short ones first."""
        found: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            found[end - size + 1].append((rank, size))
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        matches, n = self._matches(piece), len(piece)
        closed = bytearray(n + 1)  # positions from which the end can't be reached, given what stands before
        stack: list[tuple[int, int, int]] = []  # id, start, index of the next shorter match
        at, untried = 0, len(matches[0]) - 1
        while at < n:
            before = stack[-1][0] if stack else -1
            here = matches[at]
            while untried >= 0:
                rank, size = here[untried]
                untried -= 1
                if not closed[at + size] and (before < 0 or self.compatible(before, rank)):
                    stack.append((rank, at, untried))
                    at += size
                    untried = len(matches[at]) - 1 if at < n else -1
                    break
            else:
                closed[at] = 1
                _, at, untried = stack.pop()
        return [rank for rank, _, _ in stack]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self._pieces
        for piece in self.splitter.findall(text):
            found = known.get(piece)
            if found is None:
                found = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of several texts; ``ids`` has theirs end to end and ``ends`` where each ends."""
        start, size = self.offsets[ids], np.diff(self.offsets)[ids]
        stop = np.cumsum(size)
        source = np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)
        data = self.data[source].tobytes()
        bounds = np.concatenate(([0], stop))[np.concatenate(([0], ends))]
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def _loaded(ranks: bytes) -> Vocabulary:
    return Vocabulary(ranks)


def _encode_batches(ranks: bytes, key: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(ranks)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column("text").to_pylist():
                if text:
                    flat += vocabulary.encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    return run


def encode_corpus(documents: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of every row: the token ids of ``text`` as it is, whole, without special tokens.

    An empty and a null text give an empty list. Other columns don't pass. The vocabulary is a file of the driver of a
    fixed size (under 1 MB), sent along with the task.
    """
    ranks = Path(vocabulary).read_bytes()
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    if key == "text":
        raise ValueError("the key can't be named text")
    return rows.mapInArrow(_encode_batches(ranks, key), f"`{key}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, ids: str = "ids", key: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``text`` of every row, by gathering the tokens' bytes from one table. Null and empty lists give an empty text.

    Ids outside the vocabulary raise an error. Bytes that are no UTF-8, as after cutting a list, become U+FFFD.
    """
    ranks = Path(vocabulary).read_bytes()
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _loaded(ranks)
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [b.decode("utf-8", "replace") for b in table.decode(flat, np.cumsum(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(F.col(key).alias(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def token_count(ids: Column) -> Column:
    """Number of tokens of an encoded text."""
    return F.size(ids)
