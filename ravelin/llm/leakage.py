"""Passages of held-out test items inside a corpus, found by one automaton over all items.

The alphabet of the automaton is words, not characters: every distinct word of the items gets one code, every other word
the code 0, which no item has. A text is then one short string of codes, scanned once whatever the number of items.

A passage is ``n`` consecutive words of an item. The automaton doesn't hold every passage but pieces of about half the
length, one at every few words of an item, so chosen that each passage contains a whole one. Where a piece is met, text and
item are compared word by word to both sides, which gives the longest common run; a run of ``n`` words or more is a leak.
Runs are word positions; where spans are asked for, they are mapped back to characters of the text as it is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leak is so many consecutive words of an item.
PASSAGE_WORDS = 12
#: Items and characters of one automaton at most: what bounds the memory of a worker and what is broadcast. Beyond, the
#: stated set of items is taken in blocks, each against all texts.
ITEMS_PER_BLOCK, CHARS_PER_BLOCK = 50_000, 20_000_000

WORD = regex.compile(r"[\p{L}\p{N}]+")
_SURROGATES = range(0xD800, 0xE000)


def lower_in_place(text: str) -> str:
    """Lower case without a change of length, so that positions hold for the original."""
    low = text.translate({0x130: "i", 0x3A3: "σ"}).lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class PassageIndex:
    """Pieces of all items in one automaton; finds runs of ``passage_words`` or more words that a text shares with an item."""

    def __init__(self, items: Iterable[tuple[int, str | None]], passage_words: int = PASSAGE_WORDS):
        self.passage_words = passage_words
        self.piece_words = (passage_words + 1) // 2
        self._code: dict[str, str] = {}
        self._items: list[tuple[int, str]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            coded = "".join([self._code_of(w) for w in WORD.findall(lower_in_place(text or ""))])
            if len(coded) < passage_words:
                continue
            # a passage from word i on has a piece that begins within the next passage_words - piece_words words
            for at in range(0, len(coded) - self.piece_words + 1, passage_words - self.piece_words + 1):
                pieces.setdefault(coded[at : at + self.piece_words], []).append((len(self._items), at))
            self._items.append((item, coded))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, tuple(places))
        self.empty = not pieces
        if not self.empty:
            self.automaton.make_automaton()

    def _code_of(self, word: str) -> str:
        if word not in self._code:
            n = len(self._code) + 1
            self._code[word] = chr(n if n < _SURROGATES.start else n + len(_SURROGATES))
        return self._code[word]

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first, last word of the run in the text) of every longest common run of enough words, in order, each once."""
        if self.empty:
            return []
        known = self._code.get
        coded = "".join([known(w, "\0") for w in WORD.findall(lower_in_place(text))])
        found = set()
        seen: dict[tuple[int, int], int] = {}  # where the last run of an item with this offset between text and item ends
        for end, places in self.automaton.iter(coded):
            start = end - self.piece_words + 1
            for row, at in places:
                if seen.get((row, start - at), -1) >= end:
                    continue
                item, other = self._items[row]
                left = 0
                while left < min(start, at) and coded[start - left - 1] == other[at - left - 1]:
                    left += 1
                right, most = self.piece_words, min(len(coded) - start, len(other) - at)
                while right < most and coded[start + right] == other[at + right]:
                    right += 1
                seen[row, start - at] = start + right - 1
                if left + right >= self.passage_words:
                    found.add((item, start - left, start + right - 1))
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, words): the stretches of ``text``, in characters, that hold passages of an item."""
        hits = self.hits(text)
        if not hits:
            return []
        bounds = [m.span() for m in WORD.finditer(lower_in_place(text))]
        return [(item, bounds[a][0], bounds[b][1], b - a + 1) for item, a, b in hits]


_built: dict[str, PassageIndex] = {}


def _index(name: str, items: list[tuple[int, str | None]], passage_words: int) -> PassageIndex:
    """Built once per worker and block of items; the last two are kept."""
    if name not in _built:
        while len(_built) > 1:
            _built.pop(next(iter(_built)))
        _built[name] = PassageIndex(items, passage_words)
    return _built[name]


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str | None]]]:
    """The stated set of items, so many at a time in the order of their ids; the driver holds one block."""
    rows = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    held: list[tuple[int, str | None]] = []
    chars = 0
    for row in rows.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        chars += len(row["text"] or "")
        if len(held) >= block or chars >= CHARS_PER_BLOCK:
            yield held
            held, chars = [], 0
    yield held


def _scan(documents: DataFrame, items: DataFrame, schema: str, emit, passage_words: int, block: int) -> DataFrame:
    result = None
    rows = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    for some in _blocks(items, block):
        if result is not None and not some:
            break
        shared = documents.sparkSession.sparkContext.broadcast(some)  # of bounded size
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, passage_words)
            for batch in batches:
                found = [row for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for row in emit(index, d, text)]
                columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

        part = rows.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result


def leaked_items(documents: DataFrame, items: DataFrame, passage_words: int = PASSAGE_WORDS, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``doc_id``, ``item_id``: each item of which some ``passage_words`` consecutive words stand in the document's ``text``.

    Words are runs of letters and numbers of the lower-cased text, so case, punctuation and white space don't matter. One
    row per pair and row of ``documents``; a passage of two items gives both. Null and empty texts, items of fewer words
    and null ids give no rows; equal items under several ids all count. Extra columns are ignored.
    """

    def emit(index: PassageIndex, doc: int, text: str):
        return [(doc, item) for item in sorted({item for item, _, _ in index.hits(text)})]

    return _scan(documents, items, "doc_id long, item_id long", emit, passage_words, items_per_block)


def leak_spans(documents: DataFrame, items: DataFrame, passage_words: int = PASSAGE_WORDS, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``doc_id``, ``item_id``, ``begin``, ``end``, ``words``: the leaking stretches, in characters of the stored ``text``."""

    def emit(index: PassageIndex, doc: int, text: str):
        return [(doc, *span) for span in index.spans(text)]

    return _scan(documents, items, "doc_id long, item_id long, begin long, end long, words long", emit, passage_words, items_per_block)
