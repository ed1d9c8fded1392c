"""Per-document text statistics, and which structural profile each stretch of a text is nearest to.

The distribution of function words and other token classes in a segment is compared with profiles of prose and of lists,
tables, indexes, machine output and other junk, by the Jensen-Shannon divergence. A segment has the kind of its nearest
profile, a document the kinds of its segments weighted by characters. Profiles of prose come from short samples in four
languages; one more is of these samples without knowledge of their function words, for all other languages. Profiles of
structures come from samples drawn at random by the rules that make them what they are.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.structure import BAR, CLASSES, CLOSE, FUNCTION, MID, NUMBER, ODD, PROSE, SHORT, SHORT_LETTERS, SKIP, SYMBOL, WORD, Batch, portions, read_texts

#: A document is a case if more than this share of its characters stands in segments that aren't prose.
JUNK_SHARE = 0.5
#: Weight of each neighbour of a segment, and the lead from which on a segment's kind is clear.
NEIGHBOURS, CLEAR = 0.35, 0.1
#: Shorter bodies are no case.
MIN_CHARS = 10

#: Lines of a made-up structure, from which its profile comes, and the seed they are drawn with.
SAMPLE_LINES, SEED = 120, 20
#: Kinds of prose: one per sample, and one for languages whose function words aren't known.
UNKNOWN = "other language"


class _Drawn:
    """Parts of made-up structures, drawn at random."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        words = [w for text in PROSE.values() for w in re.findall(r"[^\W\d_]{5,}", text) if w.islower()]
        self.words = sorted(set(words))
        self.running = re.findall(r"[a-z]+", PROSE["en"])

    def word(self) -> str:
        return self.r.choice(self.words)

    def name(self) -> str:
        return "".join(self.r.choice("bdfghklmnprstv") + self.r.choice("aeiou") for _ in range(self.r.randint(2, 3))).title() + self.r.choice("nlrst")

    def number(self) -> str:
        n = self.r.randrange(1, 10 ** self.r.randint(1, 5))
        return self.r.choice([f"{n}", f"{n}", f"{n:,}", f"{n / 100:.2f}", f"{n}-{n + self.r.randrange(1, 60)}"])

    def entry(self, numbers: float = 0.35, joined: float = 0.3) -> str:
        """A few words and names, some with a preposition between them, some with a comma or colon, some with a number."""
        parts = [self.word() if self.r.random() < 0.6 else self.name() for _ in range(self.r.randint(1, 4))]
        if len(parts) > 1 and self.r.random() < 0.4:
            parts.insert(self.r.randrange(1, len(parts)), self.r.choice(["of", "at", "and", "in", "the"]))
        text = "".join(p + (self.r.choice([", ", ": "]) if i and i + 1 < len(parts) and self.r.random() < joined else " ") for i, p in enumerate(parts)).strip()
        return text + self.r.choice([", {}", " ({})", " {}"]).format(self.number()) if self.r.random() < numbers else text

    def letters(self, alphabet: str, least: int, most: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(least, most)))

    def link(self) -> str:
        return self.r.choice(["https://{}.test/{}", "http://www.{}.example/{}.html", "{}.invalid/?q={}"]).format(f"{self.name().lower()}-{self.word()}", self.word())

    def stuffed(self, most: int = 7, filler: float = 0.0, comma: float = 0.0) -> str:
        """A line of ever the same few words, some with another word of prose or a comma between them."""
        keys = [self.word() for _ in range(self.r.randint(2, most))]
        drawn = [self.r.choice(keys) if self.r.random() >= filler else self.r.choice(self.running) for _ in range(24)]
        return "".join(w + (self.r.choice([", ", ". ", "! "]) if self.r.random() < comma else " ") for w in drawn)


def structures(lines: int = SAMPLE_LINES, seed: int = SEED) -> dict[str, str]:
    """Made-up samples of what isn't prose: parts drawn at random, put together by the rule that makes each kind what it is."""
    d = _Drawn(seed)
    r = d.r
    low, digits = "bcdfghjklmnpqrstvwxz" * 3 + "aeiouy", "0123456789"
    kinds: dict[str, Callable[[int], str]] = {
        "list": lambda i: r.choice(["- ", "* ", "• ", f"{i + 1}. ", f"{i + 1}) "]) + d.entry(),
        "plain list": lambda i: d.entry(),
        "entries": lambda i: "; ".join(f"{n}. {d.entry()}" for n in range(1, 8)),
        "pairs": lambda i: d.entry() + r.choice([" — ", " = ", " → "]) + d.entry(),
        "values": lambda i: d.entry(0) + ": " + d.number(),
        "fields": lambda i: d.word().title() + ": " + d.entry(),
        "comma table": lambda i: ", ".join([d.name() + " " + d.name(), *(r.choice([d.number, d.number, d.word])() for _ in range(3))]),
        "bar table": lambda i: " | ".join([d.name(), *(r.choice([d.number, d.name, d.word])() for _ in range(3))]),
        "column table": lambda i: r.choice(["\t", "    "]).join([d.entry(0), *(r.choice([d.number, d.name, d.word])() for _ in range(3))]),
        "figures": lambda i: d.name() + " " + " ".join(d.number() for _ in range(5)),
        "index": lambda i: d.entry(0) + ", " + ", ".join(d.number() for _ in range(3)),
        "contents": lambda i: d.entry(0) + " " + "." * r.randint(5, 20) + " " + d.number(),
        "machine output": lambda i: f"[{d.letters(digits, 2, 2)}:{d.letters(digits, 2, 2)}:{d.letters(digits, 2, 2)}] {d.word().upper()} {d.word()}={d.letters(digits, 2, 4)} 0x{d.letters(digits + 'abcdef', 8, 14)}",
        "signs": lambda i: " ".join(d.letters("#@%&*=+<>|{}[]^~/-_", 1, 6) for _ in range(8)),
        "noise": lambda i: " ".join(d.letters(low, 6, 13) for _ in range(8)),
        "letters": lambda i: " ".join(d.letters(low + "aeiou.,:|'/1", 1, 1) for _ in range(20)),
        "codes": lambda i: " ".join(d.letters(low + digits * 2, 8, 14) for _ in range(6)),
        "links": lambda i: d.link(),
        "anchors": lambda i: f'<a href="{d.link()}">{d.entry(0, 0)}</a>',
        "keywords": lambda i: d.stuffed(),
        "stuffed sentences": lambda i: d.stuffed(5, 0.6, 0.15),
        "keyword list": lambda i: d.stuffed(9, 0.1, 0.4),
        "hash tags": lambda i: " ".join("#" + d.word() for _ in range(8)),
        "bar tags": lambda i: " | ".join(d.stuffed().split()),
    }
    words, cells = [d.word() for _ in range(3)], [d.word() for _ in range(4)]
    kinds["goods"] = lambda i: " | ".join([f"{words[0]} {r.choice(words)} {d.number()}", f"{cells[0]} {r.choice('SMLX')}", f"{d.number()} {cells[1]}", f"{cells[2]} {cells[3]}"])
    kinds["places"] = lambda i: f"{r.choice(words)} {r.choice(cells)} in {r.choice(words).title()}"
    return {name: "\n".join(line(i) for i in range(lines)) for name, line in kinds.items()}


#: Names of the profiles; prose kinds come first.
KINDS = [*PROSE, UNKNOWN, *structures(1)]
_N = len(PROSE) + 1
_USED = np.array([k for k in range(len(CLASSES)) if k not in (MID, CLOSE, SKIP)])  # near repeats tell something, others don't


def _shares(table: np.ndarray) -> np.ndarray:
    """Distributions over the classes, smoothed by half a token."""
    use = table.astype(float)
    use[:, WORD] += use[:, MID] + use[:, CLOSE]
    use = use[:, _USED] + 0.5 / len(_USED)
    return use / use.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def profiles() -> np.ndarray:
    """One distribution per kind: of the samples of prose, of all of them as they would look if no function word were known, of structures."""
    prose = read_texts(PROSE.values(), 10**9)
    unknown = prose.kind.copy()
    function = np.isin(unknown, FUNCTION)
    unknown[function] = np.where(prose.size[function] <= SHORT_LETTERS, SHORT, WORD)
    strange = np.bincount(unknown, minlength=len(CLASSES))[None, :]
    return _shares(np.concatenate((prose.table(), strange, read_texts(structures().values(), 10**9).table())))


def divergence(shares: np.ndarray, profile: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, in bits, of each row from one profile."""
    middle = (shares + profile) / 2
    return ((shares * np.log2(shares / middle)).sum(axis=1) + (profile * np.log2(profile / middle)).sum(axis=1)) / 2


def nearest(table: np.ndarray, segment_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest kind of each segment, its divergence from the nearest prose profile, and whether it isn't prose.

    A short stretch tells little by itself, so a segment counts as prose or not by how much nearer it is to the one than
    to the other, with part of the same difference of the segments before and after it in its text.
    """
    shares = _shares(table)
    distances = np.stack([divergence(shares, p) for p in profiles()], axis=1)
    prose = distances[:, :_N].min(axis=1)
    lead = (distances[:, _N:].min(axis=1) - prose).clip(-CLEAR, CLEAR)
    total = lead.copy()
    same = segment_doc[1:] == segment_doc[:-1]
    total[1:][same] += NEIGHBOURS * lead[:-1][same]
    total[:-1][same] += NEIGHBOURS * lead[1:][same]
    return distances.argmin(axis=1), prose, total < 0


_COLUMNS = {
    "chars": pa.int64(), "words": pa.int64(), "mean_word_length": pa.float64(), "symbol_ratio": pa.float64(), "line_end_ratio": pa.float64(),
    "common_word_ratio": pa.float64(), "prose_divergence": pa.float64(), "profile": pa.string(), "other_share": pa.float64(),
}


def _ratio(a: np.ndarray, b: np.ndarray) -> pa.Array:
    return pa.array(a / np.maximum(b, 1), mask=b == 0)


def of_prose(batch: Batch, least: float = 0.9) -> np.ndarray:
    """Whether each segment of a batch is of a text of which at least so large a share is prose."""
    weight = batch.by_segment(batch.size)
    prose = batch.by_doc(weight * ~nearest(batch.table(), batch.segment_doc)[2])
    return (prose >= least * batch.by_doc(weight))[batch.segment_doc]


def _measure(texts: list[str | None]) -> list[pa.Array]:
    batch = read_texts(texts)
    docs, kind, size, doc = batch.docs, batch.kind, batch.size, batch.doc
    word = (kind <= ODD) & (kind != NUMBER)
    words = np.bincount(doc[word], minlength=docs)
    letters = np.bincount(doc, size * word, docs)
    marks = np.bincount(doc, size * np.isin(kind, (SYMBOL, BAR)), docs)
    common = np.bincount(doc[np.isin(kind, FUNCTION)], minlength=docs)
    chars = np.bincount(doc, size, docs)
    nearest_kind, prose, other = nearest(batch.table(), batch.segment_doc)
    weight = batch.by_segment(size)
    votes = np.zeros((docs, len(KINDS)))
    np.add.at(votes, (batch.segment_doc, nearest_kind), weight)
    empty = chars == 0
    names = np.array(KINDS, object)[votes.argmax(axis=1)]
    return [
        pa.array([0 if t is None else len(t) for t in texts], pa.int64()),
        pa.array(words),
        _ratio(letters, words),
        _ratio(marks, chars),
        _ratio(batch.ended, batch.lines),
        _ratio(common, words),
        _ratio(batch.by_doc(prose * weight), chars),
        pa.array(names, pa.string(), mask=empty),
        pa.array(batch.by_doc(weight * other) / np.maximum(chars, 1)),
    ]


def text_statistics(documents: DataFrame, text: str = "body") -> DataFrame:
    """One row per row of ``documents``: ``doc_id`` and the statistics of ``text``, over the whole text.

    ``chars``; ``words`` (function words, other words and mixed runs of letters and digits); ``mean_word_length``;
    ``symbol_ratio``, characters of signs that aren't punctuation to all visible ones; ``line_end_ratio``, lines that end
    in sentence punctuation to lines with any token; ``common_word_ratio``, function words to words;
    ``prose_divergence``, the mean divergence from the nearest prose profile; ``profile``, the nearest profile of most
    characters; ``other_share``, the share of characters in segments that aren't prose. Ratios over nothing are null, as
    is the profile of a text without a token; its ``other_share`` is 0. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                measured = _measure(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *measured], ["doc_id", *_COLUMNS])

    spark_types = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string"}
    schema = ", ".join(["doc_id long", *(f"{name} {spark_types[kind]}" for name, kind in _COLUMNS.items())])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def not_prose(statistics: DataFrame, share: float = JUNK_SHARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows of texts that are mostly lists, tables or junk; texts of fewer than ``min_chars`` characters are left out."""
    return statistics.filter((F.col("other_share") > share) & (F.col("chars") >= min_chars))
