"""What the stretches of a text are made of: tokens, their classes, and segments of about equal length.

Used by the operators that tell prose from lists, tables, junk and spam. A whole batch of texts becomes one array of
token classes with the bounds of segments and documents, so everything after the tokeniser is array arithmetic.

Function words are known for four languages. In others they are unknown words of three letters or fewer, mostly, which
have a class of their own (``SHORT``). A longer word has a class by how near the same word stands before or after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Closed word classes of four languages.
DETERMINERS = """the a an this that these those some any each every no le la les un une des du au aux ce cette ces son sa ses
der die das den dem des ein eine einen einem einer eines kein diese el los las una unos lo al del este esta su sus""".split()
PREPOSITIONS = """of in to by for on with at from into under over between during after before near until through about as
de à dans par pour sur avec en entre sous depuis vers chez von zu im am zum zur mit bei nach aus auf an durch für
zwischen seit über unter vor con por para sobre desde hasta según""".split()
CONJUNCTIONS = "and or but nor if because though which who when where while than et ou mais que qui où und oder aber dass wenn y e o pero ni".split()
PRONOUNS = """it he she they we you i his her its their your our us il elle on nous vous ils y se er sie es wir ihr sich man él
ella ellos nos not ne pas nicht there also no aussi auch también""".split()
AUXILIARIES = """is are was were be been being has had have do does did will would can could may might must should est sont était
fut ont a été avait être peut ist sind war wurde wurden worden werden hat haben hatte kann es son fue era había sido ha han
está ser hay""".split()

CLASSES = "DET PREP CONJ PRON AUX SHORT WORD MID CLOSE NEAR NUMBER MIXED ODD LINK TAG END COMMA COLON BAR SYMBOL MARK SKIP".split()
DET, PREP, CONJ, PRON, AUX, SHORT, WORD, MID, CLOSE, NEAR, NUMBER, MIXED, ODD, LINK, TAG, END, COMMA, COLON, BAR, SYMBOL, MARK, SKIP = range(len(CLASSES))
FUNCTION = (DET, PREP, CONJ, PRON, AUX)

_FUNCTION_WORDS: dict[str, int] = {}
for _kind, _list in ((DET, DETERMINERS), (PREP, PREPOSITIONS), (CONJ, CONJUNCTIONS), (PRON, PRONOUNS), (AUX, AUXILIARIES)):
    for _word in _list:
        _FUNCTION_WORDS.setdefault(_word, _kind)

#: A bracket with nothing but figures, a link, a number, a run of letters and digits, or a run of other signs.
TOKEN = re.compile(
    r"\([^()\w]*\d[\d\s.,;:/°′″–-]*\)"
    r"|(?:https?://|www\.)[^\s<>\"')\]]+"
    r"|[^\W_][\w-]*(?:\.[\w-]+)*\.[a-z]{2,12}/[^\s<>\"')\]]*"
    r"|[^\W_]+(?:-[^\W_]+)*(?:\.[^\W_]+(?:-[^\W_]+)*)+\.[a-z]{2,12}\b"
    r"|[^\W_]+(?:-[^\W_]+)+\.[a-z]{2,12}\b"
    r"|\d+(?:[.,]\d+)*(?![^\W_])"
    r"|(?:[^\W\d_]|[Qq]u)['’](?=[^\W\d_])"
    r"|#?[^\W_]+"
    r"|\t| {3,}"
    r"|[^\w\s]+|_+"
)
#: What an entry of a list begins with: a bullet, a number or a letter.
_MARK = re.compile(r"\s*(?:[•*·‣◦▪–—+>-]+|\(?\d{1,4}[.)]|\(?[A-Za-z][.)])\s+(?=\S)")
_LINK = re.compile(r"https?:|www\.|.*[^\W\d_].*\.[^\W_]")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxzß]{5,}|^[^aeiouyáéíóúàèìòùâêîôûäëïöüœæ]{4,}$")
_QUOTES = set("\"'’‘“”„«»「」()[]-–—*_")
_LINE_ENDS = frozenset(".!?…。！？।؟\"”»)")
_ENDS, _COMMAS, _COLONS = set(".!?…。！？।؟"), set(",،、，"), set(":;：；؛")

#: Tokens of a segment; a line of twice as many is cut.
SEGMENT_TOKENS = 24
#: Unknown words of at most so many letters may be function words of another language.
SHORT_LETTERS = 3
#: A word is ``NEAR``, ``CLOSE`` or ``MID`` if the same word stands at most so many words before or after it; shorter ones never are.
REACH = ((8, NEAR), (12, CLOSE), (24, MID))
REPEATED_LETTERS = 3


def classify(token: str) -> int:
    """The class of one token, without regard to its text."""
    head = token[0]
    if head == "\0":
        return MARK
    if token[-1] in "'’" and head.isalpha():  # an elided article or pronoun, as in l'eau
        return DET
    if head.isalnum():
        if token.isalpha():
            kind = _FUNCTION_WORDS.get(token.lower())
            if kind is not None:
                return kind
            if len(token) <= SHORT_LETTERS and not token.isupper():
                return SHORT
            odd = len(token) > 26 or head.isascii() and (len(token) == 1 or _HARD.search(token.lower()))
            return ODD if odd else WORD
        if not any(c.isalpha() for c in token):
            return NUMBER
        return LINK if _LINK.match(token) else MIXED
    if head in "\t ":
        return BAR
    if token[-1] == ")" and len(token) > 2 and any(c.isdigit() for c in token):
        return SKIP
    signs = set(token)
    if signs <= _ENDS | _QUOTES and signs & _ENDS:
        return END if len(token) <= 4 else SYMBOL
    if head == "#" and token[-1].isalnum():
        return TAG if any(c.isalpha() for c in token) else NUMBER
    if signs <= _COMMAS | _QUOTES and signs & _COMMAS:
        return COMMA
    if signs <= _COLONS | _QUOTES and signs & _COLONS:
        return COLON
    if signs <= _QUOTES:
        return SKIP if len(token) <= 3 else SYMBOL
    return BAR if signs <= {"|", "/", "\\", "·", "•", ">"} else SYMBOL


class _Tokens:
    """Tokens seen by this worker: a number for each, with its class, its length and the number of its lower-case form."""

    MOST = 600_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.kind: list[int] = []
        self.size: list[int] = []
        self.low: list[int] = []
        self._words: dict[str, int] = {}

    def add(self, token: str) -> int:
        n = self.number[token] = len(self.kind)
        self.kind.append(classify(token))
        self.size.append(len(token.strip()))
        self.low.append(self._words.setdefault(token.lower(), n))
        return n


_seen = _Tokens()


@dataclass
class Batch:
    """Tokens of several texts end to end."""

    kind: np.ndarray  #: class of each token
    size: np.ndarray  #: its characters
    segment: np.ndarray  #: number of its segment
    doc: np.ndarray  #: number of its text
    segment_doc: np.ndarray  #: text of each segment
    docs: int
    lines: np.ndarray  #: lines with a token, by text
    ended: np.ndarray  #: of them, lines that end in sentence punctuation

    def by_segment(self, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.segment, weights, len(self.segment_doc))

    def by_doc(self, of_segments: np.ndarray) -> np.ndarray:
        return np.bincount(self.segment_doc, of_segments, self.docs)

    def table(self) -> np.ndarray:
        """Number of tokens of each class in each segment."""
        n = len(CLASSES)
        return np.bincount(self.segment * n + self.kind, minlength=n * len(self.segment_doc)).reshape(-1, n)


def _repeats(kind: np.ndarray, size: np.ndarray, low: np.ndarray, doc: np.ndarray) -> None:
    """Give longer words that stand near the same word of their text a class by the distance; ``kind`` is changed."""
    place = np.cumsum(kind <= LINK)  # counts words, not signs
    may = np.flatnonzero(((kind == WORD) | (kind == MIXED) | (kind == ODD)) & (size >= REPEATED_LETTERS))
    if len(may) < 2:
        return
    key = doc[may] * np.int64(low.max() + 1) + low[may]
    order = np.argsort(key, kind="stable")
    at, same = place[may][order], key[order][1:] == key[order][:-1]
    gap = np.where(same, at[1:] - at[:-1], np.iinfo(np.int64).max)
    nearest = np.minimum(np.append(np.iinfo(np.int64).max, gap), np.append(gap, np.iinfo(np.int64).max))
    for most, name in reversed(REACH):
        kind[may[order[nearest <= most]]] = name


def read_texts(texts: Iterable[str | None], segment_tokens: int = SEGMENT_TOKENS) -> Batch:
    """Tokens, classes and segments of ``texts``. A segment is some whole lines or a piece of a long line."""
    if len(_seen.number) > _Tokens.MOST:
        _seen.clear()
    find, get, add = TOKEN.findall, _seen.number.get, _seen.add
    numbers: list[int] = []
    cuts: list[int] = []  # ends of segments
    segment_docs: list[int] = []
    ends: list[int] = []
    lines, ended = [], []
    for d, text in enumerate(texts):
        begin = first = len(numbers)
        n_lines = n_ended = 0
        text = text or ""
        if text.isupper():  # shouted: letter case tells nothing
            text = text.lower()
        for line in text.splitlines():
            mark = _MARK.match(line)
            found = find(line, mark.end()) if mark else find(line)
            if mark:
                found.insert(0, "\0")
            elif not found:
                continue
            n_lines += 1
            n_ended += line.rstrip()[-1:] in _LINE_ENDS
            for t in found:
                n = get(t)
                numbers.append(add(t) if n is None else n)
            held = len(numbers) - begin
            if len(found) >= segment_tokens:  # a paragraph: what stands before it is a segment of its own, unless tiny
                if held - len(found) >= segment_tokens // 3:
                    begin += held - len(found)
                    cuts.append(begin)
                    segment_docs.append(d)
                    held = len(found)
                pieces = max(1, round(held / segment_tokens))
                cuts += [begin + held * p // pieces for p in range(1, pieces + 1)]
                segment_docs += [d] * pieces
                begin = len(numbers)
            elif held >= segment_tokens:
                cuts.append(len(numbers))
                segment_docs.append(d)
                begin = len(numbers)
        if begin < len(numbers):  # a short rest joins the segment before, if there is one
            if begin > first and len(numbers) - begin < segment_tokens // 2:
                cuts[-1] = len(numbers)
            else:
                cuts.append(len(numbers))
                segment_docs.append(d)
        ends.append(len(numbers))
        lines.append(n_lines)
        ended.append(n_ended)
    number = np.array(numbers, np.int64)
    kinds, sizes, lows = (np.array(x, np.int64) for x in (_seen.kind, _seen.size, _seen.low))
    kind = kinds[number] if len(number) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.array([0, *ends])))
    segment = np.repeat(np.arange(len(cuts)), np.diff(np.array([0, *cuts])))
    if len(number):
        _repeats(kind, sizes[number], lows[number], doc)
    return Batch(kind, sizes[number] if len(number) else number, segment, doc, np.array(segment_docs, np.int64), len(ends), np.array(lines), np.array(ended))


def portions(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``most_bytes``; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


# Samples of prose, one per language: from them come the profile of prose and the class model of sentences.
PROSE = {
    "en": """The harbour was built in the twelfth century by merchants from the north, and for a long time it remained the
only safe landing between the two rivers. When the king visited the town in 1384 he gave it the right to hold a market on
the first day of each month. Most of the houses near the water were lost in a fire that began in a bakery, but the old
church, which stands on a hill, was not damaged. Its tower had been planned as a watch post, and it is still used by the
fishermen of the island. After the war the population fell, and many of the young people moved to the cities in the east
to look for work. In 1926 the council bought the ruins of the castle and turned them into a school with a garden.""",
    "figures": """The species is found in Kenya and Uganda, at 500 to 2,300 feet. It was described by Miller in 1871. Adults
measure 9.5 inches and weigh 12 ounces. The parish covers 31.4 square miles and had 4,210 people in 1901. It lies 14 miles
from Dover and has two schools, a library and a park. In 1866 the council counted 3,400 sheep and 28 wells, and by 1950 the
river had moved 60 feet to the west.""",
    "fr": """Le pont fut construit au début du siècle par un ingénieur de la région, avec l'aide des habitants de la vallée.
Il n'a jamais été détruit, mais la rivière a souvent emporté une partie du chemin qui mène au village. Dans les années qui
suivirent la guerre, la commune a vendu la forêt et les terres pour payer une école et une petite gare. On y trouve aussi
un château ancien, abandonné depuis la mort de son dernier propriétaire, et une chapelle dont les murs sont couverts de
peintures. Selon les archives, la ville avait plus de mille habitants en 1790.""",
    "de": """Die Stadt liegt am Ufer eines kleinen Sees und wurde im Jahr 1250 zum ersten Mal in einer Urkunde genannt. Nach
dem großen Brand haben die Bürger das Rathaus und die Kirche mit den Steinen der alten Burg wieder aufgebaut. Der Turm ist
seit dem Krieg nicht mehr benutzt worden, aber er steht noch immer neben der Mühle. Es gab dort auch eine Schule, einen
Markt und zwei Brücken, die von den Bauern der Gegend oft benutzt wurden. Heute leben in dem Ort etwa dreihundert Menschen,
und viele von ihnen arbeiten in der Fabrik zwischen dem Bahnhof und dem Hafen.""",
    "es": """El pueblo fue fundado por los monjes que llegaron del sur en el siglo once, y durante mucho tiempo no hubo otro
camino hacia la costa. Según la tradición, la reina dejó su corona en la iglesia después de la batalla. También se ha
construido un puente de piedra cerca del molino, donde hay una escuela y una plaza con árboles. La mayor parte de las casas
fueron destruidas por el río en 1871, pero la torre había sido reparada antes y no cayó. En la actualidad la región es
conocida por su vino y por las fiestas de la cosecha.""",
}
