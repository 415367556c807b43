"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last characters cuts texts at the same places wherever
the same passage stands, so documents with a passage in common have chunks in
common. Each chunk is encoded once and remembered. Within a new chunk, words that
the worker has met before are not encoded again: white space belongs to no
token, so a chunk's tokens are those of its words. Where two chunks join, their
tokens may differ from those of the text, so a window over the join is encoded
as it stands. It is widened until, on both sides of the join, all its tokens
between the outermost ends of words are exactly those of the chunks; then it
replaces theirs in between. Windows that come to overlap go on as one, at last
as the whole text.

A text may be parted at ends of words, as no match of the splitting pattern
holds white space and no normalising step reaches across it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, id_text, small_batches, text_or_empty
from geoloom.llm.tokens import tokenizer

#: A cut falls where this many bits of the rolling hash are zero: about every 2**CUT_BITS characters.
CUT_BITS = 10
LEAST_CHUNK, MOST_CHUNK = 256, 8192
#: A worker forgets its chunks when they have so many characters together.
MOST_REMEMBERED = 8_000_000
#: A worker forgets its words once it has met so many different ones.
MOST_WORDS = 500_000
#: New words are encoded in lines of so many characters, about.
LINE = 4096
#: Characters of the first window on each side of a join.
WINDOW = 24
#: Characters that the library encodes at once, about; its results take many times their memory.
AT_ONCE = 1_000_000

_WORD = re.compile(WORD)
_WORD_END = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?=[ \t\n\r\x0b\x0c])")
#: What str.split() takes for white space besides the six characters that part words here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(piece: str) -> tuple[list[str], np.ndarray]:
    """The words of a piece and where each starts."""
    words = _WORD.findall(piece) if _OTHER_SPACE.search(piece) else piece.split()
    points = _points(piece)
    solid = (points != 32) & ((points < 9) | (points > 13))
    solid[1:] &= ~solid[:-1]
    return words, np.flatnonzero(solid)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def cuts(text: str, bits: int = CUT_BITS) -> list[int]:
    """Where the chunks of a text end. Each character's hash covers the 16 characters up to it."""
    if len(text) <= LEAST_CHUNK:
        return [len(text)]
    h = (_points(text) ^ np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    for span in (1, 2, 4, 8):
        rolled = h.copy()
        rolled[span:] += h[:-span] * np.uint32(pow(0x01000193, span, 2**32))
        h = rolled
    places = np.flatnonzero((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits) == 0) + 1
    found, last = [], 0
    for p in [*places.tolist(), len(text)]:
        while p - last > MOST_CHUNK:
            last += MOST_CHUNK
            found.append(last)
        if p - last >= LEAST_CHUNK or (p == len(text) and p > last):
            found.append(p)
            last = p
    return found


@dataclass
class Tokens:
    """Token ids, with a place for each that lies in the token's word and not after its first character."""

    ids: np.ndarray
    places: np.ndarray

    def between(self, low: int, high: int) -> Tokens:
        """The tokens of the words between two ends of words."""
        a, b = np.searchsorted(self.places, [low, high])
        return Tokens(self.ids[a:b], self.places[a:b])

    def moved(self, by: int) -> Tokens:
        return Tokens(self.ids, self.places + by)


def _joined(parts: list[Tokens]) -> Tokens:
    return Tokens(np.concatenate([p.ids for p in parts]), np.concatenate([p.places for p in parts]))


def _word_ends(text: str, low: int, high: int) -> list[int]:
    return [m.start() for m in _WORD_END.finditer(text, low, min(len(text), high + 1)) if m.start() < high]


@dataclass
class Window:
    """text[low:high], over the joins first to last; `repair` once it agrees: the tokens for all between two places."""

    low: int
    high: int
    first: int
    last: int
    repair: tuple[int, int, Tokens] | None = None


class Document:
    """A text under way: the tokens of its chunks and the windows over their joins."""

    def __init__(self, text: str):
        self.text = text
        self.ends = cuts(text)
        self.windows = [Window(max(0, c - WINDOW), min(len(text), c + WINDOW), c, c) for c in self.ends[:-1]]
        self.tokens = Tokens(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip([0, *self.ends], self.ends, strict=False)]

    def merge(self) -> None:
        """Windows that overlap become one, which is not repaired yet."""
        kept: list[Window] = []
        for w in self.windows:
            if kept and w.low < kept[-1].high:
                k = kept[-1]
                kept[-1] = Window(min(k.low, w.low), max(k.high, w.high), k.first, w.last)
            else:
                kept.append(w)
        self.windows = kept

    def settle(self, w: Window, made: Tokens) -> None:
        """Repairs the joins of a window if its tokens agree with the chunks' on both sides, else widens the sides that do not."""
        made = made.moved(w.low)
        left, right = 0, len(self.text)
        agreed = [True, True]
        if w.low > 0:
            places = _word_ends(self.text, w.low + 1, w.first + 1)
            agreed[0] = self._agree(made, places)
            left = places[-1] if places else 0
        if w.high < len(self.text):
            places = _word_ends(self.text, w.last, w.high)
            agreed[1] = self._agree(made, places)
            right = places[0] if places else right
        if all(agreed):
            w.repair = (left, right, made.between(left, right))
        if not agreed[0]:
            w.low = max(0, w.first - 2 * (w.first - w.low))
        if not agreed[1]:
            w.high = min(len(self.text), w.last + 2 * (w.high - w.last))

    def _agree(self, made: Tokens, places: list[int]) -> bool:
        if len(places) < 2:
            return False
        mine = made.between(places[0], places[-1])
        return len(mine.ids) > 0 and np.array_equal(mine.ids, self.tokens.between(places[0], places[-1]).ids)

    def ids(self) -> np.ndarray:
        parts, at = [], 0
        for w in self.windows:
            left, right, made = w.repair
            parts += [self.tokens.between(at, left).ids, made.ids]
            at = right
        return np.concatenate([*parts, self.tokens.between(at, len(self.text)).ids])


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def taken(self) -> list[str]:
        """The words numbered since this was last asked."""
        fresh, self.fresh = self.fresh, []
        return fresh


class Encoder:
    """Encodes and decodes with one tokenizer file; remembers chunks up to a fixed number of characters."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.chunks: dict[str, Tokens] = {}
        self.remembered = self.n_chunks = self.n_windows = self.n_widened = 0
        self._forget_words()

    def _forget_words(self) -> None:
        self.words = Numbers()
        self.word_ids, self.word_stops = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new chunks and remembers them."""
        if len(self.words) > MOST_WORDS:
            self._forget_words()
        numbers: list[int] = []
        starts, counts = [np.zeros(0, np.int64)], [0]
        for p in pieces:
            found, at = words_of(p)
            numbers += map(self.words.__getitem__, found)
            starts.append(at)
            counts.append(len(found))
        self._learn_words(self.words.taken())

        known, stops = self.word_ids[0], self.word_stops[0]
        row = np.array(numbers, np.int64)
        low, n = stops[row], stops[row + 1] - stops[row]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = known[np.repeat(low - before[:-1], n) + np.arange(before[-1])]
        places = np.repeat(np.concatenate(starts), n)
        bounds = before[np.cumsum(counts)].tolist()
        for p, a, b in zip(pieces, bounds, bounds[1:], strict=False):
            self.chunks[p] = Tokens(ids[a:b], places[a:b])
        self.remembered += sum(map(len, pieces))
        self.n_chunks += len(pieces)

    def _learn_words(self, new: list[str]) -> None:
        """Encodes words not met before, many in one text, and notes the ids of each behind those of the words before."""
        for first, stop in _runs([len(w) + 1 for w in new], LINE):
            line = new[first:stop]
            ends = np.cumsum([len(w) + 1 for w in line])
            made = self._windows([" ".join(line)]).popitem()[1]
            self.word_ids.append(made.ids)
            self.word_stops.append(self.word_stops[-1][-1] + np.searchsorted(made.places, ends))
        self.word_ids, self.word_stops = [np.concatenate(self.word_ids)], [np.concatenate(self.word_stops)]

    def _windows(self, pieces: list[str]) -> dict[str, Tokens]:
        """Encodes windows as they stand."""
        found: dict[str, Tokens] = {}
        for first, stop in _runs([len(p) for p in pieces]):
            for p, e in zip(pieces[first:stop], self.library.encode_batch(pieces[first:stop], add_special_tokens=False), strict=True):
                found[p] = Tokens(np.array(e.ids, np.uint32), np.array([o[0] for o in e.offsets], np.int64))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        docs = [Document(t) for t in texts]
        if self.remembered > MOST_REMEMBERED:
            self.chunks.clear()
            self.remembered = 0
        self._learn(list(dict.fromkeys(p for d in docs for p in d.pieces() if p and p not in self.chunks)))
        for d in docs:
            if d.text:
                starts = [0, *d.ends[:-1]]
                d.tokens = _joined([self.chunks[p].moved(a) for p, a in zip(d.pieces(), starts, strict=True)])
        while True:
            for d in docs:
                d.merge()
            todo = [(d, w) for d in docs for w in d.windows if w.repair is None]
            if not todo:
                return [d.ids() for d in docs]
            made = self._windows(list(dict.fromkeys(d.text[w.low : w.high] for d, w in todo)))
            self.n_windows += len(made)
            for d, w in todo:
                d.settle(w, made[d.text[w.low : w.high]])
                self.n_widened += w.repair is None

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each row of ids."""
        found: list[str] = []
        for first, stop in _runs([len(i) for i in ids]):
            found += self.library.decode_batch([i.tolist() for i in ids[first:stop]], skip_special_tokens=False)
        return found


def _runs(sizes: list[int], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about `most` together."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file."""
    return _encoders.setdefault(path, Encoder(path)) if path not in _encoders else _encoders[path]


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text of docs(doc_id, text), without added special tokens.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and
    decoded. Null counts as empty: no ids and an empty text. Rows are encoded
    one by one, so repeated rows and null ids stay as they are, and an empty
    table stays empty. Other columns of docs are ignored. No shuffle is needed.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for first, stop in _runs([len(t) for t in texts]):
                made = encoder(path).encode(texts[first:stop])
                packed = [i.astype("<u4").tobytes() for i in made]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[first:stop].array, "n_tokens": list(map(len, made)), "ids": packed, "decoded": encoder(path).decode(made)})

    made = docs.select(id_text().alias("doc_id"), text_or_empty().alias("text")).mapInPandas(encode, "doc_id string, n_tokens long, ids binary, decoded string")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_table, with SHA-256 digests for ids and decoded text: ids_sha256, decoded_sha256."""
    return encode_table(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
