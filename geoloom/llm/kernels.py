"""Vectorised text kernels for Arrow batches: words, hashes, shingle sets.

All work on one block of texts at a time: the texts become one byte array and
each step is a few NumPy passes over it. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are worked on in blocks of about this many bytes, so memory does not follow the batch.
BLOCK_BYTES = 4_000_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_WIDTH = np.uint64(8)
#: Only A-Z are lowered; other letters stay as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes that are neither letters nor digits; they separate bare words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit number over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def blocks(texts: list[str], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8, in runs of about `most` bytes, each with the index of its first text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.encode())
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class Words:
    """The words of a block: byte ranges in `buf`, the text of each, and how many each text has."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE_BYTES, lower: bool = True):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.buf = LOWER[raw] if lower else raw
        ends = np.flatnonzero(separators[raw])
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        full = ends > starts
        self.start, self.end = starts[full], ends[full]
        text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        self.text = np.searchsorted(text_ends, self.start, side="right")
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from its length and its bytes, eight at a time."""
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * _MUL)
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded, (len(self.buf) + 1, 8), (1, 1))
        left = np.arange(len(size))
        at = 0
        while len(left):
            piece = np.ascontiguousarray(eights[self.start[left] + at]).view(np.uint64)[:, 0]
            unused = np.uint64(64) - _WIDTH * np.clip(size[left] - at, 1, 8).astype(np.uint64)
            out[left] = mix((out[left] ^ (piece << unused)) * _MUL)
            at += 8
            left = left[size[left] > at]
        return out


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct `width`-word shingles of each text as sorted 64-bit hashes, end to end, and their counts.

    A text with fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    words = Words(texts)
    hashes = words.hashes()
    n = len(hashes)
    place = np.arange(n) - words.first[words.text]
    left = words.count[words.text] - place
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        shifted = np.zeros(n, np.uint64)
        shifted[: max(0, n - j)] = hashes[j:]
        rolled = np.where(left > j, mix((rolled ^ shifted) * _MUL + np.uint64(j + 1)), rolled)
    whole = (left >= width) | ((place == 0) & (left < width))
    shingles, owner = rolled[whole], words.text[whole]
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.bincount(owner[new], minlength=len(texts))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted distinct arrays have in common."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())
