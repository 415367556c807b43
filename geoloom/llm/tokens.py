"""Token counts with overlap resynchronisation of huge documents.

Chunks of a huge document overlap. Each chunk is encoded with offsets, and two
neighbours are spliced where both have a token boundary at a place proven to be
stable. If an overlap has no such place, it is widened back to the nearest one;
if the chunk has none at all, it is lengthened to the next one. So a document
is encoded about once, whatever it is made of.

A place is stable if what stands on its two sides is split alike alone and
together. The byte-level pattern takes runs of letters, of digits or of signs,
each with one space before it, runs of white space, and contractions after an
apostrophe. No match goes on from a character that is not white space into
white space, nor from a letter, digit or sign into one of another class, unless
an apostrophe comes first; and only runs of white space look ahead, by one
character. So a place is stable
* before white space that follows another character, and
* between a letter, a digit and a sign that is no apostrophe, in any order,
unless it lies inside the string of a special token. Classes are named for
common scripts only; characters beyond them give no places.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import id_text, small_batches, text_or_empty

#: Longer texts are huge: they are encoded in overlapping chunks of so many code points.
CHUNK = 16_384
OVERLAP = 256
TOKEN_LIMIT = 1024
#: Counts of pieces between stable places that a worker remembers; it forgets them all when full.
MOST_REMEMBERED = 1_000_000

_BESIDE_SPACE = re.compile(r"\s | \s|\A | \Z")
_STABLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿΑ-Ρα-ωА-яぁ-ゖァ-ヺ一-鿿가-힣"
_SIGN = r"!-&(-/:-@\[-`{-~、。〈-】！（），：；？"
_STABLE = re.compile(
    rf"(?<=[^\s\u180e\u200b\ufeff])(?=[ \t\n\r\x0b\x0c])|(?<=[{_LETTER}])(?=[0-9'{_SIGN}])|(?<=[0-9])(?=['{_SIGN}{_LETTER}])|(?<=[{_SIGN}])(?=[0-9{_LETTER}])"
)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizers library's own; one for each worker process, in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def stable_pieces(text: str) -> list[str]:
    """The text cut before every stable space; the pieces after the first begin with it."""
    parts = _STABLE_SPACE.split(text) if _BESIDE_SPACE.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def _boundaries(offsets: list[tuple[int, int]], base: int) -> dict[int, int]:
    """Position in the text at which a token starts: the token's number. Tokens inside one character are left out."""
    found: dict[int, int] = {}
    for k, (start, _) in enumerate(offsets):
        if k == 0 or offsets[k - 1][1] <= start:
            found.setdefault(base + start, k)
    return found


@lru_cache(maxsize=4)
def _specials(path: str) -> re.Pattern | None:
    """The strings that the library takes for special tokens wherever they stand."""
    strings = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, sorted(strings, key=len, reverse=True)))) if strings else None


def stable_places(text: str, low: int, high: int, path: str) -> list[int]:
    """The stable places p of a text with low <= p < high."""
    specials = _specials(path)
    longest = max(map(len, specials.pattern.split("|"))) if specials else 0
    inside = [(m.start(), m.end()) for m in specials.finditer(text, max(0, low - longest), min(len(text), high + longest))] if specials else []
    places = [m.start() for m in _STABLE.finditer(text, low, min(len(text), high + 1)) if m.start() < high]
    return [p for p in places if not any(a < p < b for a, b in inside)] if inside else places


def _next_stable(text: str, low: int, path: str, step: int) -> int:
    """The first stable place from low on, or the text's end."""
    while low < len(text):
        if found := stable_places(text, low, low + step, path):
            return found[0]
        low += step
    return len(text)


def encode_overlapping(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a whole text from overlapping chunks; the same as of one encoding."""
    library = tokenizer(path)
    ids: list[int] = []
    start, stop = 0, min(len(text), chunk)
    now, skip = None, 0  # skip: tokens of the present chunk that the one before it has given
    while stop < len(text):
        wide, place = overlap, None
        while place is None:
            following = max(start, stop - wide)
            stable = stable_places(text, following + 1, stop, path)
            if not stable and following > start:
                wide *= 2
            elif not stable:
                # No stable place in this chunk: it goes on to beyond the next one.
                stop = min(len(text), _next_stable(text, stop, path, chunk) + 1)
                now, wide = None, overlap
                if stop == len(text):
                    break
            else:
                now = now or library.encode(text[start:stop], add_special_tokens=False)
                stop_after = min(len(text), following + max(chunk, 2 * wide))
                after = library.encode(text[following:stop_after], add_special_tokens=False)
                left, right = _boundaries(now.offsets, start), _boundaries(after.offsets, following)
                place = next((p for p in stable if p in left and p in right and left[p] >= skip), None)
                if place is None and following == start:
                    raise ValueError(f"no common boundary at a stable place before {stop}")
                wide *= 2
        if place is None:
            break
        ids += now.ids[skip : left[place]]
        start, stop, now, skip = following, stop_after, after, right[place]
    now = now or library.encode(text[start:stop], add_special_tokens=False)
    return ids + now.ids[skip:]


_counts: dict[str, dict[str, int]] = {}


def count_tokens(texts: list[str], path: str, huge: int = CHUNK) -> list[int]:
    """Tokens of each text. Huge texts are encoded in overlapping chunks; of all others, which are one chunk each, the pieces between stable spaces are encoded once in a worker."""
    known = _counts.setdefault(path, {})
    if len(known) > MOST_REMEMBERED:
        known.clear()
    cut = [stable_pieces(t) if len(t) <= huge else None for t in texts]
    new = list({p for pieces in cut if pieces for p in pieces} - known.keys())
    for at in range(0, len(new), 20_000):
        some = new[at : at + 20_000]
        known.update(zip(some, (len(e) for e in tokenizer(path).encode_batch_fast(some, add_special_tokens=False)), strict=True))
    return [len(encode_overlapping(t, path)) if pieces is None else sum(map(known.__getitem__, pieces)) for t, pieces in zip(texts, cut, strict=True)]


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Counts the tokens of every whole text of docs(doc_id, text), without added special tokens.

    Strings of special tokens inside a text are handled as the library does by
    default. Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).
    Null counts as empty: 0 bytes and 0 tokens. Rows are counted one by one, so
    repeated rows and null ids stay as they are, and an empty table stays empty.
    Other columns of docs are ignored. No shuffle is needed.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pdf[["doc_id", "n_bytes"]].copy()
            made["n_tokens"] = count_tokens(pdf["text"].tolist(), path)
            yield made.assign(over_limit=made["n_tokens"] > limit)

    base = docs.select(id_text().alias("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    counted = base.mapInPandas(count, "doc_id string, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumn("doc_id", F.col("doc_id").cast("long"))
