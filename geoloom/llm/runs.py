"""Periodic runs of words: Lyndon arrays over ordered words, with reuse of matched extensions.

Every run has a root that is the longest Lyndon word at its place, under the
order of the words or under the opposite one. So the runs are found among the
pairs (i, next smaller suffix of i): the pair's distance is the period, and
what the two suffixes have in common to the right and to the left is the rest
of the run.

Both orders are scanned once, from left to right. A comparison of two suffixes
starts from what earlier comparisons have matched: inside the match that
reaches furthest, results are copied from the place it repeats, and only words
beyond its end are looked at. So every word is matched once, and no suffix
structure and no hash is needed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import id_text, small_batches, text_or_empty

#: A run has so many words, and so many periods, at least.
FEWEST_WORDS, FEWEST_PERIODS = 6, 4
#: Words in a window that a run repeats, and how often.
WINDOW, REPEATS = 3, 3
#: So many words fit three to a window in 63 bits; beyond them pairs of words are numbered first.
MOST_CODES = 1 << 21


def next_smaller(codes: list[int]) -> tuple[list[int], list[int]]:
    """Of each place the next smaller suffix, and how many words the two have in common.

    A suffix that is the beginning of another is smaller. The place after the
    last is the empty suffix, smaller than all.
    """
    n = len(codes)
    t = [*codes, -1]
    after, after_common = [n] * n, [0] * n
    before, before_common = [-1] * n, [0] * n
    # The match that reaches furthest: words from `left` and from `right` are equal up to `reach`.
    left = right = reach = 0
    for r in range(1, n):
        at, known, copied = r - 1, 0, r < reach
        while at >= 0:
            if copied and at >= right:
                # This pair repeats an earlier one inside the match; that one's result holds up to its end.
                shift = right - left
                common = after_common[at - shift] if after[at - shift] == r - shift else before_common[r - shift] if before[r - shift] == at - shift else 0
                common = min(common, reach - r)
                settled = common < reach - r and t[at + common] != t[r + common]
            else:
                common, settled = known, t[at + known] != t[r + known]
            if not settled:
                while t[at + common] == t[r + common]:
                    common += 1
                if r + common > reach:
                    left, right, reach, copied = at, r, r + common, False
            if t[at + common] > t[r + common]:
                after[at], after_common[at] = r, common
                # The next one is smaller than `at`, so it has as much in common with r, or more.
                known = min(common, before_common[at])
                at = before[at]
            else:
                before[r], before_common[r] = at, common
                break
    return after, after_common


def runs_of(codes: list[int], most_code: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of FEWEST_WORDS words and FEWEST_PERIODS periods or more, by start and period."""
    found: set[tuple[int, int]] = set()
    runs = []
    for ordered in (codes, [most_code - c for c in codes]):
        after, common = next_smaller(ordered)
        for i, (j, right) in enumerate(zip(after, common, strict=True)):
            period = j - i
            least = max(FEWEST_WORDS, FEWEST_PERIODS * period)
            # Left of its first root a run has less than a period; later roots have the same end.
            if right + 2 * period <= least or (period, j + right) in found:
                continue
            back = 0
            while back < i and back < period and codes[i - back - 1] == codes[j - back - 1]:
                back += 1
            length = back + period + right
            if length >= least:
                found.add((period, j + right))
                runs.append((i - back, length, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can lie: ranges (start, end) whose every window of WINDOW words stands there REPEATS times or more.

    A run of four periods and six words holds each of its windows of three
    words three times: it has length - 2 of them, and these are 3 * period or
    more. It also lies in one range, since all its windows follow one another.
    Counting is repeated inside the ranges until they stay; what is left out
    holds no run, and a run ends where it would in the whole text, since a
    longer one would lie in the range too.
    """
    n = len(codes) - WINDOW + 1
    if n < FEWEST_WORDS - WINDOW + 1:
        return []
    factor = int(codes.max()) + 1
    windows = codes[:n]
    for k in range(1, WINDOW):
        if factor > MOST_CODES and k > 1:
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * factor + codes[k : k + n]
    places = np.arange(n)
    while True:
        # Ranges are runs of neighbouring places; a window is told apart by its range.
        begins = np.concatenate([[True], np.diff(places) != 1])
        owner = np.cumsum(begins) - 1
        order = np.lexsort((windows[places], owner))
        w, o = windows[places][order], owner[order]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])
        group = np.cumsum(new) - 1
        enough = np.empty(len(places), bool)
        enough[order] = np.bincount(group)[group] >= REPEATS
        # A run of six words has four windows.
        size = np.bincount(owner)[owner]
        enough &= size >= FEWEST_WORDS - WINDOW + 1
        if enough.all():
            break
        places = places[enough]
        if not len(places):
            return []
    firsts = places[begins]
    lasts = places[np.concatenate([np.flatnonzero(begins)[1:] - 1, [len(places) - 1]])]
    return [(int(a), int(b) + WINDOW) for a, b in zip(firsts, lasts, strict=True)]


def looped(words: list, doc_id: str | None) -> list:
    """The words with the tail that the id's checksum asks for: one document of ten repeats a stretch to its end."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (1 + (n - a) // p))[: n - a]


def document_runs(words: list) -> list[tuple[int, int, int]]:
    """The runs of a document's words, by start and period."""
    if len(words) < FEWEST_WORDS:
        return []
    code = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    return sorted(((a + s, m, q) for a, b in stretches(codes) for s, m, q in runs_of(codes[a:b].tolist(), len(code))), key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words), bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return [w for w, d in zip(words, dropped.tolist(), strict=True) if not d]


OUT = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length for its period, by whole numbers; the first of equal ones."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            words = looped(text.encode().split(), doc_id if isinstance(doc_id, str) else None)
            runs = document_runs(words)
            said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
            best = (None,) * 4 if not runs else (*(r := _strongest(runs)), 1000 * r[1] // r[2])
            out.append((doc_id, len(runs), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
        made = pd.DataFrame(out, columns=OUT_NAMES)
        yield made.astype(dict.fromkeys(OUT_NAMES[1:6], "Int64"))


def run_audit(docs: DataFrame) -> DataFrame:
    """The periodic runs in the words of each row of docs(doc_id, text).

    Words are runs other than U+0009 to U+000D and space, as they stand. One
    document of ten, by the CRC-32 of its id, is looked at with a tail that
    repeats itself (`looped`). A run is a stretch with smallest period q and
    max(6, 4 * q) words or more that no neighbouring word extends.

    Returns doc_id, n_runs, start, length, period and exponent_milli of the run
    with the greatest length / period (null without runs), runs_sha256 of the
    list of runs, collapsed_sha256 of the words without repeats. Null, empty
    and blank texts have no words and no runs. A null doc_id asks for no
    repeated tail. Repeated rows get equal results; an empty table gives no
    rows. Other columns are ignored. Each row is worked on by itself, in memory
    that follows its own text; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(id_text().alias("doc_id"), text_or_empty().alias("text")).mapInPandas(_audited, OUT)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
