"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions. Two fingerprints
that differ in 3 bits or fewer differ in 3 bytes at most, so they share at
least 5 bytes at the same positions: that is the guaranteed minimum.

Lists of single bytes would hold a 256th of all fingerprints each. The index
therefore takes bytes by threes: of any 5 positions out of 8, some 3 lie
together in the lower or in the upper half, so the 8 triples of the two halves
put every near pair into one list at least. Lists that are still large get a
fourth and a fifth byte, by the same argument: of the positions left over, a
near pair shares 2 of 5, then 1 of 4. Inside a list the shared positional
bytes of a pair are tallied, pairs below the minimum go, and the others are
verified by their bits.

Equal fingerprints are one class, so copies never meet in a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import dropped, id_text, small_batches, text_or_empty, written
from geoloom.llm.kernels import LOWER
from geoloom.llm.neardup import NO_ID, components

WIDTH, SEED = 3, 42
BITS, BYTES = 3, 8
#: The shared positional bytes that near fingerprints have at least.
FEWEST = BYTES - BITS
#: Three positions out of either half: every five of the eight hold one of these.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: A list of more members gets one more byte; a list with FEWEST bytes that still has more is split in parts that meet two by two.
LISTED = 16_384
#: Lists up to this size are compared all at once, larger ones member by member.
SMALL = 16
#: Shingles whose bits are added up at once.
BLOCK = 1 << 16
#: What names a list: its byte positions, the bytes there, and the parts of a split one.
LIST = ("mask", "value", "part")

_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_LOWERED = LOWER.tobytes()


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text: each bit by the majority of its shingles' hashes; 0 without words."""
    words = text.translate(_LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - WIDTH)
    starts, ends = starts[: last + 1], ends[min(WIDTH, len(words)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        some = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = np.array([fingerprint(t.encode()) for t in pdf["text"]], np.uint64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "print": found.view(np.int64)})


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of their eight bytes two fingerprints share at the same positions: the zero bytes of their difference."""
    d = x ^ y
    full = (((d & _LOW) + _LOW) | d) & _HIGH
    return BYTES - np.bitwise_count(full).astype(np.int64)


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs link: those that reach the minimum of shared bytes are verified by their bits."""
    kept = shared_bytes(x, y) >= FEWEST
    if kept.any():
        x, y = np.broadcast_arrays(x, y)
        kept[kept] = np.bitwise_count(x[kept] ^ y[kept]) <= BITS
    return kept


def _grown(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of one list: each member meets only those that no component has yet."""
    left, links = members, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(left, x)
            links += [(int(x), int(y)) for y in left[hit]]
            queue += list(left[hit])
            left = left[~hit]
    return links


def _all_pairs(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Near pairs of many small lists, which lie end to end, at once."""
    at = np.arange(len(members))
    partners = np.repeat(np.cumsum(sizes), sizes) - at - 1
    first = np.repeat(at, partners)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(partners) - partners, partners)
    x, y = members[first], members[second]
    hit = near(x, y)
    return np.stack([x[hit], y[hit]], axis=1)


def list_links(keys: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Links (a, b) of the lists that lie end to end, told apart by the rows of keys."""
    if not len(keys):
        return np.empty((0, 2), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(keys)))
    few = sizes <= SMALL
    found = [_all_pairs(members[np.repeat(few, sizes)], sizes[few])]
    found += [np.array(_grown(members[at : at + n]), np.uint64).reshape(-1, 2) for at, n in zip(starts[~few], sizes[~few], strict=True)]
    pairs = np.sort(np.concatenate(found).view(np.int64), axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists come in order; the last list of a batch waits for the next batch, as it may go on there."""
    keys, members = np.empty((0, len(LIST)), np.int64), np.empty(0, np.uint64)
    for pdf in batches:
        keys = np.concatenate([keys, pdf[list(LIST)].to_numpy(np.int64)])
        members = np.concatenate([members, pdf["print"].to_numpy(np.int64).view(np.uint64)])
        whole = int((keys != keys[-1]).any(axis=1).sum()) if len(keys) else 0
        if whole:
            yield pd.DataFrame(list_links(keys[:whole], members[:whole]), columns=["a", "b"])
            keys, members = keys[whole:], members[whole:]
    yield pd.DataFrame(list_links(keys, members), columns=["a", "b"])


def _signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def _mask(positions) -> int:
    """All bits of the bytes at these positions, as a signed long."""
    return _signed(sum(255 << (8 * p) for p in positions))


def candidate_lists(prints: DataFrame, limit: int = LISTED) -> DataFrame:
    """The inverted index over distinct prints(print): LIST, print, where near prints share a list at least once.

    A list is named by its positions (mask) and the bytes there (value). Large
    ones are split by the bytes of further positions: of the five positions
    beside a triple a near pair shares two, so four of them are enough, and of
    the four beside those one, so all four are taken. What is large with FEWEST
    bytes shared is dealt into parts of about limit members, and all pairs of
    parts meet, each as one list.
    """
    masks = lambda each: F.array(*[F.lit(_mask(p)).cast("long") for p in each])
    single = masks([p] for p in range(BYTES))
    level = prints.select("print", F.explode(masks(TRIPLES)).alias("mask"))
    done = []
    for used in range(3, FEWEST + 1):
        valued = level.withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
        shared = valued.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        rows = written(valued.join(shared, ["mask", "value"]), "simhash-lists")
        done.append(rows.where(F.col("n") <= limit).select("mask", "value", F.lit(0).alias("part"), "print"))
        large = rows.where(F.col("n") > limit)
        if large.isEmpty():
            break
        if used < FEWEST:
            others = F.slice(F.filter(single, lambda m: m.bitwiseAND(F.col("mask")) == 0), 1, 4)
            level = large.select("print", "mask", F.explode(others).alias("more")).select("print", F.col("mask").bitwiseOR(F.col("more")).alias("mask")).distinct()
        else:
            parts = F.ceil(F.col("n") / limit).cast("int")
            dealt = large.withColumns({"parts": parts, "own": F.pmod(F.xxhash64("print"), parts).cast("int")})
            meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, "own") * F.col("parts") + F.greatest(k, "own"))
            done.append(dealt.select("mask", "value", F.explode(meets).alias("part"), "print"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, limit: int = LISTED) -> DataFrame:
    """Groups the rows of docs(doc_id, text) whose SimHash fingerprints differ in 3 bits or fewer, directly or through others.

    Words are runs other than U+0009 to U+000D and space, A-Z lowered; a
    document's shingles are its three-word windows, repeats included, or its
    whole sequence of fewer words. A bit is 1 if it is set in more than half
    of the shingles' XXH64 hashes (UTF-8, seed 42).

    Returns doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id that can be reached), kept (doc_id is that one), n_equal (rows with
    the same fingerprint). Null, empty and blank texts have fingerprint 0 and
    link like any other. Rows with a null doc_id group like others; their
    component_id is null if no row of the group has an id. Repeated rows get
    equal results. An empty table gives no rows. Other columns of docs are
    ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(id_text().alias("doc_id"), text_or_empty().alias("text")).mapInPandas(_fingerprinted, "doc_id string, print long")
    rows = written(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "simhash-prints")
    classes = written(rows.groupBy("print").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), F.count("*").alias("n_equal")), "simhash-classes")

    lists = candidate_lists(classes.select("print"), limit)
    links = written(lists.repartition(*LIST).sortWithinPartitions(*LIST).mapInPandas(_linked, "a long, b long").distinct(), "simhash-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("print")).distinct()
    nodes = classes.join(ends, "print").select(F.col("print").alias("cls"), "id")
    heads = components(links, nodes).select(F.col("cls").alias("print"), F.col("head.id").alias("head"))
    whole = written(classes.join(heads, "print", "left").select(F.col("print").alias("of_print"), F.coalesce("head", "id").alias("head"), "n_equal"), "simhash-heads")
    dropped(links)
    dropped(classes)

    component = F.when(F.col("head") != NO_ID, F.col("head"))
    placed = rows.join(whole, F.col("print") == F.col("of_print"))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "n_equal")
