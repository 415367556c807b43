"""SpotSigs: fingerprints from the content words that follow common words.

Each common word is an anchor. The next content words after it, a fixed
distance apart, form a chain; anchor and chain are one spot signature. The
distinct signatures of a text are its fingerprint. Sets are compared by
Jaccard, and only between neighbouring partitions of set length, since sets
whose sizes differ too much cannot be alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import id_text, small_batches, text_or_empty, written
from geoloom.llm.kernels import NOT_ALNUM, Words, blocks, mix, shared

#: The anchors, common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it of on or she that the they this to was were which with you "
    "au aux avec ce dans de des du elle en est et il je la le les mais ne par pas pour que qui se sur un une "
    "auf das dem den der die ein eine ich im ist mit nicht sich und von zu "
    "al con del el los las lo no por su una y"
).split()
CHAIN = 2
DISTANCE = 1
SIMILARITY = 0.75


def _word_hash(words: list[str]) -> np.ndarray:
    return np.unique(Words([w.encode() for w in words], NOT_ALNUM).hashes())


def signature_sets(texts: list[bytes], chain: int = CHAIN, distance: int = DISTANCE) -> list[np.ndarray]:
    """The sorted distinct 32-bit spot signatures of each text.

    A text whose anchors have no chain has one signature, the hash of its
    bytes, so that no set is empty and only equal texts share it.
    """
    words = Words(texts, NOT_ALNUM)
    hashes = words.hashes()
    anchor = np.isin(hashes, _word_hash(list(ANCHORS)))
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    following = np.searchsorted(content, spots)
    last = following + distance * (chain - 1)
    whole = last < len(content)
    spots, following, last = spots[whole], following[whole], last[whole]
    inside = words.text[content[last]] == words.text[spots]
    spots, following = spots[inside], following[inside]
    rolled = hashes[spots]
    for j in range(chain):
        rolled = mix(rolled * np.uint64(31) + hashes[content[following + distance * j]])
    spots_text = words.text[spots]
    sets = np.split((rolled >> np.uint64(32)).astype(np.uint32), np.cumsum(np.bincount(spots_text, minlength=len(texts)))[:-1])
    return [np.unique(s) if len(s) else np.frombuffer(hashlib.sha256(t).digest()[:4], ">u4").astype(np.uint32) for s, t in zip(sets, texts, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sets; 0 without comparing them if their sizes alone keep it below at_least."""
    small, large = sorted((len(a), len(b)))
    if small < at_least * large:
        return 0.0
    both = shared(a, b)
    return both / (small + large - both)


def length_partition(size: int, similarity: float) -> int:
    """The partition of a set length; alike sets are in the same one or in neighbours."""
    return int(math.floor(math.log(size) / -math.log(similarity) + 1e-9))


def as_text(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def edited_text(text: str, other: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many, or all, of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in ascending order within each range; each is compared with the row before it."""
    before, before_set, before_range = "", None, None
    for pdf in batches:
        texts = pdf["text"].tolist()
        out = []
        sets: list[np.ndarray] = []
        edited_sets: list[np.ndarray] = []
        edited: list[str] = []
        for i, (text, r) in enumerate(zip(texts, pdf["range"], strict=True)):
            previous, held = (texts[i - 1], pdf["range"].iat[i - 1]) if i else (before, before_range)
            edited.append(edited_text(text, previous) if held == r else "")
        for _, block in blocks(texts):
            sets += signature_sets(block)
        for _, block in blocks(edited):
            edited_sets += signature_sets(block)
        for i, (row, r) in enumerate(zip(pdf.itertuples(index=False), pdf["range"], strict=True)):
            other = sets[i - 1] if i else before_set
            if not row.guest:
                out.append(
                    (
                        row.doc_id, len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), as_text(sets[i]), as_text(edited_sets[i]),
                        likeness(sets[i], edited_sets[i]), likeness(sets[i], other), len(sets[i]), length_partition(len(sets[i]), SIMILARITY),
                    )
                )
        if len(texts):
            before, before_set, before_range = texts[-1], sets[-1], pdf["range"].iat[-1]
        yield pd.DataFrame(out, columns=OUT_NAMES)


OUT_SCHEMA = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_partition int"
OUT_NAMES = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs(doc_id, text) and of its edited text, and their likeness.

    The next document is the one before it by doc_id; after the smallest comes
    the largest. Rows are dealt into ranges of doc_id, and the last row of each
    range goes to the next range too, so every task has all it compares and no
    task has more than its ranges. The text is shuffled once.

    Null text counts as empty; an empty text has the one signature of its empty
    bytes. A null doc_id sorts before all others. Rows with equal doc_id are
    ordered by a digest of their text. A single row is its own next document.
    An empty table gives no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cuts = sorted(set(base.where("doc_id is not null").approxQuantile("doc_id", [i / pieces for i in range(1, pieces)], 0.2 / pieces)))
    range_of = F.size(F.filter(F.split(F.lit(",".join(str(int(c)) for c in cuts)), ",").cast("array<long>"), lambda c: c < F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))) if cuts else F.lit(0)
    ranged = base.withColumns({"range": range_of.cast("int"), "digest": F.md5(F.col("text").cast("binary"))})

    heads = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "digest")).alias("head")).orderBy("range").collect()
    order = [h["range"] for h in heads]
    follows = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = [(h["head"]["doc_id"], h["head"]["digest"], follows[h["range"]]) for h in heads]
    guests = spark.createDataFrame(rows, "guest_id long, guest_digest string, guest_range int")

    # The last rows are one for each range, so this side is small by construction.
    twice = ranged.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("guest_id")) & (F.col("digest") == F.col("guest_digest")), "left")
    places = F.filter(F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("guest_range").alias("range"), F.lit(True).alias("guest"))), lambda p: p["range"].isNotNull())
    dealt = twice.select("doc_id", "text", "digest", F.explode(places).alias("place")).select("doc_id", "text", "digest", "place.range", "place.guest")
    dealt = dealt.repartition(pieces // 4, "range").sortWithinPartitions("range", F.col("guest").desc(), F.col("doc_id").asc_nulls_first(), "digest")
    made = dealt.select(id_text().alias("doc_id"), "text", "range", "guest").mapInPandas(_compared, OUT_SCHEMA)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for first, block in blocks(pdf["text"].tolist()):
            sets = signature_sets(block)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[first : first + len(block)].array, "fingerprint": [as_text(s) for s in sets], "signatures": [s.astype(np.int64) for s in sets]})


def similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of different fingerprints whose Jaccard is `similarity` or more: left, right (fingerprint digests), likeness.

    Equal fingerprints are one class; the rows' classes are in `classes`. Rare
    signatures come first in each set, and of a set of n only the first
    n - ceil(similarity * n) + 1 are looked up, which loses no pair. A lookup
    meets only sets of its own length partition or the one above, and lengths
    are checked before sets are compared.
    """
    small_batches(docs.sparkSession)
    signed = docs.select(id_text().alias("doc_id"), text_or_empty().alias("text")).mapInPandas(_signatures, "doc_id string, fingerprint string, signatures array<long>")
    sets = written(signed.select(F.md5(F.col("fingerprint").cast("binary")).alias("id"), "signatures").dropDuplicates(["id"]), "spotsigs")
    sets = sets.withColumn("n", F.size("signatures")).withColumn("part", F.floor(F.log("n") / F.lit(-math.log(similarity)) + 1e-9).cast("int"))
    each = sets.select("id", "n", "part", F.explode("signatures").alias("sig"))
    seen = each.groupBy("sig").agg(F.count("*").alias("seen")).where("seen > 1")
    rare_first = each.join(seen, "sig").groupBy("id", "n", "part").agg(F.array_sort(F.collect_list(F.struct("seen", "sig"))).alias("found"))
    # Signatures of one text alone sort before all these, so they use up the prefix first.
    spare = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("found"))
    prefix = rare_first.select("id", "n", "part", F.explode(F.slice("found", 1, F.greatest(spare, F.lit(0)).cast("int"))).alias("s")).select("id", "n", "part", "s.sig")
    left = prefix.select(F.col("id").alias("left"), F.col("n").alias("ln"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("right"), F.col("n").alias("rn"), "sig", "part")
    near = left.join(right, ["sig", "part"]).where((F.col("left") != F.col("right")) & ((F.col("ln") < F.col("rn")) | ((F.col("ln") == F.col("rn")) & (F.col("left") < F.col("right")))) & (F.col("ln") >= F.lit(similarity) * F.col("rn") - 1e-9))
    pairs = near.select("left", "right").distinct()
    a, b = sets.select(F.col("id").alias("left"), F.col("signatures").alias("a")), sets.select(F.col("id").alias("right"), F.col("signatures").alias("b"))
    both = pairs.join(a, "left").join(b, "right")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("left", "right", (common / (F.size("a") + F.size("b") - common)).alias("likeness")).where(F.col("likeness") >= similarity - 1e-9)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and the class of its fingerprint, as `similar` names them."""
    small_batches(docs.sparkSession)
    signed = docs.select(id_text().alias("doc_id"), text_or_empty().alias("text")).mapInPandas(_signatures, "doc_id string, fingerprint string, signatures array<long>")
    return signed.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("fingerprint").cast("binary")).alias("class_id"))
