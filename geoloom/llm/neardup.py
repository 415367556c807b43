"""Near-duplicate groups: MinHash bands propose, sequential Bayesian tests prune, full sets decide.

1. One scan gives each text its shingle set's class (a hash of the whole set),
   a MinHash signature and band keys. Equal sets are one class from here on.
2. Rounds of chance partners: each band bucket is dealt into small parts, and
   each class is offered its part's first one if they are not in one group yet.
   Of its offers a class takes two a round, from its fullest and from its
   sparsest bucket. Signature batches prune a pair as soon as the posterior
   chance that its similarity reaches the threshold falls below the miss
   probability; pairs left over are compared on their full sets. Links join
   groups, so a large group of near copies grows together in a few rounds of
   two tests a member.
3. What a bucket then still holds of other groups than its largest is paired
   with all members of other groups, and tested in the same way. After this
   every pair of a bucket is linked, tested, or in one group already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import SPACES, bucketed, dropped, id_text, small_batches, text_or_empty, written
from geoloom.llm.kernels import blocks, mix, shared, shingle_sets

WIDTH = 5
#: Similarity as a share in hundredths, so that links are decided in whole numbers.
PERCENT = 75
BANDS, ROWS = 40, 4
#: MinHashes compared before each decision.
BATCH = 32
#: Rounds of chance partners before the rest is compared in full, and members of a part that share one partner.
ROUNDS, PART, FEW = 6, 16, 8
#: Buckets of more members are compared in blocks of BLOCK by BLOCK; pairs are listed in smaller ones only.
LISTED, BLOCK = 8, 512
#: Shingles of one block, about, so that memory follows neither the members nor the length of their texts.
BLOCK_SHINGLES = 2_000_000
#: A pair is pruned once the chance that it reaches the threshold is below this.
MISS = 1e-6


@lru_cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(members: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHashes of each set; sets lie end to end from `starts` and none is empty."""
    flips, factors = _functions(n)
    out = np.empty((len(starts), n), np.uint64)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((members ^ flips[i]) * factors[i], starts)
    return out


def set_names(members: np.ndarray, counts: np.ndarray) -> tuple[list[int | None], list[int | None]]:
    """Two independent 64-bit names for each of the sets that lie end to end; None for empty ones. Sets are one class if both are equal."""
    full = np.flatnonzero(counts)
    one, other = np.full(len(counts), None, object), np.full(len(counts), None, object)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        size = np.repeat(counts, counts).astype(np.uint64)
        sums = np.add.reduceat(members, starts)
        first = mix(np.bitwise_xor.reduceat(mix(members + size), starts) ^ (sums * np.uint64(3)))
        second = mix(np.add.reduceat(mix(members * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)), starts) + counts[full].astype(np.uint64))
        one[full], other[full] = first.view(np.int64), second.view(np.int64)
    return one.tolist(), other.tolist()


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each MinHash is mixed and kept to 16 bits: four of them are a band's key of 64 bits.

    A minimum over many shingles has hardly any upper bits of its own, so
    without mixing all long texts would agree.
    """
    for pdf in batches:
        for first, block in blocks(pdf["text"].tolist()):
            members, counts = shingle_sets(block, WIDTH)
            names, checks = set_names(members, counts)
            full = np.flatnonzero(counts)
            signatures: list = [None] * len(block)
            if len(full):
                hashes = min_hashes(members, (np.cumsum(counts) - counts)[full], BANDS * ROWS)
                for at, h in zip(full, (mix(hashes) >> np.uint64(48)).astype(np.uint16), strict=True):
                    signatures[at] = h.tobytes()
            rows = pdf.iloc[first : first + len(block)].drop(columns="text")
            yield rows.assign(n_shingles=counts, name=pd.array(names, "Int64"), check=pd.array(checks, "Int64"), signature=signatures)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for first, block in blocks(pdf["text"].tolist()):
            members, counts = shingle_sets(block, WIDTH)
            names, checks = set_names(members, counts)
            sets = np.split(members, np.cumsum(counts)[:-1])
            rows = pdf.iloc[first : first + len(block)]
            made = pd.DataFrame({"cls": rows["cls"].array, "members": [s.tobytes() for s in sets], "size": counts})
            yield made[[w == (n, c) for w, n, c in zip(zip(rows["name"], rows["check"], strict=True), names, checks, strict=True)]].drop_duplicates("cls")


@lru_cache
def fewest_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Of n MinHashes, the fewest equal ones at which the similarity may still be percent or more.

    With a uniform prior the similarity, given m of n equal, follows
    Beta(m + 1, n - m + 1). The chance above the threshold is the tail of that.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        density = m * np.log(s) + (n - m) * np.log1p(-s)
        density = np.exp(density - density.max())
        if density[s >= percent / 100].sum() >= miss * density.sum():
            return m
    return n


def _plausible(a: pd.Series, b: pd.Series, percent: int, miss: float) -> np.ndarray:
    """Which pairs of signatures stay after batch by batch comparison."""
    left = np.stack([np.frombuffer(x, np.uint16) for x in a])
    right = np.stack([np.frombuffer(x, np.uint16) for x in b])
    open_, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for at in range(0, left.shape[1], BATCH):
        stop = min(at + BATCH, left.shape[1])
        matches[open_] += (left[open_, at:stop] == right[open_, at:stop]).sum(axis=1)
        open_ = open_[matches[open_] >= fewest_matches(stop, percent, miss)]
    stays = np.zeros(len(left), bool)
    stays[open_] = True
    return stays


def _pruned(percent: int, miss: float):
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[_plausible(pdf["sa"], pdf["sb"], percent, miss), ["a", "b"]]

    return prune


def _block_compared(percent: int, miss: float):
    """Links of a block of strays with a block of members of other groups: signatures first, then full sets.

    Of a stray's links to one group the first is enough.
    """

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            signatures = np.stack([np.frombuffer(x, np.uint16) for x in right["signature"]])
            y, gy, top, ny = (right[c].to_numpy() for c in ("cls", "group", "top", "size"))
            arrays = [np.frombuffer(x, np.uint64) for x in right["members"]]
            owner = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
            shingles = np.concatenate(arrays)
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            for x, gx, signature, members, nx in zip(left["cls"], left["group"], left["signature"], left["members"], left["size"], strict=True):
                own = np.frombuffer(signature, np.uint16)
                open_ = np.flatnonzero((gy != gx) & ((gy == top) | (x < y)))
                matches = np.zeros(len(open_), np.int64)
                for at in range(0, len(own), BATCH):
                    stop = min(at + BATCH, len(own))
                    matches = matches + (signatures[open_, at:stop] == own[at:stop]).sum(axis=1)
                    stays = matches >= fewest_matches(stop, percent, miss)
                    open_, matches = open_[stays], matches[stays]
                if not len(open_):
                    continue
                mine = np.frombuffer(members, np.uint64)
                low, high = np.searchsorted(shingles, mine, "left"), np.searchsorted(shingles, mine, "right")
                n = high - low
                hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[hit], minlength=len(y))[open_]
                near = open_[100 * both >= percent * (nx + ny[open_] - both)]
                _, first = np.unique(gy[near], return_index=True)
                out += [(x, int(y[k]), gx, int(gy[k])) for k in near[first]]
        return pd.DataFrame(out, columns=["a", "b", "ga", "gb"], dtype="int64")

    return compare


def _confirmed(percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep: list[bool] = []
            for x, y in zip(pdf["ma"], pdf["mb"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = shared(p, q)
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return confirm


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(cls, id) with links(a, b) to cls, head: the (id, cls) that is least of all that can be reached.

    Each round takes the least of the neighbours, then follows the owner of
    that least value one step, until nothing changes. Every round is a written
    table; whether anything changed is all that the driver sees.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "dup-links")
    state = written(nodes.select("cls", F.struct("id", "cls").alias("best")), "dup-state")
    while True:
        offered = both.join(state.select(F.col("cls").alias("b"), "best"), "b").groupBy("a").agg(F.min("best").alias("offer"))
        near = state.join(offered.withColumnRenamed("a", "cls"), "cls", "left").select("cls", "best", F.least("best", F.coalesce("offer", "best")).alias("near"))
        owners = near.select(F.col("cls").alias("owner"), F.col("near").alias("theirs"))
        jumped = near.join(owners, F.col("near.cls") == F.col("owner"), "left").withColumn("next", F.least("near", F.coalesce("theirs", "near")))
        after = written(jumped.select("cls", F.col("next").alias("best"), (F.col("next") != F.col("best")).alias("moved")), "dup-state")
        dropped(state)
        state = after
        if after.where("moved").isEmpty():
            dropped(both)
            return state.select("cls", F.col("best").alias("head"))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups(cls, head) after links(a, b) between classes.

    Only groups that a link joins to another one take part, so a round costs
    what it changes.
    """
    of_a = groups.select(F.col("cls").alias("a"), F.col("head").alias("ha"))
    of_b = groups.select(F.col("cls").alias("b"), F.col("head").alias("hb"))
    ends = written(links.join(of_a, "a").join(of_b, "b").where("ha.cls != hb.cls").select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb")).distinct(), "dup-ends")
    if ends.isEmpty():
        dropped(ends)
        return groups
    heads = components(ends.select(F.col("ha.cls").alias("a"), F.col("hb.cls").alias("b")), ends.select("ha.*").union(ends.select("hb.*")).distinct())
    moved = heads.select(F.col("cls").alias("old"), F.col("head").alias("new"))
    merged = written(groups.join(moved, F.col("head.cls") == F.col("old"), "left").select("cls", F.coalesce("new", "head").alias("head")), "dup-groups")
    dropped(ends)
    return merged


#: Stands for a missing id where ids are ordered, so that it comes last.
NO_ID = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: what a row is found by again, whatever ids are null or repeated."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))


def _groups(docs: DataFrame, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """Of each row: doc_id, text_key, n_shingles, name, check. Of each class: cls, name, check, id and text_key (of its row with the smallest doc_id), head (id and cls of its group's first class)."""
    small_batches(docs.sparkSession)
    base = _keyed(docs)
    signed = base.withColumn("doc_id", id_text()).mapInPandas(_signed, "doc_id string, text_key long, n_shingles long, name long, check long, signature binary")
    signed = written(signed.withColumns({"doc_id": F.col("doc_id").cast("long"), "row": F.monotonically_increasing_id()}), "dup-signatures")
    # Rows with equal sets have equal signatures, so the row with the smallest doc_id stands for the class; its number names it.
    of_row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_key", "row", "signature")
    named = signed.where("name is not null").groupBy("name", "check").agg(F.min(of_row).alias("r"))
    classes = written(named.select(F.col("r.row").alias("cls"), "name", "check", "r.id", "r.text_key", "r.signature"), "dup-classes")

    slices = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = classes.select("cls", F.explode(slices).alias("band"))
    # Counts alone are shuffled for the many bands of one class.
    repeated = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(repeated, "band"), "dup-buckets")

    # Every round joins signatures and sets twice; laid out by class, they are not shuffled again.
    needed = bucketed(members.select("cls").distinct().join(classes, "cls"), "dup-needed", "cls")
    wanted = needed.select("cls", "name", "check", F.when(F.col("id") != NO_ID, F.col("id")).alias("of_id"), F.col("text_key").alias("of_key"))
    texts = base.join(wanted, (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("text", "cls", "name", "check")
    sets = texts.mapInPandas(_sets, "cls long, members binary, size long")
    sets = bucketed(sets.dropDuplicates(["cls"]) if _repeats(signed) else sets, "dup-sets", "cls")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = needed.select("cls", "signature").toDF("a", "sa"), needed.select("cls", "signature").toDF("b", "sb")
        return confirmed(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInPandas(_pruned(percent, miss), "a long, b long"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, full = written(pairs, "dup-candidates"), sets.select("cls", "members")
        a, b = full.toDF("a", "ma"), full.toDF("b", "mb")
        found = written(left.join(a, "a").join(b, "b").select("a", "b", "ma", "mb").mapInPandas(_confirmed(percent), "a long, b long"), "dup-links")
        dropped(left)
        return found

    groups = needed.select("cls", F.struct("id", "cls").alias("head"))
    found = linked(_partners(members.withColumn("group", F.col("cls")), 0))
    n_links, groups = found.count(), _merged(groups, found)
    for k in range(1, ROUNDS):
        found = linked(_partners(_split(members, groups), k))
        n_more, groups = found.count(), _merged(groups, found)
        n_links += n_more
        # Once a round adds little, those still apart are no near copies of most others.
        if FEW * n_more < n_links:
            break

    split = written(_split(members, groups), "dup-split-buckets")
    sizes = split.groupBy("band", "group").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("m", "group"))["group"].alias("top"))
    placed = written(split.join(largest, "band"), "dup-placed")
    dropped(split)
    dropped(members)

    small = placed.where(F.col("n") <= LISTED)
    strays = small.where(F.col("group") != F.col("top")).select("band", F.col("cls").alias("x"), F.col("group").alias("gx"))
    others = small.select("band", F.col("cls").alias("y"), F.col("group").alias("gy"), "top")
    across = strays.join(others, "band").where((F.col("gx") != F.col("gy")) & ((F.col("gy") == F.col("top")) | (F.col("x") < F.col("y"))))
    late = linked(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    # Larger buckets meet block by block: what is emitted is one link between two groups, not their pairs.
    carried = placed.where(F.col("n") > LISTED).join(sets.join(needed.select("cls", "signature"), "cls"), "cls")
    lengths = placed.where(F.col("n") > LISTED).select("band", "cls").join(sets.select("cls", "size"), "cls").groupBy("band").agg(F.sum("size").alias("shingles"))
    n_blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    blocked = carried.join(lengths.withColumnRenamed("band", "of_band"), F.col("band") == F.col("of_band")).drop("of_band").withColumn("blocks", n_blocks)
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = blocked.where(F.col("group") != F.col("top")).select("band", F.col("own").alias("i"), every.alias("j"), "cls", "group", "signature", "members", "size")
    right = blocked.select("band", every.alias("i"), F.col("own").alias("j"), "cls", "group", "top", "signature", "members", "size")
    # Both sides stem from one table; fresh column names tell them apart.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    found = left.groupBy("band", "i", "j").cogroup(right.groupBy("band", "i", "j")).applyInPandas(_block_compared(percent, miss), "a long, b long, ga long, gb long")
    one = found.groupBy(F.least("ga", "gb"), F.greatest("ga", "gb")).agg(F.min(F.struct("a", "b")).alias("link")).select("link.*")

    groups = _merged(groups, late.union(written(one, "dup-links")))
    whole = classes.select("cls", "name", "check", "id", "text_key").join(groups, "cls", "left").withColumn("head", F.coalesce("head", F.struct("id", "cls")))
    whole = written(whole, "dup-placed-classes")
    for table in (placed, sets, needed, classes):
        dropped(table)
    return signed.select("doc_id", "text_key", "n_shingles", "name", "check"), whole


def _split(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (band, cls, n) of the buckets that hold more than one group, with their groups."""
    held = members.join(groups.select("cls", F.col("head.cls").alias("group")), "cls")
    mixed = held.groupBy("band").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1").select("band")
    return held.join(mixed, "band")


def _partners(split: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of round k, at most two for each class.

    Buckets are dealt by chance into parts of about PART members, and each is
    offered its part's first one, if that is of another group. A class takes
    the offers of its fullest bucket, where a large group grows together, and
    of its sparsest one, where its nearest are.
    """
    dealt = split.withColumn("draw", F.xxhash64("cls", F.lit(k))).withColumn("part", F.pmod("draw", F.ceil(F.col("n") / PART)))
    first = dealt.groupBy("band", "part").agg(F.min(F.struct("draw", "cls", "group")).alias("first"))
    offers = dealt.join(first, ["band", "part"]).where(F.col("group") != F.col("first.group")).select("cls", F.struct("n", F.col("first.cls").alias("other")).alias("offer"))
    taken = offers.groupBy("cls").agg(F.max("offer").alias("full"), F.min("offer").alias("sparse"))
    pairs = taken.select("cls", F.explode(F.array_distinct(F.array("full.other", "sparse.other"))).alias("other"))
    return pairs.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _repeats(signed: DataFrame) -> bool:
    """Whether a doc_id stands in more than one row with the same text."""
    return not signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Groups the rows of docs(doc_id, text) whose shingle sets are linked, directly or through others.

    Words are runs other than U+0009 to U+000D and space, A-Z lowered; a set
    holds the distinct five-word shingles, or the whole sequence of fewer
    words. Sets link where 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that can be
    reached), kept (doc_id is that one), class_id (rows with equal sets).
    Null, empty and blank texts have no set and stay alone. Rows with a null
    doc_id group like others; their component_id is null if no row of the group
    has an id. Repeated rows get equal results. An empty table gives no rows.
    Other columns of docs are ignored.

    A pair right at the threshold shares no band with probability
    (1 - 0.75^4)^40, under 3e-7, and is pruned by its signatures with
    probability under 6e-6; both fall quickly above it. Sets are told apart by
    two independent 64-bit names.
    """
    rows, groups = _groups(docs, percent, miss)
    heads = groups.select(F.col("name").alias("of_name"), F.col("check").alias("of_check"), F.when(F.col("head.id") != NO_ID, F.col("head.id")).alias("component_id"))
    placed = rows.where("name is not null").join(heads, (F.col("name") == F.col("of_name")) & (F.col("check") == F.col("of_check")))
    alone = rows.where("name is null").withColumn("component_id", F.col("doc_id"))
    out = ("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("name").alias("class_id"))
    return placed.select(*out).union(alone.select(*out))


def keep_one(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """docs without the near copies: of each group the row with the smallest doc_id stays, texts without words all stay.

    Repeated rows count as copies. All columns pass through.
    """
    rows, groups = _groups(docs, percent, miss)
    first = groups.where(F.col("head.cls") == F.col("cls")).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("__of_id"), F.col("text_key").alias("__of_key"))
    first = written(first, "dup-winners")
    blank = F.length(F.btrim(text_or_empty(), F.lit(SPACES))) == 0
    keyed = docs.where(~blank).withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64(text_or_empty())})
    kept = keyed.join(first, F.col("__id").eqNullSafe(F.col("__of_id")) & (F.col("__key") == F.col("__of_key")), "left_semi")
    # A row and its exact repetition, id included, pass together; one of them stays.
    if _repeats(rows):
        kept = kept.dropDuplicates(["__id", "__key"])
    return kept.select(*docs.columns).union(docs.where(blank))
