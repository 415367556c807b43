"""Sharding by sampled splitters, in DataFrame functions only.

Equal texts are one group, and groups are what is placed. Keys of groups are
drawn with chances that follow their size, quantiles of the draw become range
boundaries, overfull ranges are subdivided, and exact byte counts of the ranges
place every group on one global byte axis. The few groups that fill a notable
share of a shard are placed first, the largest ones over whole shards; the axis
of all others is cut so that it fills what room the shards have left.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import dropped, text_or_empty, written

#: Bytes that a stored record takes besides its text.
RECORD_OVERHEAD = 16


def _draws(rows: DataFrame, chance: Column) -> DataFrame:
    """Rows drawn independently with the given chance; the same rows in every run."""
    dice = F.pmod(F.xxhash64("key", F.lit("splitter")), F.lit(2**40)) / F.lit(float(2**40))
    return rows.where(dice < chance)


def _quantiles(draws: DataFrame, pieces: int) -> list[str]:
    """The keys that cut the drawn keys into so many equal pieces; at most pieces - 1 keys reach the driver."""
    ranked = draws.select("key", F.row_number().over(Window.orderBy("key")).alias("at"))
    size = F.lit(max(1, draws.count()))
    cut = F.floor(F.col("at") * pieces / size)
    first = ranked.groupBy(cut.alias("cut")).agg(F.min("key").alias("key"))
    return sorted({r["key"] for r in first.where("cut > 0").collect()})


def _range_of(splitters: list[str]) -> Column:
    """How many splitters are at or below the key, by a coarse and then a fine comparison."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    coarse = F.split(F.lit(",".join(b[0] for b in blocks)), ",")
    fine = F.split(F.lit(";".join(",".join(b) for b in blocks)), ";")
    block = F.size(F.filter(coarse, lambda s: s <= F.col("key")))
    inside = F.size(F.filter(F.split(F.element_at(fine, F.greatest(block, F.lit(1))), ","), lambda s: s <= F.col("key")))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def _from_table(values: list[int], at: Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), at + 1).cast("long")


def split_ranges(rows: DataFrame, ranges: int, draws_per_range: int, overfull: float = 4.0, rounds: int = 3):
    """Splitters for rows (key, size), and the exact (rows, bytes) of each range.

    A key's chance to be drawn follows its share of the bytes and of the rows,
    so neither long nor many short records fill a range unseen. Ranges that
    still hold over `overfull` times the mean are drawn from again, more
    densely, and subdivided. What reaches the driver is bounded by `ranges`.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return [], [(0, 0)]
    wanted = ranges * draws_per_range
    chance = F.lit(wanted / 2) * (F.col("size") / F.lit(float(max(total, 1))) + F.lit(1.0 / n))
    splitters = _quantiles(_draws(rows, chance), ranges)
    for k in range(rounds + 1):
        found = {r["range"]: (r["n"], r["bytes"]) for r in rows.groupBy(_range_of(splitters).alias("range")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        stats = [found.get(i, (0, 0)) for i in range(len(splitters) + 1)]
        full = [i for i, (m, b) in enumerate(stats) if m > 1 and (m * ranges > overfull * n or b * ranges > overfull * total)]
        if not full or k == rounds:
            return splitters, stats
        more: list[str] = []
        for i in full:
            inside = rows
            if i > 0:
                inside = inside.where(F.col("key") >= splitters[i - 1])
            if i < len(splitters):
                inside = inside.where(F.col("key") < splitters[i])
            pieces = max(2, round(max(stats[i][0] / n, stats[i][1] / max(total, 1)) * ranges))
            dense = F.lit(pieces * draws_per_range / 2) * (F.col("size") / F.lit(float(max(stats[i][1], 1))) + F.lit(1.0 / stats[i][0]))
            more += _quantiles(_draws(inside, dense), pieces)
        if not set(more) - set(splitters):
            return splitters, stats
        splitters = sorted({*splitters, *more})


def packed(large: list[tuple[str, int, int]], total: int, n_shards: int) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """Places large groups (key, rows, bytes of a row): (key, first row, end row, shard) of each piece, and the bytes each shard holds then.

    A group that fills one shard or more takes whole shards, and only what is
    left of it is placed like the others: by size, each where there is most room.
    """
    room = max(1, -(-total // n_shards))
    pieces, rest, held, free = [], [], [0] * n_shards, list(range(n_shards))
    for key, n, size in sorted(large, key=lambda g: (-g[1] * g[2], g[0])):
        first, rows = 0, max(1, room // size)
        while (n - first) * size >= room and n - first > rows and len(free) > 1:
            shard = free.pop(0)
            pieces.append((key, first, first + rows, shard))
            held[shard] += rows * size
            first += rows
        rest.append((key, first, n, (n - first) * size))
    heap = [(held[k], k) for k in free]
    heapq.heapify(heap)
    for key, first, n, size in sorted(rest, key=lambda r: (-r[3], r[0])):
        filled, shard = heapq.heappop(heap)
        pieces.append((key, first, n, shard))
        held[shard] = filled + size
        heapq.heappush(heap, (held[shard], shard))
    return pieces, held


def _numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with a number from 0 without gaps among the rows of equal `by`, in the order of row_id.

    Rows are numbered within the partition that gave them their row_id, and
    each partition starts where those before it end. So no task holds all rows
    of one value, however many there are.
    """
    chunked = rows.withColumn("chunk", F.shiftrightunsigned("row_id", 33))
    counts = chunked.groupBy(by, "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("chunk")) - F.col("n")
    starts = counts.select(F.col(by).alias("of"), F.col("chunk").alias("of_chunk"), before.alias("before"))
    within = chunked.withColumn("within", F.row_number().over(Window.partitionBy(by, "chunk").orderBy("row_id")) - 1)
    both = within.join(starts, (F.col(by) == F.col("of")) & (F.col("chunk") == F.col("of_chunk")))
    return both.select(*rows.columns, (F.col("before") + F.col("within")).cast("long").alias(name))


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = 12, draws_per_range: int = 32, large_share: int = 100) -> DataFrame:
    """Puts every row of docs(doc_id, text) into one of n_shards shards of near equal bytes.

    Equal texts are one group and stand in one shard, unless the group alone
    fills more than a shard; then it takes whole shards and one rest. Groups of
    more than 1 / large_share of a shard are placed first, by size; there are
    fewer than n_shards * large_share of them, which bounds what the driver and
    the broadcast hold. All other groups lie in the order of their digests on
    one byte axis, and a group goes where its middle byte falls.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    Null or empty text counts as empty: size RECORD_OVERHEAD, CRC 0. A null
    doc_id is carried. Repeated rows each get a slot of their own. An empty
    table gives no rows. Other columns of docs are ignored.
    """
    text = text_or_empty()
    base = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("text_key"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "shard-rows",
    )
    # Equal texts have equal sizes.
    groups = written(base.groupBy(F.col("text_key").alias("key")).agg(F.count("*").alias("n"), F.max("size").alias("row_size"), F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    is_large = F.col("size") * (large_share * n_shards) > total
    pieces, held = packed([(r["key"], r["n"], r["row_size"]) for r in groups.where(is_large).collect()], total, n_shards)

    small = groups.where(~is_large).select("key", "size")
    splitters, stats = split_ranges(small, n_shards * ranges_per_shard, draws_per_range)
    bytes_before = [0, *accumulate(b for _, b in stats)]
    room = max(1, -(-total // n_shards))
    left = [max(0, room - h) for h in held]
    # The axis of the small groups, cut in proportion to the room that is left.
    ends = [e * bytes_before[-1] // max(1, sum(left)) for e in accumulate(left)][:-1]
    start = _from_table(bytes_before, F.col("range")) + F.sum("size").over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = small.withColumn("range", _range_of(splitters)).select(F.col("key").alias("of_key"), (start + F.floor(F.col("size") / 2)).cast("long").alias("middle"))
    edges = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<long>")
    shard_of = F.size(F.filter(edges, lambda e: e <= F.col("middle"))) if ends else F.lit(0)
    placed = placed.select("of_key", shard_of.cast("int").alias("shard"))

    said = F.split(F.lit(";".join(":".join(map(str, p)) for p in pieces)), ";")
    known = docs.sparkSession.range(1).select(F.explode(said).alias("piece")).select(F.split("piece", ":").alias("p")).where(F.size("p") == 4)
    known = known.select(
        F.get("p", F.lit(0)).alias("of_key"), F.get("p", F.lit(1)).cast("long").alias("first"), F.get("p", F.lit(2)).cast("long").alias("end"), F.get("p", F.lit(3)).cast("int").alias("shard")
    )
    n_pieces = Counter(p[0] for p in pieces)
    cut = sorted(k for k, n in n_pieces.items() if n > 1)
    names = F.broadcast(known.select(F.col("of_key").alias("large_key")).distinct())
    marked = base.join(names, F.col("text_key") == F.col("large_key"), "left")
    many = marked.where("large_key is null").drop("large_key").join(placed, F.col("text_key") == F.col("of_key"))
    whole = base.join(F.broadcast(known.where(~F.col("of_key").isin(cut))), F.col("text_key") == F.col("of_key"))
    parts = [many.select(*base.columns, "shard"), whole.select(*base.columns, "shard")]
    if cut:
        torn = _numbered(base.where(F.col("text_key").isin(cut)), "text_key", "at")
        of_piece = (F.col("text_key") == F.col("of_key")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("end"))
        parts.append(torn.join(F.broadcast(known), of_piece).select(*base.columns, "shard"))
    sharded = parts[0]
    for p in parts[1:]:
        sharded = sharded.union(p)
    sharded = written(sharded, "shard-places")
    dropped(groups)
    return _numbered(sharded, "shard", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
