"""Greedy packing of ordered samples into shards, spread over many tasks however large a group is.

A shard takes samples in order until the next one would take it over the cap,
so where a shard begins depends on all shards before it. What a sample decides
alone is its successor: were it the first of a shard, which sample would be the
first of the next one? Prefix sums give that for every sample at once. The real
starts are those that a group's first sample reaches by successors:

1. Samples are numbered and summed up in ranges of the order.
2. Successors are looked up on the axis of bytes, cut into blocks of one cap.
3. In segments of some rows a task follows successors to where they leave the
   segment. What is left is one jump for each place where a segment is entered.
4. Jumps are doubled by joins until every reached entry is known.
5. Each segment numbers its shards from its own entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.groups import whole_groups
from geoloom.operators.lineage import written

#: Rows that one task follows by itself.
SEGMENT = 100_000


def _placed(rows: DataFrame, pieces: int) -> DataFrame:
    """rows(grp, at, size) with their number `no` in the group from 0, the bytes `start` before them and the group's `rows`, in order of at, then size."""
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = written(spread.repartitionByRange(pieces, "grp", "at", "size", "tie").withColumn("piece", F.spark_partition_id()), "packed-ranges")
    # A group has one row in each range that it is in.
    sums = ranged.groupBy("grp", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    of_group = Window.partitionBy("grp")
    before = of_group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("grp", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.sum("n").over(of_group).alias("rows"))
    inside = Window.partitionBy("grp", "piece").orderBy("at", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.withColumns({"row": F.count("*").over(inside) - 1, "upto": F.sum("size").over(inside)})
    return numbered.join(starts, ["grp", "piece"]).select("grp", "at", "size", (F.col("n_before") + F.col("row")).alias("no"), (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"), "rows")


def _with_successors(placed: DataFrame, cap: int) -> DataFrame:
    """grp, at, size, no, next: the number of the first sample of the next shard if this sample began one; null at the end.

    That is the sample that covers the byte `cap` after this one's start, or
    simply the next sample if this one alone is over the cap. It starts in the
    block of that byte or in the one before, so each block gets the last sample
    of the one before as well.
    """
    block = lambda c: F.floor(c / F.lit(cap))
    begun = placed.select("grp", block(F.col("start")).alias("block"), F.struct("start", "no", (F.col("start") + F.col("size")).alias("end")).alias("begun"))
    carried = begun.groupBy("grp", "block").agg(F.max("begun").alias("begun")).withColumn("block", F.col("block") + 1)
    known = begun.union(carried).select("grp", "block", F.col("begun.start").alias("key"), "begun", F.lit(None).alias("asks"))
    probe = F.col("start") + cap
    asked = placed.select("grp", block(probe).alias("block"), probe.alias("key"), F.lit(None).alias("begun"), F.struct("at", "size", "no", "rows").alias("asks"))
    upto = Window.partitionBy("grp", "block").orderBy("key", F.col("asks").isNotNull(), "begun.no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = known.union(asked).withColumn("last", F.last("begun", ignorenulls=True).over(upto)).where("asks is not null").select("grp", "asks.*", "key", "last")
    # The last sample that starts at or before that byte covers it, unless the group ends before.
    following = F.greatest("last.no", F.col("no") + 1)
    return found.select("grp", "at", "size", "no", F.when((F.col("last.end") > F.col("key")) & (following < F.col("rows")), following).alias("next"))


def _left_segments(segment: int):
    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each sample of a segment the first one beyond it that successors reach; -1 if the group ends."""
        for pdf in whole_groups(batches, ["grp", "segment"]):
            n = len(pdf)
            after, numbers = pdf["next"].fillna(-1).to_numpy(np.int64), pdf["no"].to_numpy(np.int64)
            # Rows of a segment follow one another, so a successor's row is as far on as its number.
            to = np.arange(n) + (after - numbers)
            inside = (after >= 0) & (after // segment == numbers // segment)
            out = np.where(inside, -1, after)
            for i in np.flatnonzero(inside)[::-1].tolist():
                out[i] = out[to[i]]
            yield pd.DataFrame({"grp": pdf["grp"].array, "no": numbers, "leaves": out})

    return follow


def _numbered_segments(segment: int):
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shards of each segment from its entry on; samples before the entry belong to the shard before, number -1."""
        for pdf in whole_groups(batches, ["grp", "segment"]):
            after, numbers, entry = pdf["next"].fillna(-1).to_numpy(np.int64), pdf["no"].to_numpy(np.int64), pdf["entry"].fillna(-1).to_numpy(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (numbers[1:] // segment != numbers[:-1] // segment) | (np.diff(numbers) != 1)]))
            starts = np.zeros(len(pdf), np.int64)
            for at in first.tolist():
                i, low = int(entry[at]), int(numbers[at])
                while i >= 0 and i // segment == low // segment:
                    starts[at + i - low] = 1
                    i = int(after[at + i - low])
            local = np.cumsum(starts)
            base = np.repeat((local - starts)[first], np.diff(np.append(first, len(pdf))))
            yield pdf[["grp", "segment", "at", "size"]].assign(local=local - base - 1)

    return number


def _entries(linked: DataFrame, in_order: Callable[[DataFrame], DataFrame], segment: int) -> DataFrame:
    """Where each segment is entered by the successors of its group's first sample: grp, segment, entry."""
    left = written(in_order(linked.select("grp", "segment", "no", "next")).mapInPandas(_left_segments(segment), "grp string, no long, leaves long"), "packed-jumps")
    # Segments are entered at a group's first sample and where another segment is left.
    doors = left.where("leaves >= 0").select("grp", F.col("leaves").alias("no")).union(left.where("no = 0").select("grp", "no")).distinct()
    jumps = written(left.join(doors, ["grp", "no"]).select("grp", "no", "leaves"), "packed-doors")
    reached = written(jumps.where("no = 0").select("grp", "no"), "packed-reached")
    while not (far := jumps.where("leaves >= 0")).isEmpty():
        reached = written(reached.union(reached.join(far, ["grp", "no"]).select("grp", F.col("leaves").alias("no"))), "packed-reached")
        onward = jumps.select("grp", F.col("no").alias("leaves"), F.col("leaves").alias("then"))
        jumps = written(far.join(onward, ["grp", "leaves"]).select("grp", "no", F.col("then").alias("leaves")), "packed-doors")

    return reached.select("grp", F.floor(F.col("no") / segment).alias("segment"), F.col("no").alias("entry"))


def packed(rows: DataFrame, group: str, order: str, size: str, cap: int, segment: int = SEGMENT, pieces: int | None = None) -> DataFrame:
    """rows(group, order, size) with a shard: a new one begins when the next size would take it over cap.

    Returns group (text), at, size, shard from 0 in each group. A sample over
    the cap has a shard of its own. Nulls and negative sizes count as 0; a null
    group is a group; a null order comes first; ties go by size. An empty table
    gives no rows. A segment of rows, or the samples of one shard, are what a
    task holds.
    """
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.col(group).cast("string")
    slim = rows.select(F.when(name.isNull(), "-").otherwise(F.concat(F.lit("+"), name)).alias("grp"), F.col(order).cast("long").alias("at"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    linked = written(_with_successors(_placed(slim, pieces), cap).withColumn("segment", F.floor(F.col("no") / segment)), "packed-successors")
    in_order = lambda df: df.repartition("grp", "segment").sortWithinPartitions("grp", "segment", "no")

    if linked.where("segment > 0").isEmpty():
        entries = linked.where("no = 0").select("grp", "segment", F.col("no").alias("entry"))
    else:
        entries = _entries(linked, in_order, segment)
    # An order goes through Python as text, so that none loses digits beside nulls.
    entered = linked.join(entries, ["grp", "segment"], "left").select("grp", "segment", F.col("at").cast("string").alias("at"), "size", "no", "next", "entry")
    numbered = written(in_order(entered).mapInPandas(_numbered_segments(segment), "grp string, segment long, at string, size long, local long"), "packed-numbered")
    before = Window.partitionBy("grp").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("grp", "segment").agg((F.max("local") + 1).alias("n"))
    offsets = counts.select("grp", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    whole = numbered.join(offsets, ["grp", "segment"])
    return whole.select(F.when(F.col("grp") != "-", F.substring("grp", 2, 2**31 - 1)).alias("group"), F.col("at").cast("long").alias("at"), "size", (F.col("offset") + F.col("local")).cast("int").alias("shard"))
