"""Samples and splits of exact size, without a sort of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.vectors import hash_order

#: Bits of the digest that one refinement looks at.
STEP_BITS = 12
#: Hexadecimal digits of the digest that order the rows.
DIGITS = 15


def validation_size(n: int, ratio: float) -> int:
    """How many of n samples validate: int(n * ratio), but one at least and one less than all at most."""
    if n < 2:
        raise ValueError("a split needs two samples or more")
    return min(n - 1, max(1, int(n * ratio)))


def _place(key: str, seed: int) -> Column:
    """A number of 60 bits by the key's digest."""
    return F.conv(F.substring(hash_order(F.col(key), seed), 1, DIGITS), 16, 10).cast("long")


def kth_place(places: DataFrame, k: int, name: str = "place", bits: int = 4 * DIGITS) -> tuple[int, int]:
    """The k-th smallest of places(name), numbers below 2**bits, and how many are smaller.

    Histograms of a few bits each narrow it down: what reaches the driver is
    2**STEP_BITS counts a round, and after the first round only one bucket's
    rows are counted.
    """
    low, before = 0, 0
    while bits > 0:
        step = min(STEP_BITS, bits)
        bits -= step
        width = 1 << bits
        here = places.where((F.col(name) >= low) & (F.col(name) <= low + (width << step) - 1))
        counted = sorted((r["b"], r["n"]) for r in here.groupBy(F.shiftright(F.col(name) - low, bits).alias("b")).agg(F.count("*").alias("n")).collect())
        for b, n in counted:
            if before + n >= k:
                low += b * width
                break
            before += n
    return low, before


def exact_split(rows: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """rows with a split, 'val' for exactly validation_size of them, else 'train'; the same for a key in every run.

    Rows with the smallest digests validate. Where rows at the border have one
    digest, as of a repeated key, so many of them as are wanted validate; only
    those few are numbered. Fewer than two rows raise.
    """
    placed = rows.withColumn("__place", _place(key, seed))
    size = validation_size(rows.count(), ratio)
    border, before = kth_place(placed.select(F.col("__place").alias("place")), size)
    within = placed.where(F.col("__place") != border).withColumn("split", F.when(F.col("__place") < border, "val").otherwise("train"))
    at = F.row_number().over(Window.partitionBy("__place").orderBy(key))
    tied = placed.where(F.col("__place") == border).withColumn("split", F.when(at <= size - before, "val").otherwise("train"))
    return within.union(tied).drop("__place")


def rank_sample(rows: DataFrame, rank: str, key: str, most: int, seed: int = 0, parts: int = 16) -> DataFrame:
    """Of each rank the `most` rows with the smallest digests of their keys, in the same order in every run: rows with pool_no from 0.

    A bottom-k sample is made of the bottom-k samples of any parts, so each
    rank is dealt into parts first; what meets in one task for a rank is
    `most` rows of each part. most of 0 or less takes nothing.
    """
    drawn = rows.withColumns({"__hash": hash_order(F.col(key), seed), "__part": F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts))})
    least = lambda df, *by: df.withColumn("__no", F.row_number().over(Window.partitionBy(*by).orderBy("__hash", key))).where(F.col("__no") <= most)
    whole = least(least(drawn, rank, "__part").drop("__no"), rank)
    return whole.withColumn("pool_no", (F.col("__no") - 1).cast("int")).drop("__hash", "__part", "__no")
