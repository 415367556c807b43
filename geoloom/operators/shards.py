"""Splits, batches, shards and their manifests."""

from __future__ import annotations

import hashlib
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.packing import packed  # noqa: F401
from geoloom.operators.store import running
from geoloom.operators.vectors import hash_order

#: Estimated bytes of a sample besides its payload.
SAMPLE_OVERHEAD = 640


def modulo_split(index: Column, ratio: float) -> Column:
    """'train' for the first ratio of every hundred places, else 'val'."""
    return F.when(F.pmod(index, F.lit(100)) < F.lit(ratio * 100), "train").otherwise("val")


def hash_split(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """rows with a split drawn by a digest of the key; the same for a key in every run and at every size."""
    place = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    names, edge, split = list(shares), 0.0, None
    for name in names[:-1]:
        edge += shares[name]
        split = (split.when if split is not None else F.when)(place < edge, F.lit(name))
    return rows.withColumn("split", split.otherwise(F.lit(names[-1])) if split is not None else F.lit(names[-1]))


def rank_of(keys: DataFrame, key: str, ranks: int) -> DataFrame:
    """keys with the rank that takes each: the first 8 bytes of its BLAKE2b digest, little-endian, modulo ranks."""

    @F.pandas_udf("int")
    def rank(names: pd.Series) -> pd.Series:
        return names.map(lambda n: int.from_bytes(hashlib.blake2b(str(n).encode(), digest_size=8).digest(), "little") % ranks)

    return keys.withColumn("rank", rank(F.col(key).cast("string")))


def batches(indexed: DataFrame, size: int, drop_last: bool = False, index: str = "global_idx") -> DataFrame:
    """A densely numbered table with batch numbers; a last batch that is not full may be dropped."""
    made = indexed.withColumn("batch", F.floor(F.col(index) / size).cast("bigint"))
    return made.where(F.col("batch") < indexed.count() // size) if drop_last else made


def manifest(rows: DataFrame, shard: str, size: str) -> DataFrame:
    """Of each shard: samples, bytes, and the number of its first sample, by running sums over ranges of shards."""
    each = rows.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("samples"), F.sum(size).cast("bigint").alias("bytes"))
    return running(each, ["shard"], "samples").withColumnRenamed("__before", "start_index").withColumn("start_index", F.col("start_index").cast("bigint"))


def manifest_totals(shards: DataFrame) -> DataFrame:
    return shards.agg(F.count("*").alias("shards"), F.sum("samples").alias("samples"), F.sum("bytes").alias("bytes"), F.avg("samples").alias("mean_samples"))


def located(wanted: DataFrame, shards: DataFrame, index: str = "index", block: int = 100_000) -> DataFrame:
    """wanted(index) with the shard that holds it and its place there; the manifest has one row a shard.

    An equi-join on blocks of indices, so the manifest may grow with the data.
    """
    first, last = F.floor(F.col("start_index") / block), F.floor((F.col("start_index") + F.col("samples") - 1) / block)
    blocks = shards.where("samples > 0").withColumn("of_block", F.explode(F.sequence(first, last)))
    inside = (F.col(index) >= F.col("start_index")) & (F.col(index) < F.col("start_index") + F.col("samples"))
    return wanted.join(blocks, (F.floor(F.col(index) / block) == F.col("of_block")) & inside).select(index, "shard", (F.col(index) - F.col("start_index")).alias("local"))


def write_sharded(rows: DataFrame, folder: str, splits: list[str], records: int) -> None:
    """Writes rows in files of at most `records`, by split columns; refuses a folder that exists. Spark's commit keeps whole files only."""
    rows.write.mode("errorifexists").option("maxRecordsPerFile", records).partitionBy(*splits).parquet(folder)


def file_manifest(spark, folder: str) -> DataFrame:
    """What a written folder holds: file, samples."""
    return spark.read.parquet(folder).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("samples"))


def pairing_faults(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, or that they have in different numbers; none if they pair."""
    a, b = left.groupBy(key).agg(F.count("*").alias("n_left")), right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left != n_right")
