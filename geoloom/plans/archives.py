"""Samples written to tar archives and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import shards, store
from geoloom.operators.lineage import shared_folder
from geoloom.plans.tables import table
from geoloom.sources import tars

#: Bytes of content in one archive, and about what one task reads of it.
ARCHIVE_BYTES, SPLIT_BYTES = 400_000, 150_000


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Every page and its address as a sample, nine of ten for training, in archives of a new folder."""
    numbered = store.dense_index(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "no")
    binary = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    samples = numbered.select(shards.modulo_split(F.col("no"), 0.9).alias("split"), "no", F.format_string("pages_%06d", "page_id").alias("key"), F.create_map(F.lit("input.html"), binary("html"), F.lit("url.txt"), binary("url")).alias("fields"))
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    tars.write_tars(samples, folder, ARCHIVE_BYTES)
    return folder


def _archive() -> Column:
    return F.regexp_extract("path", r"([^/]+)\.tar$", 1).alias("archive")


def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member as it is read back: archive, member, size, sha256 of its content."""
    read = tars.read_tars(spark, _written(spark, sf_dir), split_bytes=SPLIT_BYTES)
    return read.select(_archive(), "member", "size", F.sha2("content", 256).alias("sha256"))


def tar_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and bytes of each archive, read back by sample."""
    read = tars.read_tars(spark, _written(spark, sf_dir), samples=True, split_bytes=SPLIT_BYTES)
    size = F.octet_length(F.col("fields")["input.html"]) + F.octet_length(F.col("fields")["url.txt"])
    return read.groupBy(_archive()).agg(F.count("*").alias("samples"), F.sum(size).alias("bytes"), F.min("key").alias("first_key"))


QUERIES = {f.__name__: f for f in (tar_members, tar_samples)}

_PACKED = """sized AS (
  SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, CASE WHEN (row_number() OVER (ORDER BY page_id) - 1) % 100 < 90 THEN 'train' ELSE 'val' END AS split FROM pages
), summed AS (
  SELECT *, strlen(html) + strlen(url) AS size, row_number() OVER w AS i, sum(strlen(html) + strlen(url)) OVER w AS upto FROM sized WINDOW w AS (PARTITION BY split ORDER BY page_id)
), walk AS (
  SELECT split, i, 0 AS shard, upto - size AS base FROM summed WHERE i = 1
  UNION ALL SELECT s.split, s.i, w.shard + 1, s.upto - s.size FROM walk w JOIN summed s ON s.split = w.split AND s.upto > w.base + 400000 AND s.upto - s.size <= w.base + 400000 AND s.i > w.i
), placed AS (
  SELECT s.*, w.split || '-' || lpad(CAST(w.shard AS VARCHAR), 6, '0') AS archive, 'pages_' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS key FROM summed s ASOF JOIN walk w ON s.split = w.split AND s.i >= w.i
)"""

ORACLE_SQL = {
    "tar_members": f"""WITH RECURSIVE {_PACKED} SELECT archive, key || '.input.html' AS member, strlen(html) AS size, sha256(html) AS sha256 FROM placed
        UNION ALL SELECT archive, key || '.url.txt', strlen(url), sha256(url) FROM placed""",
    "tar_samples": f"WITH RECURSIVE {_PACKED} SELECT archive, count(*) AS samples, CAST(sum(size) AS BIGINT) AS bytes, min(key) AS first_key FROM placed GROUP BY archive",
}
