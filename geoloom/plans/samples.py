"""Splits and samples of exact size, and likeness of images."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import images, sampling
from geoloom.operators.lineage import shared_folder
from geoloom.operators.versions import Versions
from geoloom.plans.tables import table


def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """int(n * 0.07) orders for validation, no more and no less."""
    return sampling.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.07, seed=5)


def restart_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vectors of each of four ranks the 25 that come first by their digests."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("rank"), "vec_id")
    return sampling.rank_sample(v, "rank", "vec_id", 25, seed=9)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 by 16 events an image, whole ones only."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 256).alias("image"), (F.col("event_id") % 256).alias("cell"), F.col("event_id").alias("id"), "user_id")
    cells = e.select("image", F.floor(F.col("cell") / 16).cast("int").alias("py"), (F.col("cell") % 16).cast("int").alias("px"), (F.col("id") * 37 % 101 / F.lit(100.0)).alias("pred"), (F.col("user_id") % 3 == 0).cast("double").alias("target"))
    return images.image_arrays(cells, "image", ["pred", "target"]).where("height = 16 and width = 16")


def structural_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - SSIM with the Gaussian window, and the distance of Fourier transforms, of each image."""
    made = images.structural_losses(_images(spark, sf_dir), "image", "pred", "target")
    return made.select("image", F.round("ssim_loss", 7).alias("ssim_loss"), F.round("spectral_loss", 6).alias("spectral_loss"))


def even_window_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - SSIM with an even window of seven, by integral images."""
    made = images.structural_losses(_images(spark, sf_dir), "image", "pred", "target", 7, None)
    return made.select("image", F.round("ssim_loss", 7).alias("ssim_loss"))


def loaded_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment as the second of two committed versions gives them back."""
    kept = Versions(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    kept.commit(rows.where("c_acctbal < 0"))
    kept.commit(rows)
    found, version = kept.load()
    return found.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).withColumn("version", F.lit(version.number))


QUERIES = {f.__name__: f for f in (exact_split, restart_pool, structural_losses, even_window_losses, loaded_version)}

_IMAGES = """cells AS (
  SELECT event_id // 256 AS image, event_id % 256 // 16 AS py, event_id % 16 AS px, event_id * 37 % 101 / 100.0e0 AS p, CAST(user_id % 3 = 0 AS DOUBLE) AS t FROM events
), whole AS (SELECT image FROM cells GROUP BY image HAVING count(*) = 256
), c AS (SELECT * FROM cells SEMI JOIN whole USING (image))"""
_SSIM = """w AS (
  SELECT image, y, x, sum(g * p) AS mp, sum(g * t) AS mt, sum(g * p * p) AS pp, sum(g * t * t) AS tt, sum(g * p * t) AS pt FROM c, range({n}) a(y), range({n}) b(x), gauss
  WHERE py = y + i AND px = x + j GROUP BY image, y, x
), alike AS (
  SELECT image, 1 - avg((2 * mp * mt + 1e-4) * (2 * (pt - mp * mt) + 9e-4) / ((mp * mp + mt * mt + 1e-4) * (pp - mp * mp + tt - mt * mt + 9e-4))) AS loss FROM w GROUP BY image)"""

ORACLE_SQL = {
    "exact_split": """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey || ':5')) <= (SELECT least(count(*) - 1, greatest(1, CAST(floor(count(*) * 0.07e0) AS BIGINT))) FROM orders) THEN 'val' ELSE 'train' END AS split FROM orders""",
    "restart_pool": """SELECT * FROM (SELECT vec_id % 4 AS rank, vec_id, CAST(row_number() OVER (PARTITION BY vec_id % 4 ORDER BY md5(vec_id || ':9')) - 1 AS INTEGER) AS pool_no FROM embeddings) WHERE pool_no < 25""",
    "structural_losses": f"""WITH {_IMAGES}, taps AS (SELECT i, exp(-(i - 5) * (i - 5) / 4.5e0) AS g FROM range(11) r(i)
        ), gauss AS (SELECT a.i, b.i AS j, a.g * b.g / ((SELECT sum(g) FROM taps) * (SELECT sum(g) FROM taps)) AS g FROM taps a, taps b
        ), {_SSIM.format(n=6)}, f AS (SELECT image, u, v, sum((p - t) * cos(2 * pi() * (u * py + v * px) / 16)) AS re, sum((p - t) * sin(2 * pi() * (u * py + v * px) / 16)) AS im FROM c, range(16) a(u), range(9) b(v) GROUP BY image, u, v
        ), far AS (SELECT image, avg(sqrt(re * re + im * im)) AS d FROM f GROUP BY image)
        SELECT image, round(loss, 7) AS ssim_loss, round(d, 6) AS spectral_loss FROM alike JOIN far USING (image)""",
    "even_window_losses": f"""WITH {_IMAGES}, gauss AS (SELECT a.i, b.i AS j, 1 / 49.0e0 AS g FROM range(7) a(i), range(7) b(i)), {_SSIM.format(n=10)} SELECT image, round(loss, 7) AS ssim_loss FROM alike""",
    "loaded_version": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, 2 AS version FROM customer GROUP BY 1",
}
