"""The test tables, and what is derived from them by plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.spatial import boxes_from_meta
from geoloom.operators.store import Layer, Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession, sf_dir: str) -> Store:
    """Six layers that share some field names."""
    t = lambda n: table(spark, sf_dir, n)
    return Store(
        [
            Layer("lineitem", t("lineitem").selectExpr("l_orderkey AS gid", "l_linestatus AS status", "l_returnflag AS flag", "l_extendedprice AS amount"), "gid", trimmed=True),
            Layer("orders", t("orders").selectExpr("o_orderkey AS gid", "o_orderstatus AS status", "o_orderpriority AS priority", "o_totalprice AS amount"), "gid", trimmed=True),
            Layer("customer", t("customer").selectExpr("c_custkey AS gid", "c_mktsegment AS segment", "c_acctbal AS amount"), "gid", trimmed=True),
            Layer("supplier", t("supplier").selectExpr("s_suppkey AS gid", "s_acctbal AS amount"), "gid", trimmed=True),
            Layer("part", t("part").selectExpr("p_partkey AS gid", "p_brand AS brand", "p_type AS type", "p_retailprice AS price"), "gid", trimmed=True),
            Layer("events", t("events").selectExpr("event_id AS gid", "event_type AS type", "value AS amount"), "gid", trimmed=True),
        ]
    )


def library_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("lid"), F.col("p_size").cast("double").alias("cx"), ((F.col("p_retailprice") - 900) / 2).alias("cy"),
        (1 + F.col("p_partkey") % 3).cast("double").alias("lx"), (1 + F.col("p_partkey") % 5).cast("double").alias("ly"),
    )
    return boxes_from_meta(boxes, "cx", "cy", "lx", "ly")


BOXES_SQL = """library AS (
  SELECT p_partkey AS lid, p_size - (1 + p_partkey % 3) / 2.0 AS x0, (p_retailprice - 900) / 2 - (1 + p_partkey % 5) / 2.0 AS y0,
         p_size + (1 + p_partkey % 3) / 2.0 AS x1, (p_retailprice - 900) / 2 + (1 + p_partkey % 5) / 2.0 AS y1 FROM part
), grid AS (
  SELECT i AS qid, (i % 20) * 2.5e0 AS x0, (i // 20) * 2.5e0 AS y0, (i % 20 + 1) * 2.5e0 AS x1, (i // 20 + 1) * 2.5e0 AS y1 FROM range(400) r(i)
)"""

def skewed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each order: most lie near the origin, one of 100 is large and one of 1000 is huge: lid, x0, y0, x1, y1."""
    key = F.col("o_orderkey")
    power = lambda c: F.aggregate(F.array_repeat(F.col(c), 5), F.col(c), lambda a, u: a * u) * 10_000
    size = F.when(key % 1000 == 7, 2000.0).when(key % 100 == 3, 100.0).otherwise(1.0)
    drawn = table(spark, sf_dir, "orders").select(key.alias("lid"), ((key * 7919 % 10007) / F.lit(10007.0)).alias("u"), ((key * 104729 % 10009) / F.lit(10009.0)).alias("v"), size.alias("size"))
    placed = drawn.select("lid", power("u").alias("x0"), power("v").alias("y0"), "size")
    return placed.select("lid", "x0", "y0", (F.col("x0") + F.col("size") * (1 + F.col("lid") % 7) / 4).alias("x1"), (F.col("y0") + F.col("size") * (1 + F.col("lid") % 5) / 4).alias("y1"))


SKEWED_SQL = """drawn AS (
  SELECT o_orderkey AS lid, o_orderkey * 7919 % 10007 / 10007.0e0 AS u, o_orderkey * 104729 % 10009 / 10009.0e0 AS v,
         CASE WHEN o_orderkey % 1000 = 7 THEN 2000.0e0 WHEN o_orderkey % 100 = 3 THEN 100.0e0 ELSE 1.0e0 END AS size FROM orders
), skewed AS (
  SELECT lid, u * u * u * u * u * u * 10000 AS x0, v * v * v * v * v * v * 10000 AS y0,
         u * u * u * u * u * u * 10000 + size * (1 + lid % 7) / 4 AS x1, v * v * v * v * v * v * 10000 + size * (1 + lid % 5) / 4 AS y1 FROM drawn
)"""

#: Regular polygons of suppliers: sides, radius and centre.
POLYGON = "s_suppkey AS gid, 3 + s_suppkey % 6 AS k, 1 + s_nationkey / CAST(10 AS DOUBLE) AS r, CAST(s_suppkey % 17 AS DOUBLE) AS mx, CAST(s_suppkey % 13 AS DOUBLE) AS my"

def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, k, r, mx, my, parts: every fourth polygon has a hole of half its size, every seventh a second part beside it."""
    base = table(spark, sf_dir, "supplier").selectExpr(*POLYGON.split(", "))
    ring = lambda dx, f: F.transform(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")), lambda i: F.struct((F.col("mx") + dx + F.col("r") * f * F.cos(2 * F.pi() * i / F.col("k"))).alias("x"), (F.col("my") + F.col("r") * f * F.sin(2 * F.pi() * i / F.col("k"))).alias("y")))
    shell = F.when(F.col("gid") % 4 == 0, F.array(ring(F.lit(0.0), 1.0), ring(F.lit(0.0), 0.5))).otherwise(F.array(ring(F.lit(0.0), 1.0)))
    parts = F.when(F.col("gid") % 7 == 0, F.array(shell, F.array(ring(3 * F.col("r"), 1.0)))).otherwise(F.array(shell))
    return base.withColumn("parts", parts)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fans from the centre of each regular polygon, scaled to radius below 1 round the origin: gid, tri_no, ax..cy."""
    base = table(spark, sf_dir, "supplier").selectExpr(*POLYGON.split(", ")).withColumn("tri_no", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    at = lambda i: 2 * F.pi() * i / F.col("k")
    q = F.col("r") / 4
    return base.select(
        "gid", "tri_no", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), (q * F.cos(at(F.col("tri_no")))).alias("bx"), (q * F.sin(at(F.col("tri_no")))).alias("by"),
        (q * F.cos(at(F.col("tri_no") + 1))).alias("cx"), (q * F.sin(at(F.col("tri_no") + 1))).alias("cy"),
    )


TRIANGLES_SQL = """shapes AS (
  SELECT s_suppkey AS gid, 3 + s_suppkey % 6 AS k, (1 + s_nationkey / 10.0e0) / 4 AS q FROM supplier
), triangles AS (
  SELECT gid, t AS tri_no, 0.0e0 AS x1, 0.0e0 AS y1, q * cos(2 * pi() * t / k) AS x2, q * sin(2 * pi() * t / k) AS y2,
         q * cos(2 * pi() * (t + 1) / k) AS x3, q * sin(2 * pi() * (t + 1) / k) AS y3
  FROM shapes, range(8) r(t) WHERE t < k
)"""


def codebook(spark: SparkSession, sf_dir: str, size: int = 64, levels: int = 2) -> DataFrame:
    """Codes of each level: the vectors that follow one another by vec_id."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < size * levels)
    return rows.select(F.floor(F.col("vec_id") / size).cast("int").alias("level"), (F.col("vec_id") % size).alias("code"), F.col("embedding").cast("array<double>").alias("vec"))
