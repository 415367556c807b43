"""Checks of records and shards, counters of runs, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import checks, geometry, store, vectors
from geoloom.plans.nearness import CODED_SQL
from geoloom.plans.tables import codebook, polygons, table
from geoloom.plans.tables import store as layers


def index_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of events, some of them without an id, with rows of unequal length, numbers out of range, or a short meta row."""
    e = F.col("event_id")
    row = lambda k, n: F.transform(F.sequence(F.lit(1), n), lambda i: (e * 37 + k + i) % 70_000)
    three = F.lit(3)
    grid = F.when(e % 13 == 1, F.array().cast("array<array<array<bigint>>>")).otherwise(F.array(F.array(row(0, three), row(5, F.when(e % 7 == 3, F.lit(2)).otherwise(three)))))
    records = table(spark, sf_dir, "events").select(e, F.when(e % 11 != 2, e).alias("gid"), grid.alias("indices"), F.array_repeat(F.lit(1.0), F.when(e % 17 == 4, F.lit(5)).otherwise(F.lit(6))).alias("meta"))
    return checks.index_faults(records).groupBy("fault").agg(F.count("*").alias("n"), F.count("gid").alias("named"), F.min("gid").alias("first_gid"))


def alignment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that documents, labels and pages do not all have once."""
    named = {n: table(spark, sf_dir, n).select(F.col(c).alias("key")) for n, c in (("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"))}
    return checks.alignment_faults(named, "key")


def _some_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All polygons, every ninth of which is a line."""
    line = F.transform("parts", lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(c["x"].alias("x"), c["x"].alias("y")))))
    return polygons(spark, sf_dir).select("gid", F.when(F.col("gid") % 9 == 5, line).otherwise(F.col("parts")).alias("parts"))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _some_lines(spark, sf_dir)
    return checks.run_counters(shapes, geometry.triangulate(shapes))


def failure_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of that run that gave no triangles."""
    shapes = _some_lines(spark, sf_dir)
    return checks.failure_records(shapes, geometry.triangulate(shapes), "supplier").drop("error")


def batch_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly codes are used within batches of 100 vectors, and in all."""
    codes = vectors.encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), codebook(spark, sf_dir))
    made = checks.batch_perplexity(codes.withColumn("batch", F.floor(F.col("vec_id") / 100)), "batch")
    return made.select("level", "batches", F.round("batch_mean", 6).alias("batch_mean"), F.round("overall", 6).alias("overall"))


def mixed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers one below another: of each how many rows fill each of the columns that any has."""
    every = store.concatenated([x.rows.withColumn("layer", F.lit(x.name)) for x in layers(spark, sf_dir).layers])
    return every.groupBy("layer").agg(*[F.count(c).alias(c) for c in ("gid", "status", "flag", "amount", "priority", "segment", "brand", "type", "price")])


def padded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names, some with wide characters before them, filled up to 26 columns."""
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "客户 ").otherwise(F.lit("")), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", checks.display_width(name).alias("width"), F.concat(checks.padded(name, 26), F.lit("|")).alias("line"))


QUERIES = {f.__name__: f for f in (index_faults, alignment_faults, run_counters, failure_records, batch_perplexity, mixed_layers, padded_names)}

_COLUMNS = ("gid", "status", "flag", "amount", "priority", "segment", "brand", "type", "price")
_FILLED = {
    "lineitem": ("gid", "status", "flag", "amount"), "orders": ("gid", "status", "priority", "amount"), "customer": ("gid", "segment", "amount"), "supplier": ("gid", "amount"),
    "part": ("gid", "brand", "type", "price"), "events": ("gid", "type", "amount"),
}

ORACLE_SQL = {
    "index_faults": """WITH r AS (SELECT event_id AS e, CASE WHEN event_id % 11 != 2 THEN event_id END AS gid FROM events
        ), f AS (SELECT gid, CASE WHEN gid IS NULL THEN 'gid' WHEN e % 13 = 1 THEN 'indices' WHEN e % 7 = 3 THEN 'ragged'
        WHEN list_max([(e * 37 + k) % 70000 FOR k IN [1, 2, 3, 6, 7, 8]]) > 65535 THEN 'range' WHEN e % 17 = 4 THEN 'meta' END AS fault FROM r)
        SELECT fault, count(*) AS n, count(gid) AS named, min(gid) AS first_gid FROM f WHERE fault IS NOT NULL GROUP BY fault""",
    "alignment_faults": """WITH k AS (SELECT doc_id AS key, 1 AS d, 0 AS l, 0 AS p FROM documents UNION ALL SELECT doc_id, 0, 1, 0 FROM labels UNION ALL SELECT page_id, 0, 0, 1 FROM pages)
        SELECT key, CAST(sum(d) AS BIGINT) AS n_documents, CAST(sum(l) AS BIGINT) AS n_labels, CAST(sum(p) AS BIGINT) AS n_pages FROM k GROUP BY key HAVING sum(d) != sum(l) OR sum(l) != sum(p)""",
    "run_counters": """WITH poly AS (SELECT s_suppkey AS gid, 3 + s_suppkey % 6 AS k, 1 + s_nationkey / 10.0e0 AS r, s_suppkey % 9 = 5 AS line, s_suppkey % 4 = 0 AS holed, s_suppkey % 7 = 0 AS multi FROM supplier
        ), t AS (SELECT *, CASE WHEN line THEN 0 ELSE k - 2 + CASE WHEN holed THEN k + 2 ELSE 0 END + CASE WHEN multi THEN k - 2 ELSE 0 END END AS n,
        multi OR line AND list_min([abs(cos(2 * pi() * (i + 1) / k) - cos(2 * pi() * i / k)) FOR i IN range(k)]) < 1e-9 AS risky FROM poly)
        SELECT count(*) AS total_rows, CAST(sum(n) AS BIGINT) AS triangles, count(*) FILTER (WHERE n > 0) AS triangulated_rows, 0 AS degenerate_rows, 0 AS degenerate_triangles, 0 AS dropped_rows, count(*) FILTER (WHERE line) AS failed_rows,
        count(*) FILTER (WHERE risky) AS isolated_rows, count(*) FILTER (WHERE multi) AS multipolygon_rows, count(*) FILTER (WHERE holed) AS hole_rows, count(*) FILTER (WHERE multi AND n > 0) AS triangulated_multipolygon_rows,
        count(*) FILTER (WHERE holed AND n > 0) AS triangulated_hole_rows, count(*) FILTER (WHERE multi AND line) AS dropped_multipolygon_rows, count(*) FILTER (WHERE holed AND line) AS dropped_hole_rows FROM t""",
    "failure_records": """SELECT 'supplier' AS layer, s_suppkey AS gid, CASE WHEN s_suppkey % 7 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type, CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 1 END AS parts,
        CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS holes, CAST((3 + s_suppkey % 6) * (1 + CAST(s_suppkey % 4 = 0 AS INTEGER) + CAST(s_suppkey % 7 = 0 AS INTEGER)) AS INTEGER) AS points FROM supplier WHERE s_suppkey % 9 = 5""",
    "batch_perplexity": f"""WITH {CODED_SQL}, c AS (SELECT level, vec_id // 100 AS batch, code, count(*) AS uses FROM codes GROUP BY ALL
        ), b AS (SELECT level, batch, exp(ln(sum(uses)) - sum(uses * ln(uses)) / sum(uses)) AS p FROM c GROUP BY ALL
        ), g AS (SELECT level, exp(ln(sum(uses)) - sum(uses * ln(uses)) / sum(uses)) AS p FROM (SELECT level, code, sum(uses) AS uses FROM c GROUP BY ALL) GROUP BY level)
        SELECT b.level, count(*) AS batches, round(avg(b.p), 6) AS batch_mean, round(any_value(g.p), 6) AS overall FROM b JOIN g ON b.level = g.level GROUP BY b.level""",
    "mixed_layers": " UNION ALL ".join(f"SELECT '{t}' AS layer, {', '.join(f'{"count(*)" if c in have else 0} AS {c}' for c in _COLUMNS)} FROM {t}" for t, have in _FILLED.items()),
    "padded_names": """SELECT c_custkey, CAST(length(c_name) + w AS INTEGER) AS width, CASE WHEN w > 0 THEN '客户 ' ELSE '' END || c_name || repeat(' ', greatest(26 - length(c_name) - w, 0)) || '|' AS line
        FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 0 END AS w FROM customer)""",
}
