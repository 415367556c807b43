"""Splits, shards, schedules and series of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import ramp, warm_cosine
from geoloom.operators import metrics, shards, store
from geoloom.plans.tables import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.dense_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


def modulo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", shards.modulo_split(F.col("global_idx"), 0.9).alias("split"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90, 5 and 5 of 100 by a digest of the key."""
    return shards.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.9, "val": 0.05, "test": 0.05}, seed=3)


def sample_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.rank_of(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8)


def row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.batches(_orders(spark, sf_dir), 512, drop_last=True).groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).cast("string").alias("grp"), F.col("c_custkey").alias("at"), (640 + F.length("c_name") * (1 + F.col("c_custkey") % 50)).cast("long").alias("bytes"))


def packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each group packed in order into shards of at most 20000 bytes."""
    return shards.packed(_sized(spark, sf_dir), "grp", "at", "bytes", 20_000)


def packed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one group, packed in the order of their keys into shards of at most 1000000 bytes."""
    sized = table(spark, sf_dir, "orders").select(F.lit("all").alias("grp"), F.col("o_orderkey").alias("at"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return shards.packed(sized, "grp", "at", "bytes", 1_000_000, segment=20_000).select("at", "size", "shard")


def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 37).alias("s"), F.lit(640).alias("b"))
    return shards.manifest(made, "s", "b")


def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.manifest_totals(shard_manifest(spark, sf_dir))


def sample_places_hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample whose number 100 divides; of these every tenth again, and for every fifth a negative number that no shard holds."""
    index = F.col("global_idx")
    asked = F.array_compact(F.array(index, F.when(index % 1000 == 0, index), F.when(index % 500 == 0, -1 - index)))
    wanted = _orders(spark, sf_dir).where(index % 100 == 0).select(F.explode(asked).alias("index"))
    return shards.located(wanted, shard_manifest(spark, sf_dir))


def pairing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, and labels without documents, in different numbers."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return shards.pairing_faults(docs, labels, "doc_id")


def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("mean"))


def rank_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("rank", F.col("user_id") % 4)
    return metrics.mean_of_rank_means(e, "event_type", "rank", "value").withColumn("mean", F.round("mean", 6))


def best_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events the least value so far."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return metrics.best_so_far(e, "user_id", ["ts", "event_id"], "value").select("event_id", "best", "improved")


def metric_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("step"), F.pmod(F.col("event_id") * 37, F.lit(101)).alias("active"), (F.pmod(F.col("event_id") * 13, F.lit(97)) / 96).alias("share"))
    return metrics.alerts(e, "series", "step", "active", "share", 500, 5, 90, 0.98).where("reasons != ''").select("series", "step", "reasons")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    spike = F.when(F.col("event_id") % 97 < 4, 50.0).otherwise(1.0)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("step"), ((1 + F.col("value") / 1000) * spike).alias("mag"), (1 + F.col("user_id") / 100_000).alias("phase"))


def collapse_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.guarded(_series(spark, sf_dir)).select("series", "step", "reasons", "bad_steps", "triggered")


def user_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over one series for each kind of event and user, so that series grow with the users."""
    spike = F.when(F.col("event_id") % 11 < 3, 50.0).otherwise(1.0)
    series = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("series"), F.col("event_id").alias("step"), ((1 + F.col("value") / 1000) * spike).alias("mag"), (1 + F.col("user_id") / 100_000).alias("phase"))
    return metrics.guarded(series, 2, 3.0, 3.0, 2).select("series", "step", "reasons", "bad_steps", "triggered")


def series_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rate factor and loss weight of the epoch in which each order is trained on, one of 40."""
    e = (F.col("o_orderkey") % 40).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(warm_cosine(e, 10, 40, 0.05), 8).alias("rate"), F.round(ramp(e, 0.25, 10, 5), 8).alias("beta"))


QUERIES = {
    f.__name__: f
    for f in (
        modulo_split, hash_split, sample_ranks, row_batches, packed_shards, packed_orders, shard_manifest, manifest_totals, pairing_faults, weighted_means, rank_means, best_values, metric_alerts,
        collapse_guard, user_guard, series_medians, schedules, sample_places_hundredths,
    )
}

_IDX = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS g FROM orders)"
_PLACE = "CAST(('0x' || substr(md5(o_orderkey || ':3'), 1, 8)) AS BIGINT) / 4294967296.0e0"
_MANIFEST = "manifest AS (SELECT s AS shard, n AS samples, n * 640 AS bytes, CAST(sum(n) OVER (ORDER BY s) - n AS BIGINT) AS start_index FROM (SELECT o_orderkey % 37 AS s, count(*) AS n FROM orders GROUP BY 1))"



def _guard_sql(series: str, spike: str, steps: int, patience: int) -> str:
    """The last good steps of each series as lists that go from step to step."""
    over = lambda kept, v: f"(len({kept}) >= {steps} AND list_median({kept}) > 0 AND {v} / list_median({kept}) > 3)"
    last = lambda kept, v: f"list_append({kept}, {v})[greatest(1, len({kept}) + 2 - {steps}):]"
    return f"""WITH RECURSIVE rows AS (
        SELECT *, row_number() OVER (PARTITION BY series ORDER BY step) AS i FROM (SELECT {series} AS series, event_id AS step, (1 + value / 1000) * CASE WHEN {spike} THEN 50.0e0 ELSE 1.0e0 END AS mag, 1 + user_id / 100000e0 AS phase FROM events)
        ), walk AS (SELECT series, i, step, '' AS reasons, 0 AS bad, [mag] AS mags, [phase] AS phases FROM rows WHERE i = 1
        UNION ALL SELECT series, i, step, reasons, CASE WHEN reasons = '' THEN 0 ELSE bad + 1 END, CASE WHEN reasons = '' THEN {last("mags", "mag")} ELSE mags END, CASE WHEN reasons = '' THEN {last("phases", "phase")} ELSE phases END
        FROM (SELECT r.series, r.i, r.step, r.mag, r.phase, w.bad, w.mags, w.phases, concat_ws(',', CASE WHEN {over("w.mags", "r.mag")} THEN 'mag' END, CASE WHEN {over("w.phases", "r.phase")} THEN 'phase' END) AS reasons
        FROM walk w JOIN rows r ON r.series = w.series AND r.i = w.i + 1))
        SELECT series, step, reasons, bad AS bad_steps, reasons != '' AND bad >= {patience} AS triggered FROM walk"""


ORACLE_SQL = {
    "collapse_guard": _guard_sql("event_type", "event_id % 97 < 4", 20, 3),
    "user_guard": _guard_sql("event_type || ':' || user_id", "event_id % 11 < 3", 2, 2),
    "modulo_split": f"SELECT o_orderkey, CASE WHEN g % 100 < 90 THEN 'train' ELSE 'val' END AS split FROM {_IDX}",
    "hash_split": f"SELECT o_orderkey, CASE WHEN {_PLACE} < 0.9e0 THEN 'train' WHEN {_PLACE} < 0.9e0 + 0.05e0 THEN 'val' ELSE 'test' END AS split FROM orders",
    "row_batches": f"SELECT g // 512 AS batch, count(*) AS n, min(o_orderkey) AS first_key FROM {_IDX} GROUP BY 1 HAVING count(*) = 512",
    "packed_shards": """WITH RECURSIVE sized AS (
        SELECT CAST(c_nationkey % 5 AS VARCHAR) AS grp, c_custkey AS place, 640 + length(c_name) * (1 + c_custkey % 50) AS size, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS i FROM customer
        ), walk AS (SELECT grp, place, size, i, 0 AS shard, size AS held FROM sized WHERE i = 1
        UNION ALL SELECT s.grp, s.place, s.size, s.i, w.shard + CASE WHEN w.held + s.size > 20000 THEN 1 ELSE 0 END, CASE WHEN w.held + s.size > 20000 THEN s.size ELSE w.held + s.size END FROM walk w JOIN sized s ON s.grp = w.grp AND s.i = w.i + 1)
        SELECT grp AS "group", place AS "at", size, shard FROM walk""",
    "packed_orders": """WITH RECURSIVE sized AS (
        SELECT o_orderkey AS place, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER w AS i, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER w AS upto FROM orders WINDOW w AS (ORDER BY o_orderkey)
        ), walk AS (SELECT CAST(1 AS BIGINT) AS i, 0 AS shard UNION ALL SELECT max(n.i), max(w.shard) + 1 FROM walk w JOIN sized f ON f.i = w.i
        JOIN LATERAL (SELECT min(s.i) AS i FROM sized s WHERE s.i > w.i AND s.upto > f.upto - f.size + 1000000) n ON true HAVING max(n.i) IS NOT NULL)
        SELECT place AS "at", size, CAST(shard AS INTEGER) AS shard FROM sized s ASOF JOIN walk w ON s.i >= w.i""",
    "shard_manifest": f"WITH {_MANIFEST} SELECT * FROM manifest",
    "manifest_totals": f"WITH {_MANIFEST} SELECT count(*) AS shards, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(bytes) AS BIGINT) AS bytes, avg(samples) AS mean_samples FROM manifest",
    "sample_places_hundredths": f"""WITH {_MANIFEST}, asked AS (SELECT g FROM {_IDX} WHERE g % 100 = 0 UNION ALL SELECT g FROM {_IDX} WHERE g % 1000 = 0 UNION ALL SELECT -1 - g FROM {_IDX} WHERE g % 500 = 0)
        SELECT g AS "index", shard, g - start_index AS "local" FROM asked JOIN manifest ON g >= start_index AND g < start_index + samples""",
    "pairing_faults": """SELECT doc_id, a AS n_left, b AS n_right FROM (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT doc_id, count(*) AS a FROM documents GROUP BY 1) d
        FULL JOIN (SELECT doc_id, count(*) AS b FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id) WHERE a != b""",
    "weighted_means": "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1",
    "rank_means": "SELECT event_type, round(avg(m), 6) AS mean FROM (SELECT event_type, user_id % 4 AS r, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1",
    "best_values": """SELECT event_id, min(value) OVER w AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "metric_alerts": """WITH e AS (SELECT event_type AS series, event_id AS step, event_id * 37 % 101 AS active, event_id * 13 % 97 / 96.0e0 AS share FROM events
        ), d AS (SELECT *, lag(active) OVER (PARTITION BY series ORDER BY step) - active AS fall FROM e
        ), r AS (SELECT series, step, concat_ws(',', CASE WHEN step % 500 = 0 THEN 'interval' END, CASE WHEN active < 5 THEN 'low_active' END, CASE WHEN fall > 90 THEN 'drop' END, CASE WHEN share > 0.98 THEN 'top_share' END) AS reasons FROM d)
        SELECT * FROM r WHERE reasons != ''""",
    "series_medians": "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1",
    "schedules": """SELECT o_orderkey, round(CASE WHEN i <= 10 THEN 0.05e0 + 0.95e0 * i / 10 ELSE 0.05e0 + 0.475e0 * (1 + cos(pi() * (i - 10) / 30)) END, 8) AS rate,
        round(CASE WHEN i < 10 THEN 0 ELSE 0.25e0 * least(1, (i - 10) / 5.0e0) END, 8) AS beta FROM (SELECT o_orderkey, o_orderkey % 40 AS i FROM orders)""",
}
