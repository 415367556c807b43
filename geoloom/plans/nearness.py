"""Boxes, nearest vectors and codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import grid_position_code
from geoloom.operators import pivots, quadtree, spatial, store, vectors
from geoloom.plans.tables import BOXES_SQL, SKEWED_SQL, codebook, library_boxes, skewed_boxes, table

K_CODES = 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def box_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library_boxes(spark, sf_dir).select("lid", "x0", "y0", "x1", "y1")


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a grid cell and a library box that overlap."""
    return spatial.box_pairs(spatial.grid_boxes(spark, 20, 20, 2.5), library_boxes(spark, sf_dir), 2.5)


def box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.box_counts(spatial.grid_boxes(spark, 20, 20, 2.5), library_boxes(spark, sf_dir), 2.5)


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each vector whose id is divisible by 100."""
    v = _vectors(spark, sf_dir)
    return vectors.knn(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), v, 10).withColumn("d2", F.round("d2", 6))


def _every_hundredth(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key) % 100 == 0).withColumnRenamed(key, "qid")


def skewed_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every hundredth box with all boxes, of very unequal sizes and density."""
    boxes = skewed_boxes(spark, sf_dir)
    return quadtree.box_pairs(_every_hundredth(boxes, "lid"), boxes)


def skewed_box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = skewed_boxes(spark, sf_dir)
    return quadtree.box_counts(_every_hundredth(boxes, "lid"), boxes)


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn, by pivots, with queries that are joined and not gathered."""
    v = _vectors(spark, sf_dir)
    return pivots.knn_join(_every_hundredth(v, "vec_id"), v, 10)[0].withColumn("d2", F.round("d2", 6))


def nearest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.encode(_vectors(spark, sf_dir), codebook(spark, sf_dir).where("level = 0")).select("vec_id", "code", F.round("d2", 6).alias("d2"))


def nearest_code_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_nearest(_vectors(spark, sf_dir), codebook(spark, sf_dir).where("level = 0")).select("vec_id", "code", F.round("d2", 6).alias("d2"))


def residual_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.encode(_vectors(spark, sf_dir), codebook(spark, sf_dir)).select("vec_id", "level", "code")


def code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that the codes of two levels stand for."""
    codes = vectors.encode(_vectors(spark, sf_dir), codebook(spark, sf_dir))
    return vectors.decode(codes, codebook(spark, sf_dir)).select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


def code_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.usage(vectors.encode(_vectors(spark, sf_dir), codebook(spark, sf_dir)), K_CODES)


def usage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = vectors.usage_metrics(code_usage(spark, sf_dir))
    return m.select("level", "total", "active", *[F.round(c, 6).alias(c) for c in ("perplexity", "used_share", "top1_share", "topk_share")])


def code_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = codebook(spark, sf_dir).where("level = 0")
    s = vectors.sums_by_code(_vectors(spark, sf_dir), vectors.encode(_vectors(spark, sf_dir), book))
    return s.select("code", "pos", F.round("total", 5).alias("total"), "n")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook(spark, sf_dir).where("level = 0").select("code", F.lit(1.0).alias("size"), F.posexplode("vec").alias("pos", "average"))


def ema_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = codebook(spark, sf_dir).where("level = 0")
    batch = vectors.sums_by_code(_vectors(spark, sf_dir), vectors.encode(_vectors(spark, sf_dir), book))
    return vectors.ema_update(_state(spark, sf_dir), batch).select("code", "pos", F.round("size", 6).alias("size"), F.round("vec", 5).alias("vec"))


def dead_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that fewer than three vectors use take vectors of a small pool in turn."""
    book = codebook(spark, sf_dir).where("level = 0").select("code", "vec")
    sized = book.join(code_usage(spark, sf_dir).where("level = 0").select("code", F.col("uses").cast("double").alias("size")), "code")
    pool = _vectors(spark, sf_dir).where("vec_id BETWEEN 200 AND 204").select(F.col("vec_id").alias("pool_no"), F.col("embedding").cast("array<double>").alias("vec"))
    return vectors.restart_dead(sized, pool, 3.0).select("code", "size", "restarted", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors.norm_stats(_vectors(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.channel_stats(_vectors(spark, sf_dir)).select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def used_code_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.encode(_vectors(spark, sf_dir), codebook(spark, sf_dir)).agg(F.count_distinct("level", "code").alias("used"))


def method_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.method_mismatches(_vectors(spark, sf_dir), codebook(spark, sf_dir))


def kmeans_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook after two Lloyd rounds from the first 16 vectors."""
    return vectors.kmeans(_vectors(spark, sf_dir), 16, 2).select("code", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 5))


def residual_kmeans_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared distance left on each of two fitted levels."""
    v = _vectors(spark, sf_dir)
    book = vectors.residual_kmeans(v, 2, 16, 3)
    return vectors.encode(v, book).groupBy("level").agg(F.round(F.avg("d2"), 4).alias("error"))


def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return vectors.mean_pool(each.withColumn("x", F.col("x").cast("double")), "label", "pos", "x").withColumn("mean", F.round("mean", 6))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 parts that is the same in every run."""
    return vectors.hash_sample(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 50, seed=7)


def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 parts spread evenly over all of them."""
    return vectors.strided_sample(store.dense_index(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey"), 64)


def position_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each supplier's place in a grid of 17 columns."""
    key = F.col("s_suppkey")
    made = table(spark, sf_dir, "supplier").select(key, grid_position_code(F.floor(key / 17).cast("double"), (key % 17).cast("double"), 16).alias("code"))
    return made.select("s_suppkey", F.posexplode("code").alias("pos", "x")).withColumn("x", F.round("x", 8))


QUERIES = {
    f.__name__: f
    for f in (
        box_restore, box_pairs, box_counts, skewed_box_pairs, skewed_box_counts, knn, knn_join, nearest_code, nearest_code_by_expression, residual_codes, code_vectors, code_usage, usage_metrics, code_sums, ema_update, dead_restart,
        vector_stats, channel_stats, used_code_count, method_mismatches, kmeans_codes, residual_kmeans_error, mean_pooling, hash_sample, strided_sample, position_codes,
    )
}

_D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
CODED_SQL = f"""book AS (
  SELECT CAST(vec_id // 64 AS INTEGER) AS level, vec_id % 64 AS code, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id < 128
), near0 AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, min((d, code)) AS b FROM (SELECT e.vec_id, e.embedding, b.code, {_D2.format("e.embedding", "b.vec")} AS d FROM embeddings e, book b WHERE b.level = 0) GROUP BY ALL
), rest AS (
  SELECT n.vec_id, list_transform(list_zip(n.v, b.vec), lambda z: z[1] - z[2]) AS v FROM near0 n JOIN book b ON b.level = 0 AND b.code = n.b[2]
), near1 AS (
  SELECT vec_id, min((d, code)) AS b FROM (SELECT r.vec_id, b.code, {_D2.format("r.v", "b.vec")} AS d FROM rest r, book b WHERE b.level = 1) GROUP BY vec_id
), codes AS (
  SELECT vec_id, 0 AS level, b[2] AS code, b[1] AS d2 FROM near0 UNION ALL SELECT vec_id, 1, b[2], b[1] FROM near1
), uses AS (
  SELECT l AS level, c AS code, count(k.code) AS uses FROM range(2) a(l), range(64) r(c) LEFT JOIN codes k ON k.level = l AND k.code = c GROUP BY l, c
)"""
_EACH = "SELECT {0}, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"

ORACLE_SQL = {
    "box_restore": f"WITH {BOXES_SQL} SELECT * FROM library",
    "box_pairs": f"WITH {BOXES_SQL} SELECT qid, lid FROM grid q, library l WHERE q.x0 < l.x1 AND q.x1 > l.x0 AND q.y0 < l.y1 AND q.y1 > l.y0",
    "box_counts": f"WITH {BOXES_SQL} SELECT qid, count(lid) AS hits FROM grid q LEFT JOIN library l ON q.x0 < l.x1 AND q.x1 > l.x0 AND q.y0 < l.y1 AND q.y1 > l.y0 GROUP BY qid",
    "knn": f"""SELECT qid, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, neighbour) AS rank
        FROM (SELECT q.vec_id AS qid, e.vec_id AS neighbour, {_D2.format("q.embedding", "e.embedding")} AS d FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
    "skewed_box_pairs": f"WITH {SKEWED_SQL} SELECT q.lid AS qid, l.lid FROM skewed q, skewed l WHERE q.lid % 100 = 0 AND q.x0 < l.x1 AND q.x1 > l.x0 AND q.y0 < l.y1 AND q.y1 > l.y0",
    "skewed_box_counts": f"WITH {SKEWED_SQL} SELECT q.lid AS qid, count(l.lid) AS hits FROM skewed q LEFT JOIN skewed l ON q.x0 < l.x1 AND q.x1 > l.x0 AND q.y0 < l.y1 AND q.y1 > l.y0 WHERE q.lid % 100 = 0 GROUP BY q.lid",
    "nearest_code": f"WITH {CODED_SQL} SELECT vec_id, code, round(d2, 6) AS d2 FROM codes WHERE level = 0",
    "nearest_code_by_expression": f"WITH {CODED_SQL} SELECT vec_id, code, round(d2, 6) AS d2 FROM codes WHERE level = 0",
    "residual_codes": f"WITH {CODED_SQL} SELECT vec_id, level, code FROM codes",
    "code_vectors": f"""WITH {CODED_SQL} SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(sum(x), 6) AS x FROM
        (SELECT vec_id, unnest(range(64)) AS pos, unnest(vec) AS x FROM codes JOIN book USING (level, code)) GROUP BY vec_id, pos""",
    "code_usage": f"WITH {CODED_SQL} SELECT level, code, uses FROM uses",
    "usage_metrics": f"""WITH {CODED_SQL}, shares AS (SELECT *, uses / sum(uses) OVER (PARTITION BY level) AS p, row_number() OVER (PARTITION BY level ORDER BY uses DESC, code) AS place FROM uses)
        SELECT level, CAST(sum(uses) AS BIGINT) AS total, count(*) FILTER (WHERE uses > 0) AS active, round(exp(-sum(p * ln(greatest(p, 1e-10)))), 6) AS perplexity,
        round(count(*) FILTER (WHERE uses > 0) / 64.0e0, 6) AS used_share, round(max(p), 6) AS top1_share, round(sum(p) FILTER (WHERE place <= 10), 6) AS topk_share FROM shares GROUP BY level""",
    "code_sums": f"""WITH {CODED_SQL} SELECT code, CAST(pos AS INTEGER) AS pos, round(sum(x), 5) AS total, count(*) AS n FROM
        (SELECT code, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings JOIN codes USING (vec_id) WHERE level = 0) GROUP BY code, pos""",
    "ema_update": f"""WITH {CODED_SQL}, sums AS (SELECT code, pos, sum(x) AS total, count(*) AS n FROM
        (SELECT code, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings JOIN codes USING (vec_id) WHERE level = 0) GROUP BY code, pos
        ), old AS (SELECT code, unnest(range(64)) AS pos, unnest(vec) AS average FROM book WHERE level = 0
        ), moved AS (SELECT o.code, o.pos, 0.99e0 + coalesce(n, 0) * 0.01e0 AS size, average * 0.99e0 + coalesce(total, 0) * 0.01e0 AS average FROM old o LEFT JOIN sums s ON s.code = o.code AND s.pos = o.pos
        ), whole AS (SELECT sum(size) AS t, count(*) AS k FROM moved WHERE pos = 0)
        SELECT code, CAST(pos AS INTEGER) AS pos, round(size, 6) AS size, round(average / ((size + 1e-5) / (t + k * 1e-5) * greatest(t, 1)), 5) AS vec FROM moved, whole""",
    "dead_restart": f"""WITH {CODED_SQL}, dead AS (SELECT code, (row_number() OVER (ORDER BY code) - 1) % 5 AS p FROM uses WHERE level = 0 AND uses < 3
        ), pool AS (SELECT vec_id - 200 AS p, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE vec_id BETWEEN 200 AND 204)
        SELECT b.code, CASE WHEN d.code IS NULL THEN CAST(u.uses AS DOUBLE) ELSE 1 END AS size, d.code IS NOT NULL AS restarted, round(coalesce(pool.first, b.vec[1]), 6) AS first
        FROM book b JOIN uses u ON u.level = 0 AND u.code = b.code LEFT JOIN dead d ON d.code = b.code LEFT JOIN pool ON pool.p = d.p WHERE b.level = 0""",
    "vector_stats": f"""WITH x AS ({_EACH.format("vec_id")}), norms AS (SELECT sqrt(sum(x * x)) AS norm FROM x GROUP BY vec_id)
        SELECT * FROM (SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(max(abs(x)), 6) AS absmax FROM x),
        (SELECT round(min(norm), 6) AS norm_min, round(max(norm), 6) AS norm_max, round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std FROM norms)""",
    "channel_stats": f"SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM ({_EACH.format('vec_id')}) GROUP BY pos",
    "used_code_count": f"WITH {CODED_SQL} SELECT count(*) AS used FROM uses WHERE uses > 0",
    "mean_pooling": f"SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM ({_EACH.format('label')}) GROUP BY label, pos",
    "hash_sample": "SELECT p_partkey FROM part ORDER BY md5(p_partkey || ':7'), p_partkey LIMIT 50",
    "strided_sample": """SELECT p_partkey, g AS global_idx FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS g, count(*) OVER () AS n FROM part)
        WHERE g IN (SELECT i * (SELECT count(*) FROM part) // 64 FROM range(64) r(i))""",
}


def _lloyd_sql(rows: str, mark: str, n_codes: int, rounds: int) -> str:
    """Rounds of nearest codes and their means over rows(vec_id, v), from the first n_codes of them: books <mark>0 to <mark><rounds> of (code, vec). No code is left without a vector here."""
    parts = [f"{mark}0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS code, v AS vec FROM {rows} ORDER BY vec_id LIMIT {n_codes})"]
    for k in range(rounds):
        parts.append(f"{mark}a{k} AS (SELECT vec_id, any_value(v) AS v, min((d, code)) AS b FROM (SELECT vec_id, v, code, {_D2.format('v', 'vec')} AS d FROM {rows}, {mark}{k}) GROUP BY vec_id)")
        parts.append(f"{mark}{k + 1} AS (SELECT code, list(x ORDER BY pos) AS vec FROM (SELECT code, pos, avg(x) AS x FROM (SELECT b[2] AS code, unnest(range(len(v))) AS pos, unnest(v) AS x FROM {mark}a{k}) GROUP BY code, pos) GROUP BY code)")
    return ", ".join(parts)


def _left_sql(rows: str, book: str, name: str) -> str:
    """What rows(vec_id, v) have left after their nearest code, and its squared length: <name>(vec_id, v, d)."""
    return f"""{name}n AS (SELECT vec_id, any_value(v) AS v, min((d, code)) AS b FROM (SELECT vec_id, v, code, {_D2.format('v', 'vec')} AS d FROM {rows}, {book}) GROUP BY vec_id
    ), {name} AS (SELECT vec_id, list_transform(list_zip(n.v, k.vec), lambda z: z[1] - z[2]) AS v, n.b[1] AS d FROM {name}n n JOIN {book} k ON k.code = n.b[2])"""


_ROWS = "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
ORACLE_SQL["kmeans_codes"] = f"WITH {_ROWS}, {_lloyd_sql('vectors', 'k', 16, 2)} SELECT code, CAST(unnest(range(len(vec))) AS INTEGER) AS pos, round(unnest(vec), 5) AS x FROM k2"
ORACLE_SQL["residual_kmeans_error"] = f"""WITH {_ROWS}, {_lloyd_sql('vectors', 'k', 16, 3)}, {_left_sql('vectors', 'k3', 'rest')}, {_lloyd_sql('rest', 'j', 16, 3)}, {_left_sql('rest', 'j3', 'last')}
    SELECT 0 AS level, round(avg(d), 4) AS error FROM rest UNION ALL SELECT 1, round(avg(d), 4) FROM last"""
ORACLE_SQL["position_codes"] = """WITH axes AS (SELECT s_suppkey, k, CASE WHEN k < 8 THEN s_suppkey % 17 ELSE s_suppkey // 17 END AS p, k % 8 AS i FROM supplier, range(16) r(k))
    SELECT s_suppkey, CAST(k AS INTEGER) AS pos, round(CASE WHEN i < 4 THEN sin(p / pow(10000e0, i / 4.0e0)) ELSE cos(p / pow(10000e0, (i - 4) / 4.0e0)) END, 8) AS x FROM axes"""
ORACLE_SQL["knn_join"] = ORACLE_SQL["knn"]
