"""Box joins of unequal boxes, and nearest neighbours by pivots, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import dominance, pivots, quadtree, vectors

BOX = "id long, x0 double, y0 double, x1 double, y1 double"


def skewed(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x, y = rng.choice([-1, 1]) * rng.random() ** 6 * 1000, rng.random() ** 6 * 1000
        side = rng.choice([0.0, 0.3, 2.0, 64.0, 700.0], p=[0.1, 0.5, 0.3, 0.08, 0.02])
        rows.append((k, float(x), float(y), float(x + side * rng.random()), float(y + side)))
    odd = [(n, None, 0.0, 1.0, 1.0), (n + 1, float("nan"), 0.0, 1.0, 1.0), (n + 2, 0.0, 0.0, math.inf, 1.0), (n + 3, 5.0, 0.0, 1.0, 1.0), (n + 4, -4.0, -4.0, 4.0, 4.0), (n + 5, 4.0, -4.0, 8.0, 4.0)]
    return rows + odd


def overlapping(queries, library):
    fine = lambda r: all(c is not None and math.isfinite(c) for c in r[1:]) and r[1] <= r[3] and r[2] <= r[4]
    return sorted((q[0], b[0]) for q in queries if fine(q) for b in library if fine(b) and q[1] < b[3] and q[3] > b[1] and q[2] < b[4] and q[4] > b[2])


@pytest.mark.parametrize(("most", "sample"), [(4, 20_000), (50, 100), (10**9, 100)])
def test_unequal_boxes(spark, most, sample):
    q, b = skewed(1, 150), skewed(2, 500)
    left, right = spark.createDataFrame(q, BOX).withColumnRenamed("id", "qid"), spark.createDataFrame(b, BOX).withColumnRenamed("id", "lid").repartition(3)
    got = quadtree.box_pairs(left, right, most=most, sample=sample)
    assert sorted(map(tuple, got.collect())) == overlapping(q, b)


def test_full_cells_are_dealt(spark, monkeypatch):
    """Large boxes over a crowd: the crowd's cell is dealt into parts, and the pairs are the same."""
    monkeypatch.setattr(quadtree, "LIBRARY_PART", 20)
    monkeypatch.setattr(quadtree, "QUERY_PART", 8)
    q, b = skewed(5, 120) + [(500, -2000.0, -2000.0, 2000.0, 2000.0)], skewed(6, 400)
    left, right = spark.createDataFrame(q, BOX).withColumnRenamed("id", "qid"), spark.createDataFrame(b, BOX).withColumnRenamed("id", "lid")
    tree = quadtree.quadtree(right, 16)
    assert tree.parts([tree.top, tree.top + 3], 20)[tree.top + 3] == -(-tree.n // 20) and tree.parts([tree.top], 20)[tree.top] > 4
    assert sorted(map(tuple, quadtree.box_pairs(left, right, most=16).collect())) == overlapping(q, b)


def test_box_counts_of_no_boxes(spark):
    q = spark.createDataFrame(skewed(1, 5), BOX).withColumnRenamed("id", "qid")
    none = spark.createDataFrame([], BOX).withColumnRenamed("id", "lid")
    assert {r.hits for r in quadtree.box_counts(q, none).collect()} == {0}
    assert quadtree.box_pairs(q.limit(0), none).count() == 0


def test_points_below():
    rng = np.random.default_rng(7)
    for n, m in ((0, 3), (1, 5), (37, 20), (64, 0), (200, 50)):
        px, py, qx, qy = rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(-1, 11, m), rng.integers(-1, 11, m)
        assert dominance.below(px, py, qx, qy).tolist() == [int(((px < x) & (py < y)).sum()) for x, y in zip(qx, qy, strict=True)]


def test_counts_make_no_pairs(spark, monkeypatch):
    """Slabs with many equal bounds, boxes that touch, and boxes and queries without extent."""
    for name, value in (("IN_SLAB", 20), ("MOST_SLABS", 9)):
        monkeypatch.setattr(dominance, name, value)
    square = lambda k, n: (k, float(k % n), float(k // n % n), float(k % n + k % 3), float(k // n % n + k % 4))
    q, b = skewed(1, 60) + [square(100 + k, 4) for k in range(40)], skewed(2, 300) + [square(400 + k, 5) for k in range(400)] + [(900 + k, 1.0, 1.0, 2.0, 2.0) for k in range(300)]
    left, right = spark.createDataFrame(q, BOX).withColumnRenamed("id", "qid"), spark.createDataFrame(b, BOX).withColumnRenamed("id", "lid").repartition(3)
    pairs = overlapping(q, b)
    made = []
    monkeypatch.setattr(quadtree, "box_pairs", lambda *a, own=quadtree.box_pairs: made.append(a[0].count()) or own(*a))
    got = {r.qid: r.hits for r in quadtree.box_counts(left, right).collect()}
    assert got == {r[0]: sum(p[0] == r[0] for p in pairs) for r in q}
    fine = [r for r in q if all(c is not None and math.isfinite(c) for c in r[1:]) and r[1] <= r[3] and r[2] <= r[4]]
    assert made == [sum(r[1] == r[3] or r[2] == r[4] for r in fine)]


def test_large_boxes_have_few_copies(spark):
    boxes = spark.createDataFrame(skewed(3, 2000), BOX)
    tree = quadtree.quadtree(boxes, 16)
    assert len(tree.divided) > 5
    placed = quadtree.leveled(boxes, tree)
    levels = [r["level"] for r in placed.select("level").distinct().collect()]
    own, further = quadtree.copies(placed, levels)
    assert own.groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    assert further.groupBy("id", "side_level").count().agg(F.max("count")).first()[0] <= 4
    # Small boxes of a crowded place live on fine levels, those of empty places on coarse ones.
    fine = {r.id: r.level for r in placed.where("x1 - x0 < 1 and y1 - y0 < 1").collect()}
    assert max(fine.values()) - min(fine.values()) >= 4


def neighbours(queries, library, k):
    out = []
    for q, v in queries:
        each = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in library if w is not None)[:k]
        out += [(q, i + 1, n) for i, (_, n) in enumerate(each)]
    return sorted(out)


def clustered(seed, n, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, (12, dims)) * 4.0
    return [(k, None if k % 97 == 5 else [1.0] * dims if k % 5 == 0 else [float(x) for x in np.round(centres[k % 12] + rng.normal(size=dims), 2)]) for k in range(n)]


@pytest.mark.parametrize(("ring", "block", "k"), [(16, 4, 3), (200, 1000, 12), (4096, 1024, 5000)])
def test_pivots_find_the_nearest(spark, monkeypatch, ring, block, k):
    monkeypatch.setattr(pivots, "RING", ring)
    monkeypatch.setattr(pivots, "BLOCK", block)
    library = clustered(1, 900)
    queries = [(n, v) for n, v in clustered(2, 60) if v is not None] + [(1000, [500.0] * 6)]
    q, b = spark.createDataFrame(queries, "qid long, embedding array<double>"), spark.createDataFrame(library, "vec_id long, embedding array<double>").repartition(4)
    found, work = pivots.knn_join(q, b, k)
    assert sorted((r.qid, r["rank"], r.neighbour) for r in found.collect()) == neighbours(queries, library, k)
    w = work.first()
    assert (w.n_queries, w.n_vectors) == (len(queries), sum(v is not None for _, v in library)) and w.compared <= w.n_queries * w.n_vectors
    if k == 3:
        assert w.compared < 0.4 * w.n_queries * w.n_vectors


def test_pivots_of_nothing(spark):
    rows = spark.createDataFrame(clustered(1, 20), "vec_id long, embedding array<double>")
    none, asked = rows.limit(0), rows.withColumnRenamed("vec_id", "qid")
    for q, b in ((asked, none), (asked.limit(0), rows)):
        found, work = pivots.knn_join(q, b, 3)
        assert found.count() == 0 and work.first().compared == 0


def test_many_queries_are_joined(spark, monkeypatch):
    rows = clustered(4, 200)
    b = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = b.where("embedding is not null").withColumnRenamed("vec_id", "qid")
    few = sorted((r.qid, r["rank"], r.neighbour) for r in vectors.knn(q, b, 4).collect())
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
    assert sorted((r.qid, r["rank"], r.neighbour) for r in vectors.knn(q, b, 4).collect()) == few
