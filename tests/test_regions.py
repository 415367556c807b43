"""Triangulation, points in polygons, shape keys and image likeness against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import delaunay, geometry, images, shapes
from geoloom.plans import regions

PARTS = geometry.PARTS


def star(rng, n, cx=0.0, cy=0.0, r=1.0, least=0.4):
    a = np.sort(rng.random(n)) * 2 * np.pi
    while np.diff(np.append(a, a[0] + 2 * np.pi)).max() > 3.0:
        a = np.sort(rng.random(n)) * 2 * np.pi
    q = r * (least + (1 - least) * rng.random(n))
    return np.column_stack([cx + q * np.cos(a), cy + q * np.sin(a)])


def in_ring(p, ring):
    inside = False
    for (x0, y0), (x1, y1) in zip(np.roll(ring, 1, 0), ring, strict=True):
        if (y0 > p[1]) != (y1 > p[1]) and p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0:
            inside = not inside
    return inside


def holed(rng, n):
    """A star with small stars in it, those that lie in it and apart."""
    shell = star(rng, n)
    holes = [star(rng, int(rng.integers(3, 9)), cx, cy, 0.07) for cx, cy in ((-0.12, 0.12), (0.12, 0.12), (0.0, -0.15))[: int(rng.integers(0, 4))]]
    return [shell, *[h for h in holes if in_ring(h[0], shell) and not geometry.part_fault([shell, h])]]


def assert_delaunay(rings):
    triangles = delaunay.triangulated(rings)
    points = lambda r: [tuple(map(float, p)) for p in r]
    border = {frozenset(e) for r in rings for e in zip(points(r), points(np.roll(r, -1, 0)), strict=True)}
    sides = {}
    for t in map(points, triangles):
        assert delaunay.turn(*t) == 1
        for k in range(3):
            sides.setdefault(frozenset((t[k], t[k - 2])), []).append((t, t[k - 1]))
    for edge, met in sides.items():
        assert len(met) == (1 if edge in border else 2)
        if edge not in border:
            (t, _), (_, far) = met
            assert delaunay.in_circle(*t, far) <= 0
    area = abs(geometry._signed_area(rings[0])) - sum(abs(geometry._signed_area(h)) for h in rings[1:])
    u, v = triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0]
    assert (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2 == pytest.approx(area)
    assert len(triangles) == sum(map(len, rings)) + 2 * len(rings) - 4
    return triangles


def test_delaunay_of_chance_polygons():
    rng = np.random.default_rng(7)
    for _ in range(400):
        assert_delaunay(holed(rng, int(rng.integers(5, 40))))


def test_delaunay_of_points_on_lines_and_circles():
    square = np.array([[0, 0], [1, 0], [2, 0], [3, 0], [3, 1], [3, 3], [2, 3], [0, 3], [0, 2]], float)
    hole = np.array([[1, 1], [1, 2], [2, 2], [2, 1]], float)
    assert_delaunay([square])
    assert_delaunay([square, hole])
    a = 2 * np.pi * np.arange(60) / 60
    circle = np.column_stack([np.cos(a), np.sin(a)])
    assert_delaunay([circle, circle[::-1] * 0.5])
    comb = np.array([(x, y) for k in range(20) for x, y in ((k, 0), (k + 0.5, 5))] + [(20, 0), (20, -1), (0, -1)], float)
    assert_delaunay([comb])


def test_long_rings_take_little_time():
    rng = np.random.default_rng(1)
    ring = star(rng, 20_000, least=0.9)
    assert not geometry._self_crossing(ring)
    assert len(delaunay.triangulated([ring])) == 19_998


def test_touching_rings_raise():
    shell = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    bow = np.array([[0, 0], [2, 2], [4, 0], [4, 4], [2, 2], [0, 4]], float)
    for rings in ([shell, np.array([[5, 5], [6, 5], [6, 6]], float)], [bow]):
        with pytest.raises(ValueError):
            geometry.triangles_of(rings)


def test_what_the_sweep_does_not_take_is_cut_into_ears(monkeypatch):
    rng = np.random.default_rng(2)
    rings = holed(rng, 20)
    want = geometry.triangles_of(rings)

    def refuse(rings):
        raise ValueError("no")

    monkeypatch.setattr(geometry, "triangulated", refuse)
    assert len(geometry.triangles_of(rings)) == len(want)


def test_crossings_equal_square_scans():
    rng = np.random.default_rng(3)
    side = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def crosses(ring):
        n = len(ring)
        e = [(ring[i], ring[(i + 1) % n]) for i in range(n)]
        return any(side(*e[i], p) * side(*e[i], q) < 0 and side(p, q, e[i][0]) * side(p, q, e[i][1]) < 0 for i in range(n) for p, q in e[i + 2 :])

    for k in range(400):
        ring = rng.random((rng.integers(3, 9), 2))
        ring = np.round(ring * 4) if k % 2 else ring
        assert geometry._self_crossing(ring) == crosses(ring)


def as_parts(rings):
    return [[[(float(x), float(y)) for x, y in r] for r in rings]]


def test_points_in_polygons(spark):
    rng = np.random.default_rng(5)
    rows = [(k, as_parts([r * 3 + [k % 4, k // 4] for r in holed(rng, int(rng.integers(5, 60)))])) for k in range(12)] + [(50, []), (51, None)]
    spots = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((400, 2)) * 8 - 2)] + [(900, None, 1.0), (901, math.inf, 1.0), (902, math.nan, 0.0)]
    polygons, points = spark.createDataFrame(rows, f"gid long, parts {PARTS}"), spark.createDataFrame(spots, "pid long, x double, y double")
    got = {tuple(r) for r in shapes.points_in_polygons(points, polygons).collect()}
    want = {(p, g) for p, x, y in spots[:400] for g, parts in rows[:12] if sum(in_ring((x, y), np.array(r)) for r in parts[0]) % 2}
    assert got == want and len(want) > 100
    assert shapes.points_in_polygons(points, polygons.limit(0)).count() == 0


def test_centroids(spark):
    rng = np.random.default_rng(6)
    rows = [(k, as_parts(holed(rng, 30))) for k in range(6)]
    polygons = spark.createDataFrame(rows, f"gid long, parts {PARTS}")
    t = geometry.triangulate(polygons).where("error is null")
    assert shapes.centroids_inside(t, polygons).count() == t.count()
    moved = t.withColumns({c: F.col(c) + 5 for c in ("ax", "bx", "cx")})
    assert shapes.centroids_inside(moved, polygons).count() == 0


def test_shapes_as_bytes(spark):
    a = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    h1, h2 = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)], [(3.0, 3.0), (3.0, 3.5), (3.5, 3.5)]
    b = [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)]
    turned = lambda r: [*r[2:], *r[:2]][::-1]
    rows = [(1, [[a, h1, h2], [b]]), (2, [[turned(b)], [turned(a), turned(h2), turned(h1)]]), (3, [[[*a, a[0]], h1, h2], [b]]), (4, [[a, h1], [b]]), (5, None), (6, []), (7, [[[(-0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]]]), (8, [[[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]]])]
    df = spark.createDataFrame(rows, f"gid long, parts {PARTS}")
    assert {(r.gid, r.copies) for r in shapes.distinct_shapes(df).collect()} == {(1, 3), (4, 1), (5, 1), (6, 1), (7, 2)}
    back = df.select("gid", "parts", shapes.from_wkb(shapes.to_wkb(F.col("parts"))).alias("again")).collect()
    for r in back:
        if r.gid not in (3, 6):
            assert r.again == r.parts
    one = bytes(df.where("gid = 8").select(shapes.to_wkb(F.col("parts"))).first()[0])
    assert one.hex() == "0106000000010000000103000000010000000400000000000000000000000000000000000000000000000000f03f00000000000000000000000000000000000000000000f03f00000000000000000000000000000000"
    odd = spark.createDataFrame([(bytearray(one[:40]),), (bytearray(b""),), (bytearray(b"\x01\x01\x00\x00\x00" + bytes(16)),), (None,)], "w binary")
    assert [r[0] for r in odd.select(shapes.from_wkb(F.col("w"))).collect()] == [None] * 4


def likeness(x, y, weights):
    n, out = len(weights), []
    for i in range(x.shape[0] - n + 1):
        for j in range(x.shape[1] - n + 1):
            w = np.outer(weights, weights)
            p, q = x[i : i + n, j : j + n], y[i : i + n, j : j + n]
            mp, mq = (w * p).sum(), (w * q).sum()
            vp, vq, c = (w * p * p).sum() - mp * mp, (w * q * q).sum() - mq * mq, (w * p * q).sum() - mp * mq
            out.append((2 * mp * mq + 1e-4) * (2 * c + 9e-4) / ((mp * mp + mq * mq + 1e-4) * (vp + vq + 9e-4)))
    return float(np.mean(out))


def test_structural_losses(spark):
    rng = np.random.default_rng(8)
    sizes = [(16, 16), (12, 20), (16, 16), (8, 30)]
    made = [(rng.random(s), rng.random(s)) for s in sizes]
    cells = [(k, i, j, float(x[i, j]), float(y[i, j])) for k, (x, y) in enumerate(made) for i in range(x.shape[0]) for j in range(x.shape[1])]
    odd = [(10, 0, 0, 1.0, 1.0), (10, 0, 2, 1.0, 1.0), (11, 0, 0, None, 1.0), (12, 0, 0, 1.0, 1.0), (12, 0, 0, 1.0, 1.0), (13, -1, 0, 1.0, 1.0), (13, 0, 0, 1.0, 1.0)]
    df = spark.createDataFrame(cells + odd, "k long, py int, px int, p double, t double").repartition(5)
    arrays = images.image_arrays(df, "k", ["p", "t"])
    assert {(r.k, r.height, r.width) for r in arrays.collect()} == {(k, *s) for k, s in enumerate(sizes)}
    taps = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    for window, sigma, weights in ((11, 1.5, taps / taps.sum()), (7, None, np.full(7, 1 / 7))):
        for r in images.structural_losses(arrays, "k", "p", "t", window, sigma).collect():
            x, y = made[r.k]
            assert (r.ssim_loss is None) == (min(x.shape) < window)
            if r.ssim_loss is not None:
                assert r.ssim_loss == pytest.approx(1 - likeness(x, y, weights), abs=1e-9)
            assert r.spectral_loss == pytest.approx(np.abs(np.fft.rfft2(x) - np.fft.rfft2(y)).mean())
    same = images.structural_losses(arrays, "k", "p", "p").where("ssim_loss is not null").collect()
    assert all(abs(r.ssim_loss) < 1e-12 and r.spectral_loss == 0 for r in same)


def test_pairs_of_many_blocks(spark, monkeypatch):
    """Every cell of several blocks, points on borders and one above another included."""
    for name, most in (("POINTS", 16), ("EDGES", 8), ("SAMPLE", 300)):
        monkeypatch.setattr(shapes, name, most)
    square = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + a), (x, y + a)]
    rows = [(k, [[square(k % 3 + 0.0, k % 4 + 0.0, 2.0), square(k % 3 + 0.5, k % 4 + 0.5, 1.0)], [square(k % 3 + 5.0, k % 4 + 0.0, 1.0)]]) for k in range(60)]
    spots = [(k, (k * 7 % 40) / 4, (k * 11 % 24) / 4) for k in range(500)] + [(1000 + k, 1.25, 1.25) for k in range(100)]
    polygons, points = spark.createDataFrame(rows, f"gid long, parts {PARTS}"), spark.createDataFrame(spots, "pid long, x double, y double")
    got = [tuple(r) for r in shapes.points_in_polygons(points, polygons).collect()]
    want = {(p, g) for p, x, y in spots for g, parts in rows if sum(in_ring((x, y), np.array(r)) for part in parts for r in part) % 2}
    assert len(got) == len(want) and set(got) == want
    assert any(p < 500 and spots[p][1] == g % 3 for p, g in want)


def test_equal_polygons_of_two_suppliers(spark, tmp_path):
    """Suppliers 1 and 18565 have the same polygon; each keeps its own row, as the SQL has it."""
    spark.createDataFrame([(1, 4), (2, 4), (18565, 4), (18567, 9)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = regions.distinct_shapes(spark, str(tmp_path)).select("gid", "copies", "bytes").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(regions.ORACLE_SQL["distinct_shapes"]).fetchall())
