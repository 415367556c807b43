"""What a task holds at once stays within bounds, with the same results."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.operators import fourier, pivots, raster, vectors

TRIANGLES = "gid long, tri_no int, ax double, ay double, bx double, by double, cx double, cy double"


def drawn(seed, polygons, most=6):
    rng = np.random.default_rng(seed)
    rows = [(g, t, *map(float, np.round(rng.random(6) * 2 - 1, 2))) for g in range(polygons) for t in range(int(rng.integers(1, most)))]
    return rows + [(polygons, 0, 0.0, 0.0, None, 1.0, 1.0, 0.0)]


def sort_key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize(("cells", "block"), [(1_000_000, 65_536), (70, 2)])
def test_spectra_and_rasters_in_slices(spark, monkeypatch, cells, block):
    """Slices within a polygon and blocks of it give what the plain plan gives, null where no triangle is whole."""
    monkeypatch.setattr(fourier.triangle_blocks, "__defaults__", ("gid", block))
    t = spark.createDataFrame(drawn(3, 25), TRIANGLES).repartition(3)
    points = fourier.pixels(spark, 8).withColumns({"x": F.col("x") + 0.013, "y": F.col("y") + 0.007})
    plain = t.crossJoin(points).groupBy("gid", "py", "px").agg(F.max(raster.in_triangle(F.col("x"), F.col("y")).cast("int")).alias("occupied"))
    made = raster.occupied(t, points, most_cells=cells)
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString() or block == 2
    rows = lambda d: sorted(map(tuple, d.select("gid", "py", "px", "occupied").collect()), key=sort_key)
    assert rows(made) == rows(plain)
    grid = fourier.frequency_grid(spark, [0.5, 2.0])
    whole = {r[:3]: r[3:] for r in map(tuple, fourier.spectra(t, grid).collect())}
    sliced = {r[:3]: r[3:] for r in map(tuple, fourier.spectra(t, grid, most_cells=cells, block=block).collect())}
    assert whole.keys() == sliced.keys() and all(np.allclose(whole[k], sliced[k]) for k in whole)


def test_resized_images_of_unequal_sizes(spark):
    cells = [(g, y, x, float((g * 7 + y * 3 + x * 5) % 11)) for g, w in ((1, 2), (2, 3), (3, 5)) for y in range(w) for x in range(w) if (g, y, x) != (3, 4, 4)]
    got = {(r.gid, r.py, r.px): r.value for r in raster.resized(spark.createDataFrame(cells, "gid long, py int, px int, value double"), 4).collect()}
    old = {c[:3]: c[3] for c in cells}
    for g, w in ((1, 2), (2, 3), (3, 5)):
        for py in range(4):
            for px in range(4):
                fy, fx = (max(0.0, min((p + 0.5) * w / 4 - 0.5, w - 1.0)) for p in (py, px))
                y, x = int(fy), int(fx)
                taps = [(old.get((g, min(y + j, w - 1), min(x + i, w - 1))), abs(1 - j - (fy - y)) * abs(1 - i - (fx - x))) for j in (0, 1) for i in (0, 1)]
                want = None if any(v is None for v, _ in taps) else sum(v * a for v, a in taps)
                assert got.pop((g, py, px)) == (want if want is None else pytest.approx(want))
    assert not got


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class Rows:
    """A table whose Python steps run here, one batch at a time."""

    def __init__(self, pdf):
        self.pdf = pdf

    def mapInPandas(self, step, schema):  # noqa: N802
        return sum(len(made) for made in step(iter([self.pdf])))


def test_visits_and_bounds_hold_little(monkeypatch):
    """A batch of 10,000 queries with 512 pivots, all of which they may visit."""
    rng = np.random.default_rng(5)
    points = rng.random((512, 16))
    asked = pd.DataFrame({"q": range(2000), "v": list(rng.random((2000, 16))), "home": 0, "home_ring": 0, "bound": np.inf})
    counted = []
    assert peak_mb(lambda: counted.append(pivots._visits(Rows(asked), points))) < 60
    assert counted == [2000 * 512]
    near = {c: np.sort(rng.random(10)) for c in range(512)}
    assert peak_mb(lambda: pivots._bounded(Rows(asked[["q", "v"]]), points, near, 10)) < 60


def test_nearest_of_many_ties_in_slices(spark, monkeypatch):
    rows = [(n, [float(n % 7), float(n % 3)] if n % 11 else None) for n in range(300)]
    library = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    queries = library.where("vec_id % 10 = 1 and embedding is not null").withColumnRenamed("vec_id", "qid")
    monkeypatch.setattr(vectors, "MOST_CELLS", 100)
    got = sorted((r.qid, r["rank"], r.neighbour) for r in vectors.knn(queries, library, 6).collect())
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    asked = [(n, v) for n, v in rows if n % 10 == 1 and v is not None]
    assert got == sorted((q, i + 1, n) for q, v in asked for i, (_, n) in enumerate(sorted((d(v, w), n) for n, w in rows if w is not None)[:6]))
