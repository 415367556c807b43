"""Checks of records, manifests, reports, and plans that reach the files."""

import io
import json
import math
import unicodedata
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions.columns import grid_position_code
from geoloom.operators import checks, fourier, geometry, metrics, raster, shards, store, vectors
from geoloom.plans import attributes


def test_triangle_faults(spark):
    good = [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    rows = [(1, [good, good]), (2, None), (3, []), (4, [good, good[:5]]), (5, [[*good[:5], math.nan]]), (6, [[*good[:5], None]]), (7, [good, None]), (8, [[math.inf, *good[:5]]])]
    found = checks.triangle_faults(spark.createDataFrame(rows, "gid long, triangles array<array<double>>"))
    assert {tuple(r) for r in found.collect()} == {(2, "missing"), (3, "empty"), (4, "width"), (5, "not finite"), (6, "not finite"), (7, "width"), (8, "not finite")}


def test_index_faults(spark):
    grid, meta = [[[1, 2], [3, 65535]], [[0, 0], [0, 0]]], [1.0] * 6
    rows = [(1, grid, meta), (None, grid, meta), (3, None, meta), (4, [], meta), (5, [[[1, 2], [3]]], meta), (6, [[[1, 2]], [[1, 2], [3, 4]]], meta), (7, [[[65536]]], meta), (8, [[[-1]]], meta), (9, grid, meta[:5]), (10, grid, None), (11, [[[None]]], meta), (12, [None], meta), (13, [[None]], meta)]
    found = checks.index_faults(spark.createDataFrame(rows, "gid long, indices array<array<array<int>>>, meta array<double>"))
    assert {tuple(r) for r in found.collect()} == {(None, "gid"), (3, "indices"), (4, "indices"), (5, "ragged"), (6, "ragged"), (7, "range"), (8, "range"), (9, "meta"), (10, "meta"), (11, "range"), (12, "ragged"), (13, "ragged")}
    flat = spark.createDataFrame([([0, 65535],), ([],), (None,)], "i array<int>")
    assert flat.select(checks.guarded_indices(F.col("i"))).count() == 3
    with pytest.raises(Exception, match="-3 to 70000"):
        spark.createDataFrame([([-3, 70000],)], "i array<int>").select(checks.guarded_indices(F.col("i"))).collect()


def test_alignment(spark):
    t = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k long")
    assert checks.alignment_faults({"tri": t(1, 2, 2), "meta": t(2, 1, 2), "gid": t(2, 2, 1)}, "k").count() == 0
    found = checks.alignment_faults({"tri": t(1, 2, None), "meta": t(2, 3), "gid": t(2, 3, 3)}, "k").collect()
    assert {tuple(r) for r in found} == {(1, 1, 0, 0), (3, 0, 1, 2), (None, 1, 0, 0)}


def test_task_manifest(spark, tmp_path):
    files = spark.createDataFrame([("a", 3, 10), ("b", 4, 20)], "path string, samples long, bytes long")
    made = checks.task_manifest(files, str(tmp_path), "run", {"model": "m1", "source": "s"}).first()
    assert (made.num_shards, made.total_samples, made.total_bytes, made.metadata) == (2, 7, 30, {"model": "m1", "source": "s"})
    lines = [json.loads(x) for p in (tmp_path / "run" / "shards").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(x["path"] for x in lines) == ["a", "b"]
    with pytest.raises(Exception, match="(?i)exists"):
        checks.task_manifest(files, str(tmp_path), "run", {})


def test_number_order_and_widths(spark):
    names = ["x/chunk_10.pt", "x/chunk_9.pt", "y2/chunk_100.pt", "x/other", "x/chunk_" + "9" * 30]
    ordered = checks.in_number_order(spark.createDataFrame([(n,) for n in names], "path string"))
    assert [r.path for r in ordered.collect()] == [names[1], names[0], names[2], names[4], names[3]]
    texts = ["plain", "东京 tower", "ｆｕｌｌ", "a\r\nb", "", None, "naïve é", "ｶﾅ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", checks.display_width(F.col("t")).alias("w"), checks.padded(F.col("t"), 9).alias("p")).collect()
    for r in rows:
        plain = (r.t or "").replace("\r", "").replace("\n", "")
        width = sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in plain)
        assert r.w == width and r.p == plain + " " * max(0, 9 - width)


def test_grid_position_codes(spark):
    d, w = 16, 5
    rows = spark.range(20).select("id", grid_position_code(F.floor(F.col("id") / w).cast("double"), (F.col("id") % w).cast("double"), d).alias("c")).collect()
    omega = 1 / 10000 ** (np.arange(d // 4) / (d / 4))
    one = lambda p: np.concatenate([np.sin(p * omega), np.cos(p * omega)])
    for r in rows:
        assert np.allclose(r.c, np.concatenate([one(r.id % w), one(r.id // w)]))
    with pytest.raises(ValueError, match="multiple of four"):
        grid_position_code(F.lit(1.0), F.lit(1.0), 6)


def test_jitter_is_normal(spark):
    t = spark.createDataFrame([(k, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for k in range(40)], "gid long, tri_no int, ax double, ay double, bx double, by double, cx double, cy double")
    xs = np.array([r.x for r in raster.sampled_points(t, 100, 0, spread=0.1).collect()]) / 0.1
    assert abs(xs.mean()) < 0.06 and abs(xs.std() - 1) < 0.04 and abs((np.abs(xs) < 1).mean() - 0.6827) < 0.03 and (np.abs(xs) > 2.5).any()


def test_exports_name_indices_and_ids(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") * 3).alias("global_idx"), (F.col("id") + 1000).alias("gid"))
    store.export_matches(rows, str(tmp_path / "e"), gid="gid")
    meta = spark.read.parquet(str(tmp_path / "e" / "meta")).first()
    assert (meta.match_count, meta.first_index, meta.last_index) == (50, 0, 147) and meta.timestamp is not None
    listed = sorted((r["index"], r.gid) for r in spark.read.json(str(tmp_path / "e" / "indices")).collect())
    assert listed == [(3 * k, 1000 + k) for k in range(50)]


def test_different_tables_are_concatenated(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, t string"), spark.createDataFrame([(2, 0.5)], "k long, v double")
    assert sorted(map(tuple, store.concatenated([a, b]).collect())) == [(1, "x", None), (2, None, 0.5)]


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_funnel_filters_reach_the_files(spark, sf_dir):
    assert "GreaterThan(l_extendedprice,20000.0)" in plan_of(attributes.funnel_counts(spark, sf_dir))


def test_manifest_needs_no_window_over_all_shards(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 500).alias("s"), F.lit(5).alias("b"))
    made = shards.manifest(rows, "s", "b")
    got = sorted(map(tuple, made.collect()))
    start = 0
    for shard, samples, bytes_, first in got:
        assert first == start and bytes_ == 5 * samples
        start += samples
    assert len(got) == 500
    many = store.running(spark.range(1000).select((F.col("id") % 3).alias("k")), ["k"], None, 7)
    assert sorted(r["__before"] for r in many.collect()) == list(range(1000))


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_of_triangles_are_summed_up(spark, block):
    rng = np.random.default_rng(1)
    rows = [(g, k, *map(float, rng.random(6))) for g in range(5) for k in range(g * 3 + 1)]
    t = spark.createDataFrame(rows, "gid long, tri_no int, ax double, ay double, bx double, by double, cx double, cy double").repartition(3)
    grid = fourier.frequency_grid(spark, fourier.frequencies(0.3, 2.0, 3))
    whole = {(r.gid, r.u_idx, r.v_idx): (r.re, r.im) for r in fourier.spectra(t, grid).collect()}
    parts = {(r.gid, r.u_idx, r.v_idx): (r.re, r.im) for r in fourier.spectra(t, grid, most_cells=60, block=block).collect()}
    assert set(whole) == set(parts) and all(np.allclose(whole[k], parts[k]) for k in whole)


def test_large_codebooks_are_joined(spark, monkeypatch):
    book = spark.createDataFrame([(lv, c, [float(lv), float(c)]) for lv in (0, 1) for c in range(5)], "level int, code long, vec array<double>")
    codes = spark.createDataFrame([(1, 0, 2), (1, 1, 4), (2, 0, 9), (2, 1, 1), (3, 0, 8)], "vec_id long, level int, code long")
    small = sorted((r.vec_id, r.embedding) for r in vectors.decode(codes, book).collect())
    monkeypatch.setattr(vectors, "MOST_CODES", 3)
    large = sorted((r.vec_id, r.embedding) for r in vectors.decode(codes, book).collect())
    assert small == large == [(1, [1.0, 6.0]), (2, [1.0, 1.0])]


def test_failures_are_logged(spark, tmp_path):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    square, flat = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((0, 0), (1, 1), (2, 2))
    bow = ring((0, 0), (2, 2), (2, 0), (0, 2))
    rows = spark.createDataFrame([(1, [[square]]), (2, [[flat]]), (3, [[bow], [flat]]), (4, [])], f"gid long, parts {geometry.PARTS}")
    records = checks.failure_records(rows, geometry.triangulate(rows), "layer")
    assert {(r.gid, r.geom_type, r.parts, r.points) for r in records.collect()} == {(2, "Polygon", 1, 3), (3, "MultiPolygon", 2, 7), (4, "MultiPolygon", 0, 0)}
    assert all(r.error for r in records.collect()) and checks.write_failures(records, str(tmp_path / "log")) == 3


def test_restarts_are_reported(spark):
    rows = spark.createDataFrame([("a", k, 50, 0.1, int(k == 2)) for k in range(1, 4)], "s string, step long, active long, share double, restarted long")
    made = metrics.alerts(rows, "s", "step", "active", "share", 100, 5, 90, 0.98, "restarted").orderBy("step").collect()
    assert [r.reasons for r in made] == ["", "restart", ""]
