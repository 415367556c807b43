"""Operators against brute force, goldens and odd inputs."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions.columns import from_limbs, limbs, ramp
from geoloom.operators import fourier, geometry, metrics, raster, shards, spatial, store, vectors
from geoloom.operators.store import Layer, Request, Store
from geoloom.plans import attributes, series, shapes, tables
from geoloom.plans.tables import polygons, triangles
from geoloom.sources import files
from geoloom.streaming.guard import guard_stream, ingest


@pytest.mark.parametrize("x", [0.0, -0.29, 0.29, 68423.46, 16777217.0, 123456789.123, 1e12 + 0.5, float("nan"), None])
def test_limbs_come_back(spark, x):
    got = spark.createDataFrame([(x,)], "x double").select(from_limbs(limbs(F.col("x"))).alias("b")).first().b
    assert got == pytest.approx(0.0 if x is None or math.isnan(x) else x, abs=1e-6)


def test_unknown_comparison_is_refused():
    with pytest.raises(ValueError, match="unknown operator"):
        Request({}, [("amount", "!=", 1.0)])


def test_fields_match_in_any_case_and_nulls_count_as_zero(spark):
    rows = spark.createDataFrame([(1, 5.0, " F "), (2, None, "O"), (3, float("nan"), None)], "gid long, Amount double, Status string")
    s = Store([Layer("one", rows, "gid"), Layer("other", rows.drop("Status"), "gid")])
    assert {r.gid for r in s.query(Request({}, [("amount", "<=", 0.0)])).where("layer = 'one'").collect()} == {2, 3}
    assert [r.gid for r in s.query(Request({"STATUS": ["F"]}, [("AMOUNT", "==", 5.0)])).collect()] == [1]
    with pytest.raises(LookupError):
        s.query(Request({"colour": ["red"]}))


def test_fetch_keeps_order_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "gid long, v string")
    wanted = spark.createDataFrame([(0, 2), (1, 9), (2, 1), (3, 2)], "pos long, gid long")
    assert [(r.pos, r.v) for r in store.fetch(rows, wanted).orderBy("pos").collect()] == [(0, "b"), (2, "a"), (3, "b")]


def test_dense_index_has_no_gaps(spark):
    keys = spark.range(5000).select((F.col("id") * 7919 % 100_003).alias("k"))
    got = [(r.k, r.global_idx) for r in store.dense_index(keys, "k").orderBy("k").collect()]
    assert [g for _, g in got] == list(range(5000))
    assert store.dense_index(keys.limit(0), "k").count() == 0


def test_exports(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", " ")], "n int, t string, blank string")
    groups = store.export_groups(Store([Layer("a", a), Layer("b", a), Layer("c", a.drop("t"))]), str(tmp_path / "csv"))
    assert groups == {("n", "t"): ["a", "b"], ("n",): ["c"]}
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/group=1")).count() == 2
    store.export_matches(spark.range(100).withColumnRenamed("id", "global_idx"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/meta")).first().match_count == 100


def test_box_join_equals_nested_loops(spark):
    rng = np.random.default_rng(2)
    boxes = [(i, *map(float, np.sort(rng.random((2, 2)) * 20 - 10, axis=0).ravel())) for i in range(80)]
    boxes += [(80, 0.0, 0.0, 0.0, 0.0), (81, 2.5, 2.5, 5.0, 5.0), (82, None, 0.0, 1.0, 1.0), (83, 3.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "lid long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.qid, r.lid) for r in spatial.box_pairs(df.withColumnRenamed("lid", "qid"), df, 2.5).collect())
    proper = [b for b in boxes if None not in b and b[1] <= b[3]]
    assert got == sorted((q[0], b[0]) for q in proper for b in proper if q[1] < b[3] and q[3] > b[1] and q[2] < b[4] and q[4] > b[2])


def test_knn_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (300, 6)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    got = {}
    for r in vectors.knn(df.where("vec_id < 20").withColumnRenamed("vec_id", "qid"), df, 5).collect():
        got.setdefault(r.qid, {})[r.rank] = r.neighbour
    for q in range(20):
        d = ((x - x[q]) ** 2).sum(axis=1)
        assert [got[q][k] for k in range(1, 6)] == sorted(range(300), key=lambda i: (d[i], i))[:5]
    assert vectors.knn(df.limit(0).withColumnRenamed("vec_id", "qid"), df, 5).count() == 0


def test_kmeans_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.random((200, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    c = x[:5].copy()
    for _ in range(3):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.stack([x[near == k].mean(0) for k in range(5)])
    got = np.array([r.vec for r in vectors.kmeans(df, 5, 3).orderBy("code").collect()])
    assert np.allclose(got, c)


def test_residual_levels_lessen_the_error(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    book = vectors.residual_kmeans(df, 2, 8, 2)
    error = {r.level: r.e for r in vectors.encode(df, book).groupBy("level").agg(F.avg("d2").alias("e")).collect()}
    assert error[1] < error[0]
    with pytest.raises(ValueError, match="codes"):
        vectors.encode(df, spark.range(70_000).select(F.lit(0).alias("level"), F.col("id").alias("code"), F.array(F.lit(1.0)).alias("vec")))


def test_empty_code_takes_a_far_vector(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [5.0]), (3, [9.0])], "vec_id long, embedding array<double>")
    got = sorted(r.vec[0] for r in vectors.kmeans(df, 2, 1).collect())
    assert len(set(got)) == 2 and 9.0 in got


def test_perplexity_lies_between_one_and_all(spark):
    even = spark.range(64).select(F.lit(0).alias("level"), (F.col("id") % 16).alias("code"))
    m = vectors.usage_metrics(vectors.usage(even, 16)).first()
    assert m.perplexity == pytest.approx(16) and m.active == 16
    one = vectors.usage_metrics(vectors.usage(even.withColumn("code", F.lit(3).cast("long")), 16)).first()
    assert one.perplexity == pytest.approx(1) and one.active == 1


def test_transform_at_zero_is_the_area_and_ignores_the_cut(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    cuts = {1: [(0, 1, 2), (0, 2, 3)], 2: [(0, 1, 3), (1, 2, 3)]}
    rows = [(g, k, *square[a], *square[b], *square[c]) for g, t in cuts.items() for k, (a, b, c) in enumerate(t)]
    df = spark.createDataFrame(rows, "gid int, tri_no int, ax double, ay double, bx double, by double, cx double, cy double")
    grid = fourier.frequency_grid(spark, fourier.frequencies(0.3, 2.7, 4))
    got = {}
    for r in fourier.spectra(df, grid).join(grid, ["u_idx", "v_idx"]).collect():
        got.setdefault((round(r.u, 6), round(r.v, 6)), {})[r.gid] = complex(r.re, r.im)
    assert abs(got[(0.0, 0.0)][1] - 1) < 1e-9
    for z in got.values():
        assert abs(z[1] - z[2]) < 1e-9


def test_triangulation_covers_holes_and_says_why_not(spark):
    ring = lambda *p: [dict(x=float(a), y=float(b)) for a, b in p]
    shell, hole = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2))
    bow, meets = ring((0, 0), (2, 2), (2, 0), (0, 3)), ring((3, 3), (5, 3), (5, 5), (3, 5))
    star = ring((0, 0), (2, 1), (4, 0), (3, 2), (4, 4), (2, 3), (0, 4), (1, 2))
    rows = [(1, [[shell, hole]]), (2, [[bow]]), (3, [[shell, meets]]), (4, None), (5, []), (6, [[star], [shell]])]
    made = geometry.triangulate(spark.createDataFrame(rows, f"gid long, parts {geometry.PARTS}"))
    area = {r.gid: r.a for r in made.where("error is null").groupBy("gid").agg(F.sum(geometry.triangle_area()).alias("a")).collect()}
    assert area[1] == pytest.approx(15) and area[6] == pytest.approx(16 + 8)
    assert {r.gid: r.error for r in geometry.failures(made).collect()} == {2: "invalid", 3: "touching", 4: "empty", 5: "empty"}


def test_triangles_of_all_polygons_keep_their_area(spark, sf_dir):
    shapes = polygons(spark, sf_dir)
    made = geometry.triangulate(shapes).groupBy("gid").agg(F.sum(geometry.triangle_area()).alias("a"))
    for r in shapes.select("gid", geometry.polygon_area(F.col("parts")).alias("w")).join(made, "gid").collect():
        assert r.a == pytest.approx(r.w)


def test_raster_shows_the_polygon(spark, sf_dir):
    tris = triangles(spark, sf_dir).where("gid < 4")
    grid = fourier.frequency_grid(spark, fourier.frequencies(0.5, 4.0, 8, geometric=False))
    image = fourier.rasters(fourier.spectra(tris, grid), grid, 24)
    truth = raster.occupied(tris, fourier.pixels(spark, 24))
    for r in raster.iou(image.join(truth, ["gid", "py", "px"]), "gid", "value", "occupied").collect():
        assert r.iou > 0.5


def test_masked_loss_goldens(spark):
    c = "mask boolean, weight double, pred_mag double, true_mag double, pred_cos double, true_cos double, pred_sin double, true_sin double"
    hidden = spark.createDataFrame([(False, 1.0, 100.0, 0.0, 100.0, 0.0, 100.0, 0.0), (True, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], c)
    assert tuple(raster.masked_losses(hidden, 0.0).first()) == (0.0, 0.0)
    two = spark.createDataFrame([(True, 1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0), (True, 1.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0), (False, 1.0, 9.0, 0.0, 1.0, 0.0, 0.0, 0.0)], c)
    assert tuple(raster.masked_losses(two, 0.0).first()) == (3.0, 0.0)


def test_ramp_goldens(spark):
    got = [r.b for r in spark.createDataFrame([(e,) for e in (0.0, 10.0, 12.0, 15.0, 30.0)], "e double").select(ramp(F.col("e"), 0.25, 10, 5).alias("b")).collect()]
    assert got == pytest.approx([0, 0, 0.1, 0.25, 0.25])


def _series(spark):
    mags = [1.0] * 6 + [9.0, 9.0, 1.0, 9.0, 9.0, 9.0, 9.0] + [1.0] * 3
    return spark.createDataFrame([(s, i, m, 1.0) for s in ("a", "b") for i, m in enumerate(mags)], "series string, step long, mag double, phase double")


def test_guard_counts_bad_steps_in_a_row(spark):
    rows = metrics.guarded(_series(spark), steps=5, patience=3).where("series = 'a'").orderBy("step").collect()
    assert [r.bad_steps for r in rows] == [0] * 6 + [1, 2, 0, 1, 2, 3, 4, 0, 0, 0]
    assert [r.step for r in rows if r.triggered] == [11, 12]


def test_guard_stream_equals_the_batch(spark, tmp_path):
    whole = _series(spark)
    whole.where("step < 8").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = lambda: (
        guard_stream(spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in")), 5, patience=3)
        .writeStream.foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query().awaitTermination(120)
    whole.where("step >= 8").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query().awaitTermination(120)
    assert sorted(seen) == sorted(tuple(r) for r in metrics.guarded(whole, steps=5, patience=3).select("series", "step", "reasons", "bad_steps", "triggered").collect())


def test_ingest_takes_each_file_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_packing_and_ranks(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate((5, 5, 1, 20, 3))] + [("b", 0, 4)], "g string, i long, s long")
    got = {(r.group, r["at"]): r.shard for r in shards.packed(rows, "g", "i", "s", 10).collect()}
    assert [got["a", i] for i in range(5)] == [0, 0, 1, 2, 3] and got["b", 0] == 0
    for r in shards.rank_of(spark.range(50), "id", 7).collect():
        assert r["rank"] == struct.unpack("<Q", hashlib.blake2b(str(r.id).encode(), digest_size=8).digest())[0] % 7


def test_written_shards_have_a_manifest(spark, tmp_path):
    rows = shards.hash_split(spark.range(1000), "id", {"train": 0.8, "val": 0.2})
    shards.write_sharded(rows, str(tmp_path / "s"), ["split"], 100)
    listed = shards.file_manifest(spark, str(tmp_path / "s")).collect()
    assert sum(r.samples for r in listed) == 1000 and max(r.samples for r in listed) <= 100
    paths, why = files.resolve_shards(spark, str(tmp_path / "s" / "split=val"))
    assert paths and why == "no manifest"
    name = paths[0].rsplit("/", 1)[1]
    (tmp_path / "s" / "split=val" / "manifest.json").write_text(f'{{"shards": [{{"path": "{name}"}}]}}')
    assert files.resolve_shards(spark, str(tmp_path / "s" / "split=val"))[0] == paths[:1]


def test_csv_keeps_leading_zeros_by_name(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("gid,DLBM,area,地类编码\n1,0101,2.5,007\n")
    row = files.read_csv(spark, str(tmp_path / "a.CSV")).first()
    assert (row.gid, row.DLBM, row.area, row["地类编码"]) == (1, "0101", 2.5, "007")
    assert [r.path.rsplit("/", 1)[1] for r in files.discover(spark, [str(tmp_path)], ["csv"]).collect()] == ["a.CSV"]
    with pytest.raises(ValueError, match="unknown file type"):
        files.kind_of("xyz")


def test_dbf_in_either_encoding(spark, tmp_path):
    for name, code in (("u", "utf-8"), ("g", "gb18030")):
        fields = [(b"NAME", 10), (b"N", 4)]
        head = bytes([3, 24, 1, 1]) + struct.pack("<IHH", 3, 32 + 32 * 2 + 1, 15) + bytes(20)
        head += b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for n, w in fields) + b"\r"
        rows = [b" " + "林地".encode(code).ljust(10) + b"  12", b"*" + b"gone".ljust(10) + b"   0", b" " + b"x".ljust(10) + b"    "]
        (tmp_path / f"{name}.dbf").write_bytes(head + b"".join(rows) + b"\x1a")
        got = files.read_dbf(spark, str(tmp_path / f"{name}.dbf")).orderBy("row").collect()
        assert [(r.row, r.cells) for r in got] == [(0, {"NAME": "林地", "N": "12"}), (2, {"NAME": "x", "N": ""})]


@pytest.mark.parametrize("n_fields", [3, 4, 5, 6, 7])
def test_dbf_header_lengths_do_not_choose_the_encoding(spark, tmp_path, n_fields):
    """A header of 3 to 6 fields has a length byte that is never valid UTF-8."""
    for code in ("utf-8", "gb18030"):
        names = [f"F{i}".encode() for i in range(n_fields)]
        head = bytes([3, 24, 1, 1]) + struct.pack("<IHH", 1, 32 + 32 * n_fields + 1, 1 + 12 * n_fields) + bytes(20)
        head += b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([12]) + bytes(15) for n in names) + b"\r"
        text = "café" if code == "utf-8" else "杭州"
        path = tmp_path / f"{code}.dbf"
        path.write_bytes(head + b" " + text.encode(code).ljust(12) * n_fields + b"\x1a")
        assert files.read_dbf(spark, str(path)).first().cells == {n.decode(): text for n in names}


def test_predicates_reach_the_files(spark, sf_dir):
    for part in (attributes.compound_query(spark, sf_dir),):
        plan = part._jdf.queryExecution().executedPlan().toString()
        pushed = [line for line in plan.split("\n") if "PushedFilters" in line]
        assert len(pushed) == 2
        assert "GreaterThanOrEqual(l_extendedprice,50000.0)" in plan and "In(l_linestatus, [F,O])" in plan
        assert "GreaterThanOrEqual(o_totalprice,50000.0)" in plan and "In(o_orderstatus, [F,O])" in plan


def test_numbers_that_zero_does_not_pass(spark):
    rows = spark.createDataFrame([(1, 5.0, 7), (2, None, None), (3, float("nan"), 2), (4, -5.0, -7)], "gid long, a double, n int")
    one = Store([Layer("one", rows, "gid")])
    got = lambda *tests: {r.gid for r in one.query(Request({}, list(tests))).collect()}
    assert got(("a", ">=", 1.0)) == {1} and got(("a", ">", -1.0)) == {1, 2, 3} and got(("a", "<", 0.0)) == {4}
    assert got(("n", ">", 1.5)) == {1, 3} and got(("n", "<=", 0.0)) == {2, 4} and got(("a", "==", 0.0), ("n", "==", 2.0)) == {3}


def test_indices_are_located_across_blocks(spark):
    wanted = spark.createDataFrame([(0,), (9,), (10,), (34,), (35,)], "index long")
    manifest = spark.createDataFrame([("a", 0, 10), ("none", 10, 0), ("b", 10, 25)], "shard string, start_index long, samples long")
    got = sorted(tuple(r) for r in shards.located(wanted, manifest, block=4).collect())
    assert got == [(0, "a", 0), (9, "a", 9), (10, "b", 0), (34, "b", 24)]


def test_geojson_polygons(spark, tmp_path):
    square = "[[[0,0],[1,0],[1,1],[0,0]]]"
    feature = lambda g, t, c: f'{{"type":"Feature","properties":{{"GID":{g},"n":"x"}},"geometry":{{"type":"{t}","coordinates":{c}}}}}'
    (tmp_path / "f.geojson").write_text(f'{{"type":"FeatureCollection","features":[{feature(7, "Polygon", square)},{feature(8, "MultiPolygon", f"[{square},{square}]")},{feature(9, "Point", "[1,2]")}]}}')
    got = {r.gid: r.parts for r in files.read_geojson(spark, str(tmp_path / "f.geojson")).collect()}
    assert set(got) == {7, 8} and len(got[8]) == 2 and got[7][0][0][1].x == 1.0


def test_request_files_and_logs(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1, 2 3 # four\n\n# none\n5,x\n")
    rows = files.read_gid_requests(spark, str(tmp_path / "r.txt")).orderBy("pos").collect()
    assert [(r.gid, r.line, r.bad_token) for r in rows] == [(1, 1, None), (2, 1, None), (3, 1, None), (5, 4, None), (None, 4, "x")]
    (tmp_path / "l.txt").write_text("Epoch [3/400] Started | stage=AE\nTrain total=1.5 mag=0.5 phase=1e-1\nval total: 2.0 mag: 1.0 phase: 0.25\nEpoch [4/400] Started ---\nTrain total=1.0 mag=0.4 phase=0.1\n")
    got = files.read_training_log(spark, str(tmp_path / "l.txt")).orderBy("epoch", "split").collect()
    assert [tuple(r) for r in got] == [(3, "train", 1.5, 0.5, 0.1), (3, "val", 2.0, 1.0, 0.25), (4, "train", 1.0, 0.4, 0.1)]


def test_pairing_faults(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (2,), (3,)], "k int")
    assert {(r.k, r.n_left, r.n_right) for r in shards.pairing_faults(a, b, "k").collect()} == {(1, 1, 0), (3, 0, 1)}


def test_layer_ranges_cover_every_row(spark):
    """At sf0.01 there are 15,000 orders, of which fixed ranges up to 9,000 drop 6,000."""
    sf = "/root/testdata/sf0.01"
    got = {r.layer: (r.n, r.first_idx, r.last_idx) for r in attributes.layer_of_every_row(spark, sf).collect()}
    start = 0
    for layer in tables.store(spark, sf).layers:
        n = layer.rows.count()
        assert got.pop(layer.name) == (n, start, start + n - 1)
        start += n
    assert not got


def test_lookups_reach_every_hundredth_row(spark):
    """At sf0.01 fixed requests end at id 6,999 and sample 1,399 of 15,000."""
    sf = "/root/testdata/sf0.01"
    keys = {r[0] for r in tables.table(spark, sf, "orders").select("o_orderkey").collect()}
    items = {r[0] for r in tables.table(spark, sf, "lineitem").select("l_orderkey").distinct().collect()}
    asked = {k for k in keys if k % 100 == 0}
    absent = {-1 - k for k in asked if k % 500 == 0}
    twice = [k for k in asked if k % 1000 == 0]
    fetched = attributes.gid_fetch_hundredths(spark, sf).collect()
    assert max(asked) > 14_000 and sorted(r.gid for r in fetched) == sorted([*asked, *twice]) and len({r.pos for r in fetched}) == len(fetched)
    assert sorted(r.gid for r in attributes.gid_latest_hundredths(spark, sf).collect()) == sorted(k for k in [*asked, *twice] if k in items)
    assert {r.gid for r in attributes.gid_missing_hundredths(spark, sf).collect()} == absent
    assert {r.gid for r in attributes.gid_resolve_hundredths(spark, sf).collect()} == asked | absent
    n = len(keys)
    assert sorted(r["index"] for r in series.sample_places_hundredths(spark, sf).collect()) == sorted([*range(0, n, 100), *range(0, n, 1000)])


def test_augmented_copies_equal_brute_force(spark):
    """Small triangles stay within the box, so areas grow by scale squared; large ones are clipped at it."""
    rows = [(g, t, *[size * turn(2 * g + t + k * 2.1) for k in range(3) for turn in (math.cos, math.sin)]) for g, size in ((1, 0.3), (2, 0.6), (3, 1.0)) for t in range(2)]
    columns = ["ax", "ay", "bx", "by", "cx", "cy"]
    shapes_ = spark.createDataFrame(rows, "gid long, tri_no int, " + ", ".join(f"{c} double" for c in columns))
    ids = shapes_.select("gid").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2))))
    hashes = {(r.gid, r.repeat): r[2:] for r in ids.select("gid", "repeat", *[F.xxhash64("gid", "repeat", F.lit(0), F.lit(k)) for k in range(4)]).collect()}
    area = lambda p: abs((p[2] - p[0]) * (p[5] - p[1]) - (p[4] - p[0]) * (p[3] - p[1])) / 2
    made = {(r.gid, r.repeat, r.tri_no): [r[c] for c in columns] for r in geometry.augmented(shapes_, 3).collect()}
    assert len(made) == 3 * len(rows)
    clipped = 0
    for gid, tri, *p in rows:
        assert made[gid, 0, tri] == p
        for repeat in (1, 2):
            a, s, x, y = (h % 2**32 / 2**32 * 2 - 1 for h in hashes[gid, repeat])
            a, s, x, y = a * math.pi, 1 + s * 0.2, x * 0.1, y * 0.1
            free = [v for px, py in zip(p[::2], p[1::2], strict=True) for v in ((math.cos(a) * px - math.sin(a) * py) * s + x, (math.sin(a) * px + math.cos(a) * py) * s + y)]
            got = made[gid, repeat, tri]
            assert np.allclose(got, np.clip(free, -1, 1), atol=1e-12) and not np.allclose(got, p)
            if max(map(abs, free)) <= 1:
                assert math.isclose(area(got), s * s * area(p), rel_tol=1e-9)
            else:
                clipped += 1
    assert 0 < clipped < 2 * len(rows)


def test_all_augmented_copies_are_returned(spark, sf_dir):
    got = {(r.gid, r.repeat): r.area for r in shapes.augmented_copies(spark, sf_dir).collect()}
    first = {r.gid: r.area for r in shapes.triangle_areas(spark, sf_dir).collect()}
    assert set(got) == {(g, k) for g in first for k in range(3)}
    assert all(got[g, 0] == a and got[g, 1] != a and got[g, 2] != a for g, a in first.items())
