"""Packing into shards, and tar archives."""

import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from geoloom.operators import packing
from geoloom.sources import tars


def packed_by_hand(rows, cap):
    out = []
    for g in {r[0] for r in rows}:
        held, shard, first = 0, 0, True
        for _, at, size in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, max(r[2] or 0, 0))):
            n = max(size or 0, 0)
            if not first and held + n > cap:
                shard, held = shard + 1, 0
            held, first = held + n, False
            out.append((g, at, n, shard))
    return sorted(out, key=str)


@pytest.mark.parametrize(("segment", "cap"), [(7, 50), (1000, 100), (3, 1000)])
def test_packed(spark, segment, cap):
    rng = random.Random(segment)
    names = ["a", "b", None, "+x", "-"]
    rows = [(rng.choice(names) if rng.random() < 0.5 else "big", rng.choice([None, 2**62, *range(-400, 400)]), rng.choice([None, 0, 1, 3, 10, 30, 130, -4])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, o long, s long").repartition(5)
    made = packing.packed(df, "g", "o", "s", cap, segment, 6)
    assert sorted(map(tuple, made.collect()), key=str) == packed_by_hand(rows, cap)


def test_one_group_is_packed_by_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("all").alias("g"), F.col("id").alias("o"), (F.col("id") * 7919 % 100).alias("s"))
    made = packing.packed(rows, "g", "o", "s", 1000, 500, 8)
    want = packed_by_hand([tuple(r) for r in rows.collect()], 1000)
    assert sorted(map(tuple, made.collect()), key=str) == want
    linked = packing._with_successors(packing._placed(rows.toDF("grp", "at", "size"), 8), 1000)
    assert linked.groupBy(F.spark_partition_id()).count().count() > 1
    assert packing.packed(rows.limit(0), "g", "o", "s", 1000).count() == 0


def samples(spark, n):
    content = lambda k: F.when(F.col("no") % 11 == k, F.lit(None)).otherwise(F.repeat(F.col("no").cast("string"), (F.col("no") * 37 % 400).cast("int")))
    rows = spark.range(n).select(F.col("id").alias("no"), F.when(F.col("id") % 10 == 9, "val").otherwise("train").alias("split"), F.format_string("dir.x/s%05d", "id").alias("key"))
    return rows.withColumn("fields", F.create_map(F.lit("in.npy"), content(3).cast("binary"), F.lit("label.txt"), content(4).cast("binary")))


def test_archives_read_back_equal(spark, tmp_path):
    made = samples(spark, 600).repartition(7)
    folder = str(tmp_path / "out")
    tars.write_tars(made, folder, 40_000)
    want = {(r.key, f): bytes(v or b"") for r in made.collect() for f, v in r.fields.items()}
    for split_bytes in (3_000, 10**9):
        read = tars.read_tars(spark, folder, split_bytes=split_bytes)
        assert {tars.split_name(r.member): bytes(r.content) for r in read.collect()} == want
        assert read.count() == len(want)
        by_sample = tars.read_tars(spark, folder, samples=True, split_bytes=split_bytes).collect()
        assert {(r.key, f): bytes(v) for r in by_sample for f, v in r.fields.items()} == want
        assert len(by_sample) == 600
    manifest = json.loads((tmp_path / "out" / tars.MANIFEST).read_text())
    sizes = [f["payload_bytes"] for f in manifest["tar_files"]]
    assert manifest["total_samples"] == 600 and max(sizes) <= 40_000 and sum(sizes) == sum(map(len, want.values()))
    assert {r.split: r.num_samples for r in tars.read_split_index(spark, folder).collect()} == {"train": 540, "val": 60}
    with tarfile.open(tmp_path / "out" / "train" / "train-000001.tar") as tar:
        assert {m.name for m in tar} <= {".".join(k) for k in want}
    assert not list((tmp_path / "out").glob("_writing-*"))
    with pytest.raises(FileExistsError):
        tars.write_tars(made, folder, 40_000)


def test_several_tasks_read_one_archive(spark, tmp_path):
    path = tmp_path / "foreign.tar"
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as tar:
        for k in range(300):
            for name in ("b", "a.x"):
                m = tarfile.TarInfo(f"{'long/' * 30 if k % 7 == 0 else ''}k{k}.{name}")
                m.size = k
                tar.addfile(m, io.BytesIO(bytes([k % 256]) * k))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "k1.b"
        tar.addfile(link)
    read = tars.read_tars(spark, str(path), split_bytes=20_000)
    assert read.rdd.getNumPartitions() > 5
    rows = read.collect()
    assert len(rows) == 600 and all(len(r.content) == r["size"] for r in rows) and len({r.at for r in rows}) == 600
    assert tars.read_tars(spark, str(path), samples=True, split_bytes=20_000).count() == 300
    # Offsets noted by a job give the same splits without a walk.
    noted = tars.note_offsets(spark, str(tmp_path), 4_000).collect()
    assert len(noted) == 1 and noted[0].offsets[0] == 0
    again = tars.read_tars(spark, str(tmp_path), split_bytes=20_000)
    assert again.rdd.getNumPartitions() > 5 and sorted(map(tuple, again.drop("path", "content").collect())) == sorted(map(tuple, read.drop("path", "content").collect()))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    writer = tars.TarWriter(str(tmp_path / "w"), False)
    row = lambda a, k: type("Row", (), {"archive": a, "key": k, "field": "x", "content": b"abc"})
    done = writer.write(iter([row("train/train-000000", "k1"), row("train/train-000000", "k2")]))
    writer.write(iter([row("train/train-000000", "k1")]))  # an attempt that does not count
    assert not list((tmp_path / "w").rglob("*.tar"))
    writer.commit([done, None])
    assert [p.name for p in (tmp_path / "w").rglob("*.tar")] == ["train-000000.tar"]
    failing = tars.TarWriter(str(tmp_path / "v"), False)
    failing.write(iter([row("val/val-000000", "k1")]))
    failing.abort([])
    assert not [p for p in (tmp_path / "v").rglob("*") if p.is_file()]
    with pytest.raises(FileNotFoundError):
        tars.archives(str(tmp_path / "v"))


def test_damaged_archives_raise(spark, tmp_path):
    path = tmp_path / "bad.tar"
    with tarfile.open(path, "w") as tar:
        m = tarfile.TarInfo("a.b")
        m.size = 5000
        tar.addfile(m, io.BytesIO(b"x" * 5000))
    path.write_bytes(path.read_bytes()[:3000])
    with pytest.raises(Exception, match="(?i)unexpected end|read|trunc"):
        tars.read_tars(spark, str(path)).collect()
