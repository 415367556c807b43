"""Splits and samples of exact size, and versions of a table."""

import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from geoloom.operators import sampling
from geoloom.operators.versions import Damaged, Versions


@pytest.mark.parametrize(("n", "ratio"), [(2, 0.9), (3, 0.0), (10, 0.25), (1000, 0.1), (1000, 1.0), (4321, 0.337)])
def test_exact_split(spark, n, ratio):
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("split_of"))
    made = sampling.exact_split(rows, "k", ratio, 3)
    val = {r.k for r in made.where("split = 'val'").collect()}
    order = sorted(range(n), key=lambda k: hashlib.md5(f"{k}:3".encode()).hexdigest())
    assert val == set(order[: min(n - 1, max(1, int(n * ratio)))]) and made.count() == n and made.columns == ["k", "split_of", "split"]


def test_split_of_repeated_keys(spark):
    rows = spark.range(90).select((F.col("id") % 3).alias("k"))
    for ratio in (0.1, 0.5, 0.9):
        assert sampling.exact_split(rows, "k", ratio).where("split = 'val'").count() == int(90 * ratio)
    with pytest.raises(ValueError, match="two samples"):
        sampling.exact_split(rows.limit(1), "k", 0.5)


def test_kth_place(spark):
    places = [5, 0, 2**60 - 1, 5, 5, 123456789, 2**59]
    df = spark.createDataFrame([(p,) for p in places], "place long")
    for k in range(1, len(places) + 1):
        at = sorted(places)[k - 1]
        assert sampling.kth_place(df, k) == (at, sum(p < at for p in places))


@pytest.mark.parametrize("parts", [1, 5])
def test_rank_sample(spark, parts):
    rows = spark.range(500).select((F.col("id") % 3 * F.when(F.col("id") < 400, 1)).alias("rank"), F.col("id").alias("k"))
    made = sampling.rank_sample(rows, "rank", "k", 20, 4, parts)
    want = {}
    for r in rows.collect():
        want.setdefault(r["rank"], []).append((hashlib.md5(f"{r.k}:4".encode()).hexdigest(), r.k))
    got = sorted((str(r["rank"]), r.pool_no, r.k) for r in made.collect())
    assert got == sorted((str(g), i, k) for g, each in want.items() for i, (_, k) in enumerate(sorted(each)[:20]))
    assert sampling.rank_sample(rows, "rank", "k", 0).count() == 0 and sampling.rank_sample(rows.limit(0), "rank", "k", 5).count() == 0


def test_versions(spark, tmp_path):
    kept = Versions(spark, str(tmp_path / "state"))
    with pytest.raises(FileNotFoundError):
        kept.load()
    rows = [spark.range(100 * k).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("t"), F.array(F.col("id") / 3).alias("v")) for k in (1, 2, 3)]
    for k, r in enumerate(rows):
        assert kept.commit(r).number == k + 1
    assert kept.numbers() == [3, 2]
    found, version = kept.load()
    assert version.number == 3 and sorted(map(str, found.collect())) == sorted(map(str, rows[2].collect()))
    # Only the data that pointers name stay.
    assert len(list((tmp_path / "state").glob("data-*"))) == 2 and not list((tmp_path / "state").glob("_draft-*"))


@pytest.mark.parametrize("harm", ["cut", "gone", "rows", "pointer"])
def test_a_damaged_version_gives_way(spark, tmp_path, harm):
    folder = tmp_path / "state"
    kept = Versions(spark, str(folder))
    kept.commit(spark.range(50))
    made = kept.commit(spark.range(80))
    data = folder / made.data
    if harm == "cut":
        for p in data.glob("part-*"):
            p.write_bytes(p.read_bytes()[: p.stat().st_size // 2])
        for p in data.glob(".*.crc"):
            p.unlink()
    elif harm == "gone":
        shutil.rmtree(data)
    elif harm == "rows":
        spark.range(79).write.mode("append").parquet(str(data))
    else:
        (folder / "version-2.json").write_text('{"data": "da')
        for p in folder.glob(".version-2*"):
            p.unlink()
    found, version = kept.load()
    assert version.number == 1 and found.count() == 50
    with pytest.raises(Damaged):
        kept.read(2)
    # The next one takes a new number, and stands.
    assert kept.commit(spark.range(7)).number == 3 and kept.load()[0].count() == 7


def test_a_pointer_is_not_replaced(spark, tmp_path):
    kept = Versions(spark, str(tmp_path / "s"))
    kept.commit(spark.range(3))
    kept.numbers = lambda: []  # a writer that has not seen the first version
    with pytest.raises(FileExistsError):
        kept.commit(spark.range(4))
    assert Versions(spark, str(tmp_path / "s")).load()[0].count() == 3


def test_no_whole_version(spark, tmp_path):
    kept = Versions(spark, str(tmp_path / "s"))
    shutil.rmtree(tmp_path / "s" / kept.commit(spark.range(3)).data)
    with pytest.raises(Damaged, match="no version"):
        kept.load()
