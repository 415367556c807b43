"""Tar archives of samples: a Spark source that splits files at members, and a writer that commits in two steps.

`tar` is a data source. Read, it gives one member a row, or with
samples=true one sample a row: neighbouring members whose names agree up to
the first dot. A file beyond `splitbytes` is read by several tasks, which begin
at offsets where a sample begins; these come from a list beside the archive or,
without one, from a walk over the member headers.

Written, each task puts whole archives into a folder of its own job. Only when
all tasks have succeeded are the archives of those attempts that count moved
to their places, and the manifest comes last.
"""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from geoloom.operators.packing import packed

MEMBERS = "path string, member string, at long, size long, content binary"
SAMPLES = "path string, key string, fields map<string,binary>"
#: Bytes of an archive that one task reads, about, and between two offsets that are noted beside it.
SPLIT_BYTES, NOTED_BYTES = 128 << 20, 16 << 20
OFFSETS = ".offsets"
MANIFEST, INDEX = "manifest.json", "index_file.json"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a plain local path, and the path there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def split_name(member: str) -> tuple[str, str]:
    """A member's key and field: folders and the name up to its first dot, and what comes after that."""
    found = re.fullmatch(r"((?:.*/)?[^/.]+)\.([^/]*)", member, re.S)
    return (found[1], found[2]) if found else (member, "")


def archives(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives at or below path, sorted; raises if there is none."""
    store, at = file_system(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [] if info.type == fs.FileType.NotFound else store.get_file_info(fs.FileSelector(at, recursive=True))
    here = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".tar") and "/_writing-" not in f.path)
    if not here:
        raise FileNotFoundError(f"no tar archive at {path}")
    root = path.rstrip("/")
    return [(root + p[len(at.rstrip("/")) :], size) for p, size in here]


def _members(f, start: int = 0) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    f.seek(start)
    with tarfile.TarFile(fileobj=f, mode="r") as tar:
        for m in tar:
            tar.members = []  # it would keep them all
            yield tar, m


def sample_offsets(f, step: int) -> list[int]:
    """Where samples begin, at least step bytes apart and the first at 0; only headers are read."""
    noted, last = [0], None
    for _, m in _members(f):
        key = split_name(m.name)[0]
        if m.offset >= noted[-1] + step and key != last:
            noted.append(m.offset)
        last = key
    return noted


def _noted(path: str) -> list[int] | None:
    store, at = file_system(path + OFFSETS)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_file(at) as f:
        return [int(x) for x in f.read().split()]


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None


class TarReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, samples: bool):
        self.path, self.split_bytes, self.samples = path, split_bytes, samples

    def partitions(self) -> list[Split]:
        made = []
        for path, size in archives(self.path):
            starts = [0]
            if size > self.split_bytes:
                noted = _noted(path)
                if noted is None:
                    store, at = file_system(path)
                    with store.open_input_file(at) as f:
                        noted = sample_offsets(f, self.split_bytes)
                for offset in noted:
                    if offset - starts[-1] >= self.split_bytes:
                        starts.append(offset)
            made += [Split(path, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return made

    def read(self, partition: Split) -> Iterator[tuple]:
        store, at = file_system(partition.path)
        key, fields = None, {}
        with store.open_input_file(at) as f:
            for tar, m in _members(f, partition.start):
                if partition.end is not None and m.offset >= partition.end:
                    break
                if not m.isfile():
                    continue
                content = tar.extractfile(m).read()
                if not self.samples:
                    yield partition.path, m.name, m.offset, m.size, content
                    continue
                now, name = split_name(m.name)
                if now != key and fields:
                    yield partition.path, key, fields
                    fields = {}
                key, fields[name] = now, content
        if fields:
            yield partition.path, key, fields


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (archive, its place in the job's folder, samples, bytes of content, bytes of the archive)."""

    files: list[tuple[str, str, int, int, int]] = field(default_factory=list)


class TarWriter(DataSourceWriter):
    """Takes rows (archive, key, field, content) in which each archive's rows come one after another in one task."""

    def __init__(self, path: str, overwrite: bool):
        self.store, self.root = file_system(path)
        refuse_used(path)
        self.job = f"{self.root}/_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        done = Written()
        now, tar, out, last, noted, counts = None, None, None, None, [], [0, 0]

        def close() -> None:
            tar.close()
            size = out.tell()
            out.close()
            with self.store.open_output_stream(place + OFFSETS) as f:
                f.write("\n".join(map(str, noted)).encode())
            done.files.append((now, place, *counts, size))

        for row in rows:
            if row.archive != now:
                if tar is not None:
                    close()
                now, last, noted, counts, place = row.archive, None, [0], [0, 0], f"{self.job}/{uuid.uuid4().hex}"
                self.store.create_dir(self.job, recursive=True)
                out = self.store.open_output_stream(place)
                tar = tarfile.TarFile(fileobj=out, mode="w", format=tarfile.PAX_FORMAT)
            content = bytes(row.content)
            entry = tarfile.TarInfo(f"{row.key}.{row.field}")
            entry.size = len(content)
            if row.key != last:
                counts[0] += 1
                if tar.offset >= noted[-1] + NOTED_BYTES:
                    noted.append(tar.offset)
            last = row.key
            counts[1] += len(content)
            tar.addfile(entry, io.BytesIO(content))
            tar.members = []
        if tar is not None:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        for archive, place, _, _, _ in files:
            target = f"{self.root}/{archive}.tar"
            self.store.create_dir(target.rpartition("/")[0], recursive=True)
            # The list goes first, so that no archive stands without it.
            self.store.move(place + OFFSETS, target + OFFSETS)
            self.store.move(place, target)
        splits: dict[str, int] = {}
        for archive, _, samples, _, _ in files:
            split = archive.partition("/")[0]
            splits[split] = splits.get(split, 0) + samples
        listed = [{"path": f"{a}.tar", "samples": n, "payload_bytes": b, "size_bytes": s} for a, _, n, b, s in files]
        for name, content in ((INDEX, {k: {"num_samples": n, "path": k} for k, n in splits.items()}), (MANIFEST, {"total_samples": sum(splits.values()), "tar_files": listed})):
            with self.store.open_output_stream(f"{self.root}/{name}") as f:
                f.write(json.dumps(content).encode())
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        if self.store.get_file_info(self.job).type != fs.FileType.NotFound:
            self.store.delete_dir(self.job)


class TarSource(DataSource):
    """Options: path; splitbytes; samples (true for one sample a row)."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def _samples(self) -> bool:
        return self.options.get("samples", "false").lower() == "true"

    def schema(self) -> str:
        return SAMPLES if self._samples() else MEMBERS

    def reader(self, schema) -> TarReader:
        return TarReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)), self._samples())

    def writer(self, schema, overwrite: bool) -> TarWriter:
        return TarWriter(self.options["path"], overwrite)


def refuse_used(folder: str) -> None:
    """Raises FileExistsError if there are archives or a manifest in the folder."""
    store, at = file_system(folder)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return
    used = sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.lower().endswith(".tar") or f.base_name == MANIFEST)
    if used:
        raise FileExistsError(f"{folder} holds {len(used)} files of an earlier run, such as {used[0]}")


def read_tars(spark: SparkSession, path: str, samples: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Members of the archives at or below path: path, member, at (its offset), size, content; or samples: path, key, fields.

    Folders and links in an archive are left out. A path without archives
    raises, as does a damaged archive once it is read.
    """
    spark.dataSource.register(TarSource)
    return spark.read.format("tar").option("splitbytes", split_bytes).option("samples", str(samples).lower()).load(path)


def write_tars(samples: DataFrame, folder: str, cap: int) -> None:
    """Writes samples(split, no, key, fields map of binary) as <split>/<split>-<bucket>.tar, with a manifest and an index of the splits.

    Samples of a split go in the order of their unique numbers `no` into
    buckets of at most cap bytes of content. A bucket is one archive and one
    task's work. Samples without fields are left out, null contents are empty;
    a folder that holds archives is refused.
    """
    refuse_used(folder)
    spark = samples.sparkSession
    spark.dataSource.register(TarSource)
    sized = samples.where(F.size("fields") > 0).select("split", "no", F.aggregate(F.map_values("fields"), F.lit(0).cast("long"), lambda s, v: s + F.coalesce(F.octet_length(v), F.lit(0))).alias("bytes"))
    buckets = packed(sized, "split", "no", "bytes", cap).select(F.col("group").alias("split"), F.col("at").alias("no"), "shard")
    archive = F.format_string("%s/%s-%06d", "split", "split", "shard")
    each = samples.join(buckets, ["split", "no"]).select(archive.alias("archive"), "no", "key", F.explode("fields").alias("field", "content"))
    each = each.withColumn("content", F.coalesce("content", F.lit(b"")))
    laid = each.repartition("archive").sortWithinPartitions("archive", "no", "field").select("archive", "key", "field", "content")
    laid.write.format("tar").mode("append").save(folder)


def note_offsets(spark: SparkSession, folder: str, step: int = NOTED_BYTES) -> DataFrame:
    """Writes the lists of offsets that archives from elsewhere lack, one task an archive: path, offsets."""
    found = [(p,) for p, _ in archives(folder) if _noted(p) is None]

    def walk(batches):
        for pdf in batches:
            lists = []
            for path in pdf["path"]:
                store, at = file_system(path)
                with store.open_input_file(at) as f:
                    noted = sample_offsets(f, step)
                with store.open_output_stream(at + OFFSETS) as f:
                    f.write("\n".join(map(str, noted)).encode())
                lists.append(noted)
            yield pdf.assign(offsets=lists)

    rows = spark.createDataFrame(found, "path string")
    made = rows.repartition(max(1, len(found)), "path").mapInPandas(walk, "path string, offsets array<long>")
    return spark.createDataFrame(made.collect(), made.schema)


def read_split_index(spark: SparkSession, folder: str) -> DataFrame:
    """The splits that `write_tars` noted: split, num_samples, path."""
    raw = spark.read.text(f"{folder.rstrip('/')}/{INDEX}", wholetext=True)
    entries = F.from_json("value", "map<string,struct<num_samples:long,path:string>>")
    return raw.select(F.explode(entries).alias("split", "e")).select("split", "e.num_samples", "e.path")
