"""Versions of a table in one folder: checked writes, an atomic pointer, and the version before as a fallback.

A version is a folder of Parquet files with a fingerprint of its rows. It is
written, read back and compared before a pointer file names it; the pointer is
put in place by one rename. Readers take the newest version whose rows still
have their fingerprint.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that are kept: the newest and the ones before it.
KEPT = 2


class Damaged(ValueError):
    """A version whose files are missing, unreadable or not what was written."""


@dataclass(frozen=True)
class Version:
    number: int
    data: str
    rows: int
    checksum: str
    schema: str


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a checksum that does not depend on their order: sums of two hashes of each row's fields and their types."""
    fields = [F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}) for c in df.columns]
    named = [F.lit(f"{c}:{t}") for c, t in df.dtypes]
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    n, one, other = df.agg(F.count("*"), wide(F.xxhash64(*named, *fields)), wide(F.xxhash64(F.lit("other"), *named, *fields))).first()
    return n, f"{one or 0}:{other or 0}"


class Versions:
    """The versions in a folder of any store that Spark reaches. One writer at a time; readers may come at any moment."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._root = self._jvm.Path(self.folder)
        self._store = self._root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.Path(f"{self.folder}/{name}")

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._store.listStatus(self._root)] if self._store.exists(self._root) else []

    def numbers(self) -> list[int]:
        """Numbers of the versions that have a pointer, the newest first."""
        return sorted((int(m[1]) for n in self._names() if (m := re.fullmatch(r"version-(\d+)\.json", n))), reverse=True)

    def describe(self, number: int) -> Version:
        try:
            said = json.loads(self.spark.read.text(f"{self.folder}/version-{number}.json", wholetext=True).first()[0])
            return Version(number, said["data"], said["rows"], said["checksum"], said["schema"])
        except Exception as e:  # a pointer that is missing, cut off or no JSON
            raise Damaged(f"version {number} has no pointer that can be read") from e

    def commit(self, df: DataFrame) -> Version:
        """Writes df as the next version; what was there stays what readers find until the last step.

        The rows are compared as they are read back with as they were given, so
        df must give the same rows twice. Older versions beyond KEPT go.
        """
        number = max(self.numbers(), default=0) + 1
        data = f"data-{number}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{data}")
        given, found = fingerprint(df), fingerprint(self.spark.read.schema(df.schema).parquet(f"{self.folder}/{data}"))
        if given != found:
            self._store.delete(self._path(data), True)
            raise Damaged(f"{found} was written in place of {given}")
        made = Version(number, data, *found, df.schema.json())
        draft, pointer = self._path(f"_draft-{uuid.uuid4().hex}"), self._path(f"version-{number}.json")
        out = self._store.create(draft, True)
        out.write(bytearray(json.dumps({"data": data, "rows": made.rows, "checksum": made.checksum, "schema": made.schema}).encode()))
        out.hsync()
        out.close()
        if not self._store.rename(draft, pointer):
            raise FileExistsError(f"another writer has made version {number}")
        self._clear(number)
        return made

    def _clear(self, newest: int) -> None:
        """Removes versions that are too old, pointers first, and data that no pointer names."""
        for old in self.numbers()[KEPT:]:
            self._store.delete(self._path(f"version-{old}.json"), False)
        kept = {f"{n}" for n in self.numbers()}
        for name in self._names():
            if (m := re.fullmatch(r"data-(\d+)-\w+", name)) and int(m[1]) < newest and m[1] not in kept:
                self._store.delete(self._path(name), True)

    def read(self, number: int) -> DataFrame:
        """The rows of one version; raises Damaged if they are not what was written."""
        from pyspark.sql.types import StructType

        version = self.describe(number)
        try:
            rows = self.spark.read.schema(StructType.fromJson(json.loads(version.schema))).parquet(f"{self.folder}/{version.data}")
            found = fingerprint(rows)
        except Exception as e:
            raise Damaged(f"version {number} cannot be read") from e
        if found != (version.rows, version.checksum):
            raise Damaged(f"version {number} has {found[0]} rows that are not the {version.rows} written")
        return rows

    def load(self) -> tuple[DataFrame, Version]:
        """The newest version that is whole, and which it is; raises if there is none."""
        numbers, last = self.numbers(), None
        for number in numbers:
            try:
                return self.read(number), self.describe(number)
            except Damaged as e:
                last = e
        if last is not None:
            raise Damaged(f"no version in {self.folder} is whole") from last
        raise FileNotFoundError(f"no version in {self.folder}")
