"""Readers of attribute tables, features, requests, logs and manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geoloom.functions.columns import NOT_ATTRIBUTES, is_forced_text

#: Accepted names of file kinds.
KINDS = {"shp": "shp", "shapefile": "shp", "gdb": "gdb", "filegdb": "gdb", "geojson": "geojson", "json": "geojson", "csv": "csv", "dbf": "dbf"}


def kind_of(name: str) -> str:
    key = name.strip().lower().lstrip(".")
    if key not in KINDS:
        raise ValueError(f"unknown file type {name!r}")
    return KINDS[key]


def discover(spark: SparkSession, folders: list[str], kinds: list[str]) -> DataFrame:
    """Files of the given kinds below folders, whatever the case of their endings: path, length; each once, sorted."""
    endings = [e for e, k in KINDS.items() if k in {kind_of(x) for x in kinds}]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path", "length")
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(endings)).dropDuplicates(["path"]).orderBy("path")


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header; column types are inferred, but columns whose names say so are text and keep leading zeros."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    inferred = reader.option("inferSchema", True).csv(path).schema
    fields = [T.StructField(f.name, T.StringType() if is_forced_text(f.name) and f.name.lower() not in NOT_ATTRIBUTES else f.dataType) for f in inferred.fields]
    return reader.schema(T.StructType(fields)).csv(path)


def read_dbf(spark: SparkSession, path: str, encoding: str = "utf-8", fallback: str = "gb18030") -> DataFrame:
    """dBASE attribute tables: path, row, cells (a map of trimmed texts).

    A table whose field names and text cells are not all in `encoding` is read
    in `fallback`. The rest of the file, such as the lengths in its header, has
    no say in that.
    """

    def is_in(code: str, texts: Iterator[bytes]) -> bool:
        try:
            for t in texts:
                t.decode(code)
        except UnicodeDecodeError:
            return False
        return True

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                count, head, width = (int.from_bytes(content[a:b], "little") for a, b in ((4, 8), (8, 10), (10, 12)))
                fields, at, start = [], 32, 1
                while content[at] != 0x0D:
                    fields.append((content[at : at + 11].split(b"\0")[0], start, content[at + 16], content[at + 11 : at + 12]))
                    start, at = start + content[at + 16], at + 32
                rows = [content[head + i * width : head + (i + 1) * width] for i in range(count)]
                live = [(i, r) for i, r in enumerate(rows) if r[:1] != b"*"]
                texts = (r[s : s + w] for _, r in live for _, s, w, kind in fields if kind == b"C")
                used = encoding if is_in(encoding, (f[0] for f in fields)) and is_in(encoding, texts) else fallback
                cells = [{n.decode(used, "replace"): r[s : s + w].decode(used, "replace").strip() for n, s, w, _ in fields} for _, r in live]
                for k in range(0, len(live), 10_000):
                    yield pd.DataFrame({"path": name, "row": [i for i, _ in live[k : k + 10_000]], "cells": cells[k : k + 10_000]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row long, cells map<string,string>")



_GEOJSON = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Polygon features: path, gid (of the properties, any case), properties, parts; other geometries go.

    A polygon is an array of rings and a multipolygon an array of polygons;
    both become parts, an array of polygons.
    """
    raw = spark.read.schema(_GEOJSON).option("multiLine", True).json(path)
    each = raw.select(F.input_file_name().alias("path"), F.explode("features").alias("f"))
    shape = F.col("f.geometry.coordinates")
    one = F.from_json(shape, "array<array<array<double>>>")
    many = F.from_json(shape, "array<array<array<array<double>>>>")
    nested = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    points = F.transform(nested, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))
    gid = F.element_at(F.map_values(F.map_filter("f.properties", lambda k, _: F.lower(k) == "gid")), 1).try_cast("bigint")
    return each.where(F.col("f.geometry.type").isin("Polygon", "MultiPolygon")).select("path", F.when(F.size(F.map_filter("f.properties", lambda k, _: F.lower(k) == "gid")) > 0, gid).alias("gid"), F.col("f.properties").alias("properties"), points.alias("parts"))


def read_gid_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requested ids of a text file: pos, gid, line, and the token where it is no id. '#' begins a comment; commas and spaces part ids."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    tokens = lines.select((F.col("line") + 1).alias("line"), F.posexplode(F.split(F.substring_index("text", "#", 1), r"[\s,]+")).alias("at", "token")).where("token != ''")
    order = F.row_number().over(Window.orderBy("line", "at")) - 1  # request files are short
    return tokens.select(order.alias("pos"), F.col("token").try_cast("bigint").alias("gid"), "line", F.when(F.col("token").try_cast("bigint").isNull(), F.col("token")).alias("bad_token"))


#: Numbers as a log has them.
_NUMBER = r"([-+0-9.eE]+)"


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of a training log: epoch, split, total, mag, phase. A metric line belongs to the last epoch that began before it."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    got = lambda p, g=1: F.nullif(F.regexp_extract("text", p, g), F.lit(""))
    marked = lines.select("file", "line", got(r"Epoch\s*\[?\s*(\d+)\s*/").cast("int").alias("begun"), got(r"(?i)\b(train|val)\w*\b").alias("split"), *[got(rf"(?i)\b{m}\w*\s*[:=]\s*{_NUMBER}").try_cast("double").alias(m) for m in ("total", "mag", "phase")])
    epoch = F.last("begun", ignorenulls=True).over(Window.partitionBy("file").orderBy("line"))
    return marked.withColumn("epoch", epoch).where("epoch is not null and split is not null and total is not null").select("epoch", F.lower("split").alias("split"), "total", "mag", "phase")


def resolve_shards(spark: SparkSession, folder: str, pattern: str = "*.parquet", manifest: str = "manifest.json") -> tuple[list[str], str]:
    """Paths of a folder's shards by its manifest, or by pattern if there is none that fits; and why.

    Both the manifest and the listing are read by Spark, so the folder may lie
    in any store.
    """
    listed = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").collect())
    names = {re.sub(r"^.*/", "", p): p for p in listed}
    try:
        rows = spark.read.option("multiLine", True).schema("shards array<struct<path:string>>").json(f"{folder.rstrip('/')}/{manifest}").collect()
        wanted = [re.sub(r"^.*/", "", s["path"]) for r in rows for s in (r["shards"] or [])]
    except Exception as e:  # Spark names missing files by an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return listed, "no manifest"
    if not wanted or any(w not in names for w in wanted):
        return listed, "manifest does not fit"
    left = sorted(set(names) - set(wanted))
    return [names[w] for w in wanted], f"manifest; not in it: {', '.join(left)}" if left else "manifest"
