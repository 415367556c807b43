"""Checks of shards and records before they are worked on, and reports about runs."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import geometry

#: Indices are stored in so many values, and a meta row has so many numbers.
MOST_INDEX, META_WIDTH = 65_535, 6


def triangle_faults(samples: DataFrame, key: str = "gid", triangles: str = "triangles") -> DataFrame:
    """Samples whose list of triangles (an array of arrays of six coordinates) cannot be used: key, fault.

    Faults are missing, empty, width (a triangle without six numbers) and not
    finite (a null, NaN or infinite coordinate); the first of them counts.
    """
    t = F.col(triangles)
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    fault = (
        F.when(t.isNull(), "missing").when(F.size(t) == 0, "empty").when(F.exists(t, lambda one: one.isNull() | (F.size(one) != 6)), "width")
        .when(F.exists(t, lambda one: F.exists(one, odd)), "not finite")
    )
    return samples.select(key, fault.alias("fault")).where("fault is not null")


def index_faults(records: DataFrame, gid: str = "gid", indices: str = "indices", meta: str = "meta", most: int = MOST_INDEX) -> DataFrame:
    """Index records that cannot be decoded: gid, fault.

    A record has a gid, a grid of indices (levels, rows, columns, all rows and
    levels of one size, whole numbers from 0 to most) and META_WIDTH numbers.
    """
    grid, flat = F.col(indices), F.flatten(F.flatten(indices))
    rows = lambda level: F.size(level)
    widths = F.transform(F.flatten(indices), lambda row: F.size(row))
    fault = (
        F.when(F.col(gid).isNull(), "gid").when(grid.isNull() | (F.size(grid) == 0), "indices")
        .when(F.exists(grid, lambda level: level.isNull()) | (F.size(F.array_distinct(F.transform(grid, rows))) > 1) | F.exists(F.flatten(indices), lambda row: row.isNull()) | (F.size(F.array_distinct(widths)) > 1), "ragged")
        .when(F.exists(flat, lambda i: i.isNull() | (i < 0) | (i > most)), "range")
        .when(F.col(meta).isNull() | (F.size(meta) != META_WIDTH), "meta")
    )
    return records.select(F.col(gid).alias("gid"), fault.alias("fault")).where("fault is not null")


def guarded_indices(indices: Column, most: int = MOST_INDEX) -> Column:
    """A flat list of indices as it is; the query fails where one of them is out of range."""
    fits = F.forall(indices, lambda i: (i >= 0) & (i <= most))
    return F.when(F.coalesce(fits, F.lit(True)), indices).otherwise(F.raise_error(F.concat(F.lit(f"indices out of range 0 to {most}: "), F.array_min(indices).cast("string"), F.lit(" to "), F.array_max(indices).cast("string"))))


def alignment_faults(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that not all tables have equally often: key, and how often each table has it (n_<name>); none if they go together."""
    counts = [df.groupBy(F.col(key).alias(key)).agg(F.count("*").alias("n")).select(key, F.lit(name).alias("name"), "n") for name, df in tables.items()]
    each = reduce(DataFrame.union, counts).groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{name}") for name in tables])
    n = [F.col(f"n_{name}") for name in tables]
    return each.where(F.least(*n) != F.greatest(*n))


def task_manifest(files: DataFrame, folder: str, name: str, lineage: dict[str, str]) -> DataFrame:
    """Writes what a task has made, files(path, samples, bytes), with where it came from, as JSON; returns the totals.

    A file is one line, so the manifest may grow with the data; the totals and
    the lineage are a file of one line beside them. A folder of that name is
    refused.
    """
    target = f"{folder.rstrip('/')}/{name}"
    totals = files.agg(F.count("*").alias("num_shards"), F.coalesce(F.sum("samples"), F.lit(0)).alias("total_samples"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    described = totals.withColumn("metadata", F.create_map(*[F.lit(x) for pair in lineage.items() for x in pair]) if lineage else F.lit(None).cast("map<string,string>"))
    files.select("path", "samples", "bytes").write.mode("errorifexists").json(f"{target}/shards")
    described.coalesce(1).write.mode("errorifexists").json(f"{target}/totals")
    return described


def run_counters(rows: DataFrame, triangles: DataFrame, key: str = "gid") -> DataFrame:
    """One row of sums over a run of `triangulate`: rows, and of these degenerate, dropped, failed, risky, of several parts, with holes.

    A row with a degenerate triangle is degenerate, and dropped if it has no
    sound one. Rows of several parts and rows with holes are also counted among
    those with triangles and those dropped or failed.
    """
    said = rows.select(F.col(key).alias("k"), geometry.is_risky(F.col("parts")).alias("risky"), (F.size("parts") > 1).alias("multi"), F.exists("parts", lambda p: F.size(p) > 1).alias("holed"))
    fault = geometry.triangle_fault()
    made = triangles.groupBy(F.col(key).alias("of")).agg(
        F.count_if(F.col("error").isNull() & fault.isNull()).alias("sound"), F.count_if(F.col("error").isNull() & fault.isNotNull()).alias("unsound"), F.max(F.col("error").isNotNull()).alias("failed")
    )
    each = said.join(made, F.col("k") == F.col("of"), "left").withColumns({"sound": F.coalesce("sound", F.lit(0)), "unsound": F.coalesce("unsound", F.lit(0)), "failed": F.coalesce("failed", F.lit(False))})
    good, dropped = F.col("sound") > 0, ~F.col("failed") & (F.col("sound") == 0)
    lost = dropped | F.col("failed")
    return each.agg(
        F.count("*").alias("total_rows"), F.coalesce(F.sum("sound"), F.lit(0)).alias("triangles"), F.count_if(good).alias("triangulated_rows"), F.count_if(F.col("unsound") > 0).alias("degenerate_rows"),
        F.coalesce(F.sum("unsound"), F.lit(0)).alias("degenerate_triangles"), F.count_if(dropped).alias("dropped_rows"), F.count_if("failed").alias("failed_rows"), F.count_if("risky").alias("isolated_rows"),
        F.count_if("multi").alias("multipolygon_rows"), F.count_if("holed").alias("hole_rows"), F.count_if(F.col("multi") & good).alias("triangulated_multipolygon_rows"),
        F.count_if(F.col("holed") & good).alias("triangulated_hole_rows"), F.count_if(F.col("multi") & lost).alias("dropped_multipolygon_rows"), F.count_if(F.col("holed") & lost).alias("dropped_hole_rows"),
    )


def failure_records(rows: DataFrame, triangles: DataFrame, layer: str, key: str = "gid") -> DataFrame:
    """What a log has of each feature that gave no triangles: layer, key, geom_type, parts, holes, points, error."""
    said = rows.select(key, geometry.profile(F.col("parts")).alias("p"), F.size(F.flatten(F.flatten("parts"))).alias("points"))
    failed = triangles.where("error is not null").select(F.col(key).alias("__of"), "error")
    kind = F.when(F.col("p.parts") == 1, "Polygon").otherwise("MultiPolygon")
    return said.join(failed, F.col(key) == F.col("__of")).select(F.lit(layer).alias("layer"), key, kind.alias("geom_type"), F.col("p.parts").alias("parts"), F.col("p.holes").alias("holes"), "points", "error")


def write_failures(records: DataFrame, folder: str) -> int:
    """Writes failure records as lines of JSON to a new folder, and says how many there are."""
    records.write.mode("errorifexists").json(folder)
    return records.sparkSession.read.schema(records.schema).json(folder).count()


def batch_perplexity(codes: DataFrame, batch: str) -> DataFrame:
    """Of each level: batches, the mean of their perplexities, and the perplexity of all codes together; codes(level, code, batch)."""

    def perplexity(counts: DataFrame, *by: str) -> DataFrame:
        # exp of the entropy: log n minus the mean of log uses.
        n = F.sum("uses")
        return counts.groupBy(*by).agg(F.exp(F.log(n) - F.sum(F.col("uses") * F.log("uses")) / n).alias("perplexity"))

    counts = codes.groupBy("level", F.col(batch).alias("batch"), "code").agg(F.count("*").alias("uses"))
    each = perplexity(counts, "level", "batch").groupBy("level").agg(F.count("*").alias("batches"), F.avg("perplexity").alias("batch_mean"))
    return each.join(perplexity(counts.groupBy("level", "code").agg(F.sum("uses").alias("uses")), "level").withColumnRenamed("perplexity", "overall"), "level")


def in_number_order(files: DataFrame, path: str = "path") -> DataFrame:
    """Files ordered by the last number in their names; names without one come last, by name."""
    number = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"(\d+)\D*$", 1).try_cast("decimal(38,0)")
    return files.orderBy(number.asc_nulls_last(), path)


def display_width(text: Column) -> Column:
    """The columns that a text takes on a terminal, line ends aside: two for wide and full-width characters; 0 for null."""

    @F.pandas_udf("int")
    def width(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in t if c not in "\r\n"))

    return width(text.cast("string"))


def padded(text: Column, width: int) -> Column:
    """The text without line ends, filled up with blanks to a display width."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\r\n", "")
    return F.concat(plain, F.repeat(F.lit(" "), F.greatest(F.lit(width) - display_width(plain), F.lit(0))))
