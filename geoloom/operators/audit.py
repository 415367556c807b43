"""Cell by cell comparison of original rows with rows decoded from their encoded form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.columns import from_limbs, limbs, row_cells, row_text


def encoded(rows: DataFrame, layer: str, key: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """key, layer, limbs of the number columns and one line with the text columns."""
    return rows.select(F.col(key), F.lit(layer).alias("layer"), F.array(*[limbs(F.col(c).cast("double")) for c in numbers]).alias("nums"), row_text(F.lit(layer), [F.col(c) for c in texts]).alias("line"))


def compared(rows: DataFrame, coded: DataFrame, layer: str, key: str, numbers: list[str], texts: list[str], tolerance: float = 1e-6, exact_space: bool = False) -> DataFrame:
    """One row for each of rows that is in coded: key, layer, cells (an array of column, kind, hit).

    Numbers agree within the tolerance, null standing for 0; texts agree
    without white space, null standing for an empty one, or as trimmed if
    exact_space.
    """
    back = coded.select(F.col(key).alias("__key"), *[from_limbs(F.col("nums")[i]).alias(f"__n{i}") for i in range(len(numbers))], row_cells(F.col("line")).alias("__cells"), F.col("line"))
    both = rows.join(back, F.col(key) == F.col("__key"))
    number = lambda c, i: F.abs(F.round(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), 6) - F.col(f"__n{i}")) <= tolerance
    squeezed = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", "")
    kept = F.split(F.regexp_extract("line", r"(?s)\[DATA\] (.*)$", 1), r" \[SEP\] ")
    text = lambda c, i: (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == F.get(kept, F.lit(i))) if exact_space else squeezed(c) == F.get(F.col("__cells"), F.lit(i))
    found = [F.struct(F.lit(c).alias("column"), F.lit("number").alias("kind"), F.coalesce(number(c, i), F.lit(False)).alias("hit")) for i, c in enumerate(numbers)]
    found += [F.struct(F.lit(c).alias("column"), F.lit("text").alias("kind"), F.coalesce(text(c, i), F.lit(False)).alias("hit")) for i, c in enumerate(texts)]
    return both.select(F.col(key).alias("key"), F.lit(layer).alias("layer"), F.array(*found).alias("cells"))


def cells(rows: DataFrame, coded: DataFrame, layer: str, key: str, numbers: list[str], texts: list[str], tolerance: float = 1e-6, exact_space: bool = False) -> DataFrame:
    """As `compared`, one row for each cell: key, layer, column, kind, hit."""
    return compared(rows, coded, layer, key, numbers, texts, tolerance, exact_space).select("key", "layer", F.explode("cells").alias("c")).select("key", "layer", "c.*")


def totals(parts: list[DataFrame]) -> DataFrame:
    """Of each layer: hits and misses of numbers, texts and whole rows, and the columns with misses; `compared` rows meet in one aggregate by layer."""
    every = reduce(DataFrame.unionByName, parts)
    count = lambda kind, hit: F.sum(F.size(F.filter("cells", lambda c: (c["kind"] == kind) & (c["hit"] == hit)))).cast("long")
    bad = F.transform(F.filter("cells", lambda c: ~c["hit"]), lambda c: c["column"])
    return every.withColumn("bad", bad).groupBy("layer").agg(
        *[count(k, h).alias(f"{k}_{n}") for k in ("number", "text") for n, h in (("hits", True), ("misses", False))],
        F.count_if(F.size("bad") == 0).alias("row_hits"), F.count_if(F.size("bad") > 0).alias("row_misses"),
        # A set of columns for each set of bad columns that rows have.
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("bad")))), ",").alias("bad_columns"),
    )
