"""Closed-form Fourier transforms of triangles, their sums over polygons, and the way back to a raster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.columns import from_channels, to_channels
from geoloom.operators.lineage import written

#: Below this a phase counts as zero.
EPSILON = 1e-6
#: Triangles of a polygon that meet in one row.
BLOCK = 65_536
#: Triangles or polygons times frequencies that a task works on at once: a dozen arrays of 16 bytes a cell.
MOST_CELLS = 250_000


def frequencies(least: float, most: float, n: int, geometric: bool = True) -> list[float]:
    """n positive frequencies, by equal ratios or equal steps."""
    if n == 1:
        return [least]
    if geometric:
        return [least * (most / least) ** (k / (n - 1)) for k in range(n)]
    return [least + (most - least) * k / (n - 1) for k in range(n)]


def frequency_grid(spark: SparkSession, positive: list[float], stride: int = 1) -> DataFrame:
    """All pairs of a full axis u and a half axis v: u_idx, v_idx, u, v, du, dv, valid.

    du and dv are the spans that a frequency stands for: half the way between
    its neighbours, or the way to the only one. Both axes are padded to
    multiples of stride by places that are not valid.
    """
    us, vs = [-w for w in reversed(positive)] + [0.0, *positive], [0.0, *positive]

    def axis(values: list[float], name: str) -> DataFrame:
        padded = values + [None] * (-len(values) % stride)
        rows = spark.createDataFrame(list(enumerate(padded)), f"{name}_idx int, {name} double")
        order = Window.orderBy(f"{name}_idx")
        known = F.col(name).isNotNull()
        before, after = F.lag(name).over(order), F.lead(name).over(order)
        span = F.when(known, F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(F.coalesce(after - F.col(name), F.col(name) - before, F.lit(1.0))))
        return rows.withColumn(f"d{name}", span)

    grid = axis(us, "u").join(axis(vs, "v"))
    return grid.withColumn("valid", F.col("u").isNotNull() & F.col("v").isNotNull())


def _triangle_transforms(t: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The transforms of triangles t[n, 6] at points (u, v): [n, points]."""
    ax, ay, bx, by, cx, cy = (t[:, i, None] for i in range(6))
    twice = np.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
    a, b = u * (bx - ax) + v * (by - ay), u * (cx - bx) + v * (cy - by)
    none_a, none_b, none_c = np.abs(a) <= EPSILON, np.abs(b) <= EPSILON, np.abs(a + b) <= EPSILON
    ea, eb, eab = (np.exp(-2j * np.pi * x) for x in (a, b, a + b))
    one, k = 2j * np.pi, (2 * np.pi) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        general = (-a * eab + (a + b) * ea - b) / (k * a * b * (a + b))
        along_c = -(ea - 1 + one * a) / (k * a * a)
        along_a = -(eb - 1 + one * b) / (k * b * b)
        along_b = (ea + one * a * ea - 1) / (k * a * a)
    value = np.select([none_a & none_b, none_c, none_a, none_b], [0.5 + 0j, along_c, along_a, along_b], general)
    value = np.where(none_a & none_b, value, value * np.exp(-2j * np.pi * (u * ax + v * ay)))
    return twice * value


def _summed(t: np.ndarray, counts: np.ndarray, u: np.ndarray, v: np.ndarray, step: int) -> np.ndarray:
    """The transforms of polygons whose triangles t lie end to end, `counts` to each: [polygons, points], step triangles at a time."""
    out, owner = np.zeros((len(counts), len(u)), complex), np.repeat(np.arange(len(counts)), counts)
    for i in range(0, len(t), step):
        own = owner[i : i + step]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        # A polygon may go on in the next step.
        out[own[first]] += np.add.reduceat(_triangle_transforms(t[i : i + step], u, v), first, axis=0)
    return out


def triangle_blocks(triangles: DataFrame, key: str = "gid", block: int = BLOCK) -> DataFrame:
    """Triangles(key, ax..cy) as rows of up to `block` of a polygon, by tri_no where there is one: k, b, t, the corners end to end. A triangle with a missing corner is in none of them."""
    corners = F.array(*[F.col(c).cast("double") for c in ("ax", "ay", "bx", "by", "cx", "cy")])
    whole = F.when(F.forall(corners, lambda c: c.isNotNull()), corners)
    numbered = triangles.withColumn("__block", F.floor(F.col("tri_no") / block) if "tri_no" in triangles.columns else F.lit(0).cast("long"))
    # Triangles may be costly to come by, and the blocks are looked at twice.
    return written(numbered.groupBy(F.col(key).alias("k"), F.coalesce("__block", F.lit(0)).alias("b")).agg(F.flatten(F.collect_list(whole)).alias("t")), "polygon-blocks")


def spectra(triangles: DataFrame, grid: DataFrame, key: str = "gid", most_cells: int = MOST_CELLS, block: int = BLOCK) -> DataFrame:
    """The transform of each polygon, the sum over its triangles: key, u_idx, v_idx, re, im. Padding is left out.

    Blocks of a polygon's triangles meet in one row, by tri_no where there is
    one; a task works through a batch of rows in array operations of about
    most_cells triangles times frequencies. Only polygons of several blocks are
    summed up after that. The grid, small by construction, is the only thing
    that goes to every task.
    """
    cells = grid.where("valid").select("u_idx", "v_idx", "u", "v").orderBy("u_idx", "v_idx").toPandas()
    u, v = cells["u"].to_numpy(float), cells["v"].to_numpy(float)
    step = max(1, most_cells // max(1, len(cells)))

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), step):
                some = pdf.iloc[i : i + step]
                n, counts = len(some), np.array([len(t) // 6 for t in some["t"]], np.int64)
                s = _summed(np.concatenate([np.asarray(t, float) for t in some["t"]]).reshape(-1, 6), counts, u, v, step)
                yield pd.DataFrame({"k": some["k"].repeat(len(u)).array, "u_idx": np.tile(cells["u_idx"], n), "v_idx": np.tile(cells["v_idx"], n), "re": s.real.ravel(), "im": s.imag.ravel()})

    polygons = triangle_blocks(triangles.where("ax is not null"), key, block)
    kind = polygons.schema["k"].dataType.simpleString()
    made = polygons.select("k", "t").mapInPandas(transform, f"k {kind}, u_idx int, v_idx int, re double, im double").withColumnRenamed("k", key)
    if polygons.where("b > 0").isEmpty():
        return made
    return made.groupBy(key, "u_idx", "v_idx").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def channels(spectrum: DataFrame) -> DataFrame:
    return spectrum.withColumn("c", to_channels(F.col("re"), F.col("im"))).select(*[c for c in spectrum.columns if c not in ("re", "im")], "c.*")


def from_image(image: DataFrame) -> DataFrame:
    """channels(mag, cos, sin) back to re and im."""
    return image.withColumn("c", from_channels(F.col("mag"), F.col("cos"), F.col("sin"))).select(*[c for c in image.columns if c not in ("mag", "cos", "sin")], "c.*")


def pixels(spark: SparkSession, size: int) -> DataFrame:
    """size * size points: x from -1 to 1, y from 1 to -1, both ends included."""
    at = lambda i: F.lit(-1.0) + 2.0 * i / F.lit(float(max(1, size - 1)))
    return spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("py"), F.pmod("id", F.lit(size)).cast("int").alias("px")).select("py", "px", at(F.col("px")).alias("x"), (-at(F.col("py"))).alias("y"))


def rasters(spectrum: DataFrame, grid: DataFrame, size: int, key: str = "gid") -> DataFrame:
    """Each polygon's transform back as an image of values from 0 to 1: key, py, px, value.

    The way back is separable: two matrix products for a batch of polygons,
    each of whose spectra meets in one row. The grid goes to every task.
    """
    axes = grid.where("valid").select("u_idx", "v_idx", "u", "v", "du", "dv").toPandas()
    us, vs = axes.drop_duplicates("u_idx").sort_values("u_idx"), axes.drop_duplicates("v_idx").sort_values("v_idx")
    row_of, column_of = (np.zeros(x[c].max() + 1, np.int64) for x, c in ((us, "u_idx"), (vs, "v_idx")))
    row_of[us["u_idx"]], column_of[vs["v_idx"]] = np.arange(len(us)), np.arange(len(vs))
    at = -1 + 2 * np.arange(size) / max(1, size - 1)
    along_x = np.exp(2j * np.pi * np.outer(us["u"], at)) * us["du"].to_numpy()[:, None]
    along_y = np.exp(2j * np.pi * np.outer(vs["v"], -at)) * (vs["dv"] * np.where(vs["v"] > 1e-6, 2.0, 1.0)).to_numpy()[:, None]
    py, px = np.divmod(np.arange(size * size, dtype=np.int32), size)

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            own = np.repeat(np.arange(n), [len(i) for i in pdf["i"]])
            flat = lambda c: np.concatenate([np.asarray(x) for x in pdf[c]])
            s = np.zeros((n, len(vs), len(us)), complex)
            s[own, column_of[flat("j")], row_of[flat("i")]] = flat("re") + 1j * flat("im")
            f = (along_y.T @ s @ along_x).real.reshape(n, -1)
            low, high = f.min(axis=1, keepdims=True), f.max(axis=1, keepdims=True)
            yield pd.DataFrame({"k": pdf["k"].repeat(size * size).array, "py": np.tile(py, n), "px": np.tile(px, n), "value": ((f - low) / (high - low + 1e-8)).ravel()})

    cells = spectrum.join(F.broadcast(grid.where("valid").select("u_idx", "v_idx")), ["u_idx", "v_idx"], "left_semi")
    met = cells.groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct("u_idx", "v_idx", "re", "im")).alias("c"))
    met = met.select("k", F.col("c.u_idx").alias("i"), F.col("c.v_idx").alias("j"), F.col("c.re").alias("re"), F.col("c.im").alias("im"))
    kind = met.schema["k"].dataType.simpleString()
    return met.mapInPandas(back, f"k {kind}, py int, px int, value double").withColumnRenamed("k", key)


def span_weights(grid: DataFrame) -> DataFrame:
    """The root of each valid cell's span over the mean of all: u_idx, v_idx, weight."""
    cells = grid.where("valid").withColumn("root", F.sqrt(F.col("du") * F.col("dv")))
    return cells.select("u_idx", "v_idx", (F.col("root") / (F.avg("root").over(Window.partitionBy(F.lit(1))) + 1e-8)).alias("weight"))
