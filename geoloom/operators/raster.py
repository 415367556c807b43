"""Occupancy: which points lie in triangles, and how well predicted images match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.fourier import triangle_blocks

SMOOTH = 1e-6
#: Triangles or polygons times points that a task works on at once.
MOST_CELLS = 1_000_000


def in_triangle(x: Column, y: Column) -> Column:
    """Whether a point lies in the triangle ax..cy or on its edge."""
    ax, ay, bx, by, cx, cy = (F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))
    d1 = (x - bx) * (ay - by) - (ax - bx) * (y - by)
    d2 = (x - cx) * (by - cy) - (bx - cx) * (y - cy)
    d3 = (x - ax) * (cy - ay) - (cx - ax) * (y - ay)
    return ~(((d1 < 0) | (d2 < 0) | (d3 < 0)) & ((d1 > 0) | (d2 > 0) | (d3 > 0)))


def _held(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie in which of the triangles t[n, 6], as in_triangle has it: [n, points]."""
    ax, ay, bx, by, cx, cy = (t[:, i, None] for i in range(6))
    low, high = np.zeros((len(t), len(x)), bool), np.zeros((len(t), len(x)), bool)
    for px, py, qx, qy in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)):
        d = (x - qx) * (py - qy) - (px - qx) * (y - qy)
        low |= d < 0
        # Spark counts NaN as above all numbers.
        high |= ~(d <= 0)
    return ~(low & high)


def occupied(triangles: DataFrame, points: DataFrame, key: str = "gid", most_cells: int = MOST_CELLS) -> DataFrame:
    """Points (py, px, x, y) of each polygon with 1 inside and 0 outside: key, py, px, occupied; null where no triangle is whole.

    The grid is small and goes to every task. Triangles of a polygon meet in
    one row, and a task works through rows by about most_cells triangles or
    polygons times points, so that no cells are shuffled or gathered. Only
    polygons of several blocks are combined after that.
    """
    grid = points.select("py", "px", "x", "y").toPandas()
    x, y = grid["x"].to_numpy(float), grid["y"].to_numpy(float)
    step = max(1, most_cells // max(1, len(grid)))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), step):
                some = pdf.iloc[i : i + step]
                counts = np.array([len(t) // 6 for t in some["t"]], np.int64)
                t, owner = np.concatenate([np.asarray(t, float) for t in some["t"]]).reshape(-1, 6), np.repeat(np.arange(len(some)), counts)
                inside = np.zeros((len(some), len(grid)), bool)
                for j in range(0, len(t), step):
                    own = owner[j : j + step]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    # A polygon may go on in the next step.
                    inside[own[first]] |= np.logical_or.reduceat(_held(t[j : j + step], x, y), first, axis=0)
                made = pd.Series(inside.ravel(), dtype="Int32")
                made[np.repeat(counts == 0, len(grid))] = pd.NA
                yield pd.DataFrame({"k": some["k"].repeat(len(grid)).array, "py": np.tile(grid["py"], len(some)), "px": np.tile(grid["px"], len(some)), "occupied": made})

    blocks = triangle_blocks(triangles, key)
    kind = blocks.schema["k"].dataType.simpleString()
    each = blocks.select("k", "t").mapInPandas(fill, f"k {kind}, py int, px int, occupied int").withColumnRenamed("k", key)
    if blocks.where("b > 0").isEmpty():
        return each
    return each.groupBy(key, "py", "px").agg(F.max("occupied").alias("occupied"))


def labelled_points(points: DataFrame, triangles: DataFrame, key: str = "gid") -> DataFrame:
    """points(key, point_no, x, y) with occupied: whether any triangle of their polygon holds them."""
    return points.join(triangles, key).groupBy(key, "point_no", "x", "y").agg(F.max(in_triangle(F.col("x"), F.col("y")).cast("int")).alias("occupied"))


def sampled_points(triangles: DataFrame, near_edges: int, uniform: int, seed: int = 0, spread: float = 0.05, key: str = "gid") -> DataFrame:
    """Points of each polygon: some near the edges of its triangles, the others anywhere in the box; drawn from key, number and seed."""
    draw = lambda k: F.pmod(F.xxhash64(key, "point_no", F.lit(seed), F.lit(k)), F.lit(2**32)) / F.lit(float(2**32))
    held = F.col("tri")
    polygons = triangles.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ax", "ay", "bx", "by", "cx", "cy"))).alias("tris"))
    each = polygons.withColumn("point_no", F.explode(F.sequence(F.lit(0), F.lit(near_edges + uniform - 1))))
    each = each.withColumns({"tri": F.get("tris", F.floor(draw(0) * F.size("tris")).cast("int")), "side": F.floor(draw(1) * 3), "t": draw(2)})
    corner = lambda n, c: F.when(F.col("side") == 0, held[f"{'ab'[n]}{c}"]).when(F.col("side") == 1, held[f"{'bc'[n]}{c}"]).otherwise(held[f"{'ca'[n]}{c}"])
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    # A normal draw from two uniform ones.
    normal = lambda k: F.sqrt(-2 * F.log(1 - draw(k))) * F.cos(2 * F.pi() * draw(k + 1))
    edge = lambda c, k: clip(corner(0, c) * (1 - F.col("t")) + corner(1, c) * F.col("t") + normal(k) * spread)
    place = lambda c, k: F.when(F.col("point_no") < near_edges, edge(c, k)).otherwise(draw(k) * 2 - 1)
    return each.select(key, "point_no", place("x", 3).alias("x"), place("y", 5).alias("y"))


def iou(pairs: DataFrame, key: str, pred: str, target: str, threshold: float = 0.5) -> DataFrame:
    """Of each image the common share of predicted and true cells, smoothed so that two empty images give 1."""
    p, t = (F.col(pred) > threshold).cast("double"), F.col(target).cast("double")
    return pairs.groupBy(key).agg(((F.sum(p * t) + SMOOTH) / (F.sum(p) + F.sum(t) - F.sum(p * t) + SMOOTH)).alias("iou"))


def image_metrics(pairs: DataFrame, key: str, blurred: str, pred: str, target: str, threshold: float = 0.5) -> DataFrame:
    """Of each image: squared error before and after, wrong cells, and cells in doubt (0.1 to 0.9)."""
    p, b, t = F.col(pred), F.col(blurred), F.col(target).cast("double")
    return pairs.groupBy(key).agg(
        F.avg((b - t) * (b - t)).alias("mse_before"), F.avg((p - t) * (p - t)).alias("mse_after"),
        F.count_if((p > threshold) != (t > threshold)).alias("wrong"), F.count_if((p > 0.1) & (p < 0.9)).alias("doubtful"),
    )


def overlap_losses(pairs: DataFrame, key: str, pred: str, target: str) -> DataFrame:
    """Dice and binary cross-entropy losses of each image."""
    p, t = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(pred))), F.col(target).cast("double")
    return pairs.groupBy(key).agg(
        (1 - (2 * F.sum(p * t) + SMOOTH) / (F.sum(p) + F.sum(t) + SMOOTH)).alias("dice_loss"), F.avg(-(t * F.log(p) + (1 - t) * F.log(1 - p))).alias("bce_loss")
    )


def masked_losses(cells: DataFrame, extra: float) -> DataFrame:
    """Weighted magnitude and phase losses over valid cells: cells(mask, weight, pred and true mag, cos, sin)."""
    m = F.col("mask").cast("double")
    mag = F.abs(F.col("pred_mag") - F.col("true_mag"))
    phase = F.abs(F.col("pred_cos") - F.col("true_cos")) + F.abs(F.col("pred_sin") - F.col("true_sin"))
    d = F.greatest(F.sum(m), F.lit(1.0))
    return cells.agg((F.sum(mag * m) / d + F.lit(extra) * F.sum(mag * F.col("weight") * m) / d).alias("mag_loss"), (F.sum(phase * m) / d).alias("phase_loss"))


def resized(images: DataFrame, size: int, key: str = "gid", value: str = "value") -> DataFrame:
    """Square images (key, py, px, value) at another size, by bilinear weights between pixel centres: key, py, px, value.

    A pixel between cells of which one is missing or null is null. An image
    meets in one row; a task enlarges some of about MOST_CELLS pixels at once.
    """
    # Dealt by image before they are gathered, so that no task gathers more than its share.
    cells = images.select(F.col(key).alias("k"), F.col("py").cast("int").alias("y"), F.col("px").cast("int").alias("x"), F.col(value).cast("double").alias("v")).repartition("k")
    met = cells.groupBy("k").agg((F.max("x") + 1).alias("w"), F.collect_list(F.struct("y", "x", "v")).alias("c")).where("w > 0").select("k", "w", "c.y", "c.x", "c.v")
    py, px = np.divmod(np.arange(size * size, dtype=np.int32), size)

    def enlarge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, same in pdf.groupby("w"):
                at = np.clip((np.arange(size) + 0.5) * w / size - 0.5, 0.0, w - 1.0)
                low = np.floor(at).astype(int)
                high, part = np.minimum(low + 1, w - 1), at - low
                step = max(1, MOST_CELLS // max(w * w, size * size))
                for i in range(0, len(same), step):
                    some = same.iloc[i : i + step]
                    own = np.repeat(np.arange(len(some)), [len(y) for y in some["y"]])
                    y, x, v = (np.concatenate([np.asarray(c, kind) for c in some[name]]) for name, kind in (("y", int), ("x", int), ("v", float)))
                    fits = (y >= 0) & (y < w) & (x >= 0)
                    old = np.full((len(some), w, w), np.nan)
                    old[own[fits], y[fits], x[fits]] = v[fits]
                    row = lambda n: old[:, n][:, :, low] * (1 - part) + old[:, n][:, :, high] * part  # noqa: E731, B023
                    new = row(low) * (1 - part)[:, None] + row(high) * part[:, None]
                    yield pd.DataFrame({"k": some["k"].repeat(size * size).array, "py": np.tile(py, len(some)), "px": np.tile(px, len(some)), "value": new.ravel()})

    kind = met.schema["k"].dataType.simpleString()
    return met.mapInPandas(enlarge, f"k {kind}, py int, px int, value double").select(F.col("k").alias(key), "py", "px", F.nanvl("value", F.lit(None)).alias("value"))
