"""How many boxes overlap each of many others, without their pairs.

Of the boxes that begin before a query ends, those that end before it begins
are taken away, on both axes: four counts of corners that lie below and left
of a point. Each axis is cut into slabs. Corners in lower slabs on both axes
are counted by a table of slabs; those in the point's own slab on either axis
by one task for each slab, where corners are sorted and never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes of a slab, slabs of an axis at most, and boxes that slabs are made from, about.
IN_SLAB, MOST_SLABS, SAMPLE = 20_000, 512, 20_000
#: The corners of a box, those of a query that they must lie below, and the sign of the count.
CORNERS = ((("x0", "y0"), ("x1", "y1"), 1), (("x1", "y0"), ("x0", "y1"), -1), (("x0", "y1"), ("x1", "y0"), -1), (("x1", "y1"), ("x0", "y0"), 1))


def below(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """How many points lie left of and below each query, borders not included: sorted blocks of 1, 2, 4... points by x, of which a query takes those that make up its share."""
    order = np.argsort(px, kind="stable")
    n, out = len(px), np.zeros(len(qx), np.int64)
    share, level = np.searchsorted(px[order], qx), 0
    up = np.argsort(py, kind="stable")
    rank = np.empty(n, np.int64)
    rank[up] = np.arange(n)
    least, rank = np.searchsorted(py[up], qy), rank[order]
    while n >> level:
        block = (share >> level) - 1
        takes = np.flatnonzero((share >> level) & 1)
        if len(takes):
            keys = np.sort((np.arange(n) >> level) * n + rank)
            out[takes] += np.searchsorted(keys, block[takes] * n + least[takes]) - (block[takes] << level)
        level += 1
    return out


def _slabs(given: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where slabs of both axes begin, by a sample that reaches the driver, drawn by a hash and the same in every run."""
    n = given.count()
    dice = F.pmod("h", F.lit(2**40)) / F.lit(float(2**40))
    drawn = given.where(dice < SAMPLE / max(1, n)).limit(4 * SAMPLE).toPandas()
    many = int(min(MOST_SLABS, n // IN_SLAB + 1))
    cut = lambda *c: (v := np.sort(np.concatenate([drawn[x].to_numpy(float) for x in c])))[[len(v) * k // many for k in range(1, many)]] if len(drawn) else np.zeros(0)
    return cut("x0", "x1"), cut("y0", "y1")


def _dealt(values: np.ndarray, bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The slab of each value; a value that is the bound of several is dealt over them by h."""
    low, high = np.searchsorted(bounds, values, "left"), np.searchsorted(bounds, values, "right")
    return low + h % (high - low + 1)


def counts(asked: DataFrame, given: DataFrame) -> DataFrame:
    """How many boxes given(h, x0, y0, x1, y1) overlap each of asked(key, x0, y0, x1, y1), which have an extent on both axes: key, hits. h is a hash of the box's id."""
    bx, by = _slabs(given)
    nx, ny = len(bx) + 1, len(by) + 1
    kind = asked.schema["key"].dataType.simpleString()

    def placed(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        h = pdf["h"].to_numpy(np.int64)
        for k, ((cx, cy), _, _) in enumerate(CORNERS):
            x, y = pdf[cx].to_numpy(float), pdf[cy].to_numpy(float)
            yield k, x, y, _dealt(x, bx, h & 0xFFFFF), _dealt(y, by, (h >> 20) & 0xFFFFF)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(len(CORNERS) * nx * ny, np.int64)
        for pdf in batches:
            for k, _, _, sx, sy in placed(pdf):
                table += np.bincount((k * nx + sx) * ny + sy, minlength=len(table))
        some = np.flatnonzero(table)
        yield pd.DataFrame({"cell": some, "n": table[some]})

    # At most len(CORNERS) * MOST_SLABS ** 2 rows, whatever the number of boxes.
    cells = given.mapInPandas(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(len(CORNERS) * nx * ny, np.int64)
    table[cells["cell"]] = cells["n"]
    lower = np.zeros((len(CORNERS), nx + 1, ny + 1), np.int64)
    lower[:, 1:, 1:] = table.reshape(-1, nx, ny).cumsum(1).cumsum(2)
    group = lambda k, axis, slab: (slab * len(CORNERS) + k) * 2 + axis

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, x, y, sx, sy in placed(pdf):
                yield pd.DataFrame({"g": group(k, 0, sx).astype(np.int32), "x": x, "y": y})
                yield pd.DataFrame({"g": group(k, 1, sy).astype(np.int32), "x": sx.astype(float), "y": y})

    def limits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, (_, (cx, cy), sign) in enumerate(CORNERS):
                x, y = pdf[cx].to_numpy(float), pdf[cy].to_numpy(float)
                # A box has ended where its end is at the query's beginning, too.
                x, y = np.nextafter(x, np.inf) if cx == "x0" else x, np.nextafter(y, np.inf) if cy == "y0" else y
                sx, sy = np.searchsorted(bx, x), np.searchsorted(by, y)
                yield pd.DataFrame({"key": pdf["key"], "g": group(k, 0, sx).astype(np.int32), "x": x, "y": y, "sign": sign, "base": sign * lower[k, sx, sy]})
                yield pd.DataFrame({"key": pdf["key"], "g": group(k, 1, sy).astype(np.int32), "x": sx.astype(float), "y": y, "sign": sign, "base": 0})

    def local(points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = below(*(d[c].to_numpy(float) for d in (points, wanted) for c in ("x", "y")))
        return pd.DataFrame({"key": wanted["key"], "n": wanted["base"] + wanted["sign"] * found})

    points = given.mapInPandas(corners, "g int, x double, y double").groupBy("g")
    wanted = asked.mapInPandas(limits, f"key {kind}, g int, x double, y double, sign int, base long").groupBy("g")
    return points.cogroup(wanted).applyInPandas(local, f"key {kind}, n long").groupBy("key").agg(F.sum("n").alias("hits"))
