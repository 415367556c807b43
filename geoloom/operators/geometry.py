"""Polygons as arrays of rings: cleaning, profiles, filters, triangles.

A row is one feature: gid and parts, an array of polygons; a polygon is an
array of rings, the shell first and then holes; a ring is an array of points
(x, y) that need not be closed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.delaunay import triangulated

PARTS = "array<array<array<struct<x:double,y:double>>>>"
TRIANGLE = ("ax", "ay", "bx", "by", "cx", "cy")
#: Two points nearer than this are one.
SAME_POINT = 1e-12
LEAST_AREA, LEAST_HEIGHT = 1e-8, 1e-5
#: A feature beyond any of these is risky: parts, points and holes of a part, shortest edge.
SAFE_PARTS, SAFE_NODES, SAFE_HOLES, SAFE_EDGE = 1, 2048, 1, 1e-5


def clean_ring(ring: Column) -> Column:
    """The ring without points that are the same as the one before them, and without a last point that closes it."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= SAME_POINT) & (F.abs(p["y"] - q["y"]) <= SAME_POINT)
    kept = F.filter(ring, lambda p, i: (i == 0) | ~near(p, F.get(ring, F.greatest(i - 1, F.lit(0)))))
    closed = (F.size(kept) > 1) & near(F.get(kept, F.lit(0)), F.get(kept, F.size(kept) - 1))
    return F.when(closed, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)


def coordinates(parts: Column, axis: str) -> Column:
    return F.transform(F.flatten(F.flatten(parts)), lambda p: p[axis])


def frame(parts: Column) -> Column:
    """Centre and half side of the box round all points of a feature."""
    xs, ys = coordinates(parts, "x"), coordinates(parts, "y")
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (F.greatest(x1 - x0, y1 - y0) / 2).alias("half"), (x1 - x0).alias("lx"), (y1 - y0).alias("ly"))


def normalised(rows: DataFrame, norm_max: float = 1.0) -> DataFrame:
    """rows(gid, parts) moved and scaled so that the box of the whole feature is norm_max round the origin; points-like features go."""
    framed = rows.withColumn("__f", frame(F.col("parts"))).where(F.col("__f.half") >= SAME_POINT)
    move = lambda p: F.struct(((p["x"] - F.col("__f.cx")) / F.col("__f.half") * norm_max).alias("x"), ((p["y"] - F.col("__f.cy")) / F.col("__f.half") * norm_max).alias("y"))
    return framed.withColumn("parts", F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, move)))).drop("__f")


def row_meta(parts: Column) -> Column:
    """Centre, longer side, both sides, and how many points the rings have."""
    f = frame(parts)
    return F.struct(f["cx"].alias("cx"), f["cy"].alias("cy"), F.greatest(f["lx"], f["ly"]).alias("l"), f["lx"].alias("lx"), f["ly"].alias("ly"), F.size(F.flatten(F.flatten(parts))).alias("n"))


def profile(parts: Column) -> Column:
    """Parts, holes in all, most holes of a part, parts with holes."""
    holes = F.transform(parts, lambda part: F.size(part) - 1)
    return F.struct(F.size(parts).alias("parts"), F.aggregate(holes, F.lit(0), lambda s, h: s + h).alias("holes"), F.coalesce(F.array_max(holes), F.lit(0)).alias("most_holes"), F.size(F.filter(holes, lambda h: h > 0)).alias("parts_with_holes"))


def ring_edges(ring: Column) -> Column:
    """Lengths of the ring's edges, the closing one included."""
    return F.transform(ring, lambda p, i: F.hypot(F.get(ring, F.pmod(i + 1, F.size(ring)))["x"] - p["x"], F.get(ring, F.pmod(i + 1, F.size(ring)))["y"] - p["y"]))


def shortest_edge(part: Column) -> Column:
    return F.array_min(F.transform(part, lambda ring: F.array_min(ring_edges(ring))))


def is_risky(parts: Column, safe_parts: int = SAFE_PARTS, nodes: int = SAFE_NODES, holes: int = SAFE_HOLES, edge: float = SAFE_EDGE) -> Column:
    """Whether a feature is better worked on apart from others."""
    return (F.size(parts) > safe_parts) | F.exists(parts, lambda p: (F.size(F.flatten(p)) > nodes) | (F.size(p) - 1 > holes) | (shortest_edge(p) < edge))


def ring_area(ring: Column) -> Column:
    """The signed area inside a ring."""
    after = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    return F.aggregate(F.transform(ring, lambda p, i: p["x"] * after(i)["y"] - after(i)["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x) / 2


def polygon_area(parts: Column) -> Column:
    """The area of the shells without their holes."""
    one = lambda part: F.aggregate(F.transform(part, lambda ring, i: F.when(i == 0, F.abs(ring_area(ring))).otherwise(-F.abs(ring_area(ring)))), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(parts, one), F.lit(0.0), lambda s, x: s + x)


def triangle_area(prefix: str = "") -> Column:
    ax, ay, bx, by, cx, cy = (F.col(prefix + c) for c in TRIANGLE)
    return F.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2


def longest_edge() -> Column:
    ax, ay, bx, by, cx, cy = (F.col(c) for c in TRIANGLE)
    return F.greatest(F.hypot(bx - ax, by - ay), F.hypot(cx - bx, cy - by), F.hypot(ax - cx, ay - cy))


def triangle_fault(area: float = LEAST_AREA, height: float = LEAST_HEIGHT) -> Column:
    """Why a triangle is degenerate: 'area', else 'height', else null."""
    return F.when(triangle_area() < area, "area").when(2 * triangle_area() / F.greatest(longest_edge(), F.lit(1e-12)) < height, "height")


def fault_counts(triangles: DataFrame, key: str = "gid", area: float = LEAST_AREA, height: float = LEAST_HEIGHT) -> DataFrame:
    """Of each feature: triangles kept, and dropped for each reason."""
    return triangles.withColumn("f", triangle_fault(area, height)).groupBy(key).agg(F.count_if(F.col("f").isNull()).alias("kept"), F.count_if(F.col("f") == "area").alias("small_area"), F.count_if(F.col("f") == "height").alias("small_height"))


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _edges(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ring, np.roll(ring, -1, axis=0)


def _overlapping(low: np.ndarray, high: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the intervals low to high that overlap, by a sweep over their lower ends; about `most` pairs at a time."""
    order = np.argsort(low, kind="stable")
    ends = np.searchsorted(low[order], high[order], side="right")
    count = ends - np.arange(len(low)) - 1
    upto = np.concatenate([[0], np.cumsum(count)])
    first = 0
    while first < len(low):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + most, side="right")) - 1)
        n = count[first:last]
        i = np.repeat(np.arange(first, last), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield order[i], order[j]
        first = last


def _crossings(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of edges whose boxes overlap, with the product of the sides that the ends of each lie on of the other."""
    low, high = np.minimum(starts, ends), np.maximum(starts, ends)
    side = lambda p, q, t: (q[:, 0] - p[:, 0]) * (t[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (t[:, 0] - p[:, 0])
    for i, j in _overlapping(low[:, 0], high[:, 0]):
        both = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        i, j = i[both], j[both]
        p, q, r, s = starts[i], ends[i], starts[j], ends[j]
        yield i, j, side(p, q, r) * side(p, q, s), side(r, s, p) * side(r, s, q)


def _edges_meet(shell: np.ndarray, holes: list[np.ndarray]) -> bool:
    """Whether an edge of the shell meets an edge of a hole."""
    starts, ends = (np.concatenate(x) for x in zip(*map(_edges, [shell, *holes]), strict=True))
    in_shell = np.arange(len(starts)) < len(shell)
    return any(((in_shell[i] != in_shell[j]) & (d <= 0) & (e <= 0)).any() for i, j, d, e in _crossings(starts, ends))


def _self_crossing(ring: np.ndarray) -> bool:
    """Whether two edges cross within both; edges that share a corner do not."""
    return any(((d < 0) & (e < 0)).any() for _, _, d, e in _crossings(*_edges(ring)))


def part_fault(rings: list[np.ndarray]) -> str | None:
    """Why a polygon is left out before it is cut up: empty, invalid, or a hole that meets the shell."""
    if not rings or len(rings[0]) < 3 or abs(_signed_area(rings[0])) == 0.0:
        return "empty"
    if any(len(r) < 3 or _self_crossing(r) for r in rings):
        return "invalid"
    if rings[1:] and _edges_meet(rings[0], rings[1:]):
        return "touching"
    return None


def _with_bridges(rings: list[np.ndarray]) -> np.ndarray:
    """One ring that goes to each hole and back over a bridge: shell against, holes with the clock."""
    shell = rings[0] if _signed_area(rings[0]) > 0 else rings[0][::-1]
    for hole in sorted((h if _signed_area(h) < 0 else h[::-1] for h in rings[1:]), key=lambda h: -h[:, 0].max()):
        start = int(hole[:, 0].argmax())
        hole = np.roll(hole, -start, axis=0)
        point = hole[0]
        # Bridges go to the right, where nothing of this hole is; holes further right are in the ring already.
        right = np.flatnonzero(shell[:, 0] >= point[0])
        order = right[np.argsort(((shell[right] - point) ** 2).sum(axis=1), kind="stable")] if len(right) else np.argsort(((shell - point) ** 2).sum(axis=1))
        free = next((int(k) for k in order if not _blocked(point, shell[k], shell, hole)), int(order[0]))
        shell = np.concatenate([shell[: free + 1], hole, hole[:1], shell[free:]])
    return shell


def _blocked(a: np.ndarray, b: np.ndarray, *rings: np.ndarray) -> bool:
    """Whether the line from a to b properly crosses an edge."""
    for ring in rings:
        c, d = ring, np.roll(ring, -1, axis=0)
        side = lambda o, p, q: (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])
        if ((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any():
            return True
    return False


def cut_into_triangles(rings: list[np.ndarray]) -> np.ndarray:
    """Triangles [n, 3, 2] that cover the polygon, by cutting off ears; raises ValueError if no ear is left."""
    ring = list(map(tuple, _with_bridges(rings)))
    out = []
    while len(ring) > 3:
        n, points = len(ring), np.array(ring)
        for i in range(n):
            a, b, c = points[i - 1], points[i], points[(i + 1) % n]
            if _cross(a, b, c) <= 0:
                continue
            inside = np.ones(n, bool)
            for p, q in ((a, b), (b, c), (c, a)):
                inside &= (q[0] - p[0]) * (points[:, 1] - p[1]) - (q[1] - p[1]) * (points[:, 0] - p[0]) >= 0
            # Bridges repeat corners: equal points do not spoil an ear.
            same = (points == a).all(1) | (points == b).all(1) | (points == c).all(1)
            if not (inside & ~same).any():
                out.append([ring[i - 1], ring[i], ring[(i + 1) % n]])
                del ring[i]
                break
        else:
            flat = [i for i in range(n) if abs(_cross(points[i - 1], points[i], points[(i + 1) % n])) <= 1e-15]
            if not flat:
                raise ValueError("no ear left")
            del ring[flat[0]]
    out.append(ring)
    return np.array(out, float)


def triangles_of(rings: list[np.ndarray]) -> np.ndarray:
    """Delaunay triangles with the rings as fixed edges; where the sweep does not take the rings, ears are cut off. Raises ValueError if these do not make up the polygon either."""
    try:
        return triangulated(rings)
    except ValueError:
        made = cut_into_triangles(rings)
    u, v = made[:, 1] - made[:, 0], made[:, 2] - made[:, 0]
    area = abs(_signed_area(rings[0])) - sum(abs(_signed_area(h)) for h in rings[1:])
    if abs(np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2 - area) > 1e-9 * abs(area):
        raise ValueError("rings touch or cross")
    return made


def nested(xs, ys, sizes, rings) -> list[list[np.ndarray]]:
    """Polygons as lists of rings, from all coordinates, points of each ring and rings of each polygon."""
    every = np.split(np.column_stack([xs, ys]).astype(float), np.cumsum(sizes)[:-1].astype(int)) if len(sizes) else []
    ends = np.cumsum(rings).astype(int)
    return [every[a:b] for a, b in zip([0, *ends], ends, strict=False)]


RESULT = "gid long, tri_no int, ax double, ay double, bx double, by double, cx double, cy double, error string"


def triangulate(rows: DataFrame, seconds: float = 20.0) -> DataFrame:
    """Triangles of rows(gid, parts): gid, tri_no, corners, error.

    A feature with any part that cannot be cut up gives one row without corners
    that says why, as does one whose parts are all left out, or one over its
    time. Parts left out for a fault leave the others.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for gid, xs, ys, sizes, rings in zip(pdf["gid"], pdf["xs"], pdf["ys"], pdf["sizes"], pdf["rings"], strict=True):
                began, found, fault = time.monotonic(), [], None
                polygons = nested(xs, ys, sizes, rings)
                faults = [part_fault(p) for p in polygons]
                for polygon in (p for p, f in zip(polygons, faults, strict=True) if f is None):
                    try:
                        found.append(triangles_of(polygon))
                    except ValueError as e:
                        fault = str(e)
                    if time.monotonic() - began > seconds:
                        fault = "timeout"
                        break
                if fault or not found:
                    out.append((gid, None, *[None] * 6, fault or next((f for f in faults if f), "empty")))
                else:
                    out += [(gid, k, *t.ravel(), None) for k, t in enumerate(np.concatenate(found))]
            made = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield made.astype({"gid": "Int64", "tri_no": "Int32", **dict.fromkeys(TRIANGLE, float)})

    cleaned = rows.select(F.col("gid").cast("long").alias("gid"), F.coalesce(F.transform("parts", lambda part: F.transform(part, clean_ring)), F.array().cast(PARTS)).alias("parts"))
    rings = F.flatten("parts")
    flat = cleaned.select("gid", coordinates(F.col("parts"), "x").alias("xs"), coordinates(F.col("parts"), "y").alias("ys"), F.transform(rings, F.size).alias("sizes"), F.transform("parts", F.size).alias("rings"))
    return flat.mapInPandas(cut, RESULT)


def failures(triangles: DataFrame) -> DataFrame:
    """Features that gave no triangles, and why."""
    return triangles.where("error is not null").select("gid", "error")


def quality_counters(rows: DataFrame, triangles: DataFrame) -> DataFrame:
    """One row of sums over a run: features, parts, holes, risky ones, failures, triangles kept and dropped."""
    said = rows.select(profile(F.col("parts")).alias("p"), is_risky(F.col("parts")).alias("risky"))
    shapes = said.agg(F.count("*").alias("rows"), F.sum("p.parts").alias("parts"), F.sum("p.holes").alias("holes"), F.max("p.most_holes").alias("most_holes"), F.sum("p.parts_with_holes").alias("parts_with_holes"), F.count_if("risky").alias("risky_rows"))
    f = triangle_fault()
    pieces = triangles.agg(
        F.count_if(F.col("error").isNotNull()).alias("failed_rows"), F.count_if(F.col("error").isNull() & f.isNull()).alias("triangles"),
        F.count_if(F.col("error").isNull() & (f == "area")).alias("small_area"), F.count_if(F.col("error").isNull() & (f == "height")).alias("small_height"),
    )
    return shapes.join(pieces)


def augmented(triangles: DataFrame, times: int, seed: int = 0, turn: float = 3.141592653589793, scale: float = 0.2, shift: float = 0.1) -> DataFrame:
    """Each feature `times` times: number 0 as it is, the others turned, scaled and moved within the box, drawn from gid, number and seed."""
    draw = lambda k: F.pmod(F.xxhash64("gid", "repeat", F.lit(seed), F.lit(k)), F.lit(2**32)) / F.lit(float(2**32)) * 2 - 1
    each = triangles.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    drawn = each.withColumns({"__a": draw(0) * turn, "__s": 1 + draw(1) * scale, "__x": draw(2) * shift, "__y": draw(3) * shift})
    moved = {}
    for px, py in (("ax", "ay"), ("bx", "by"), ("cx", "cy")):
        moved[px] = F.when(F.col("repeat") == 0, F.col(px)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.cos("__a") * F.col(px) - F.sin("__a") * F.col(py)) * F.col("__s") + F.col("__x"))))
        moved[py] = F.when(F.col("repeat") == 0, F.col(py)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.sin("__a") * F.col(px) + F.cos("__a") * F.col(py)) * F.col("__s") + F.col("__y"))))
    return drawn.select("gid", "repeat", *[c for c in triangles.columns if c not in ("gid", *TRIANGLE)], *[moved[c].alias(c) for c in TRIANGLE])
