"""Constrained Delaunay triangulation of polygons with holes, in NumPy and plain Python for one polygon at a time.

1. A sweep from top to bottom adds diagonals until every face is monotone.
   Holes are joined to what surrounds them on the way; the sweep finds what
   lies left of a corner by bisection.
2. Monotone faces are cut into triangles with a stack.
3. Edges between two triangles are flipped until the circle round each triangle
   has no corner of its neighbours inside. Border edges stay.

Signs of areas and circles are taken in floats where these are certain, and in
fractions elsewhere, so corners on one circle or one line do no harm.
"""

from __future__ import annotations

from bisect import bisect_left
from fractions import Fraction
from math import atan2

import numpy as np

Point = tuple[float, float]


def turn(a: Point, b: Point, c: Point) -> int:
    """1 if a, b, c turn left, -1 if right, 0 on one line; exact."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = left - right
    if abs(d) <= 1e-14 * (abs(left) + abs(right)):
        a, b, c = (tuple(map(Fraction, p)) for p in (a, b, c))
        d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (d > 0) - (d < 0)


def in_circle(a: Point, b: Point, c: Point, d: Point) -> int:
    """1 if d lies inside the circle through a, b, c (turning left), 0 on it, -1 outside; exact."""

    def terms(a, b, c, d):
        (ax, ay), (bx, by), (cx, cy) = ((p[0] - d[0], p[1] - d[1]) for p in (a, b, c))
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return a2 * (bx * cy), -a2 * (by * cx), b2 * (cx * ay), -b2 * (cy * ax), c2 * (ax * by), -c2 * (ay * bx)

    parts = terms(a, b, c, d)
    found = sum(parts)
    if abs(found) <= 1e-13 * sum(map(abs, parts)):
        found = sum(terms(*(tuple(map(Fraction, p)) for p in (a, b, c, d))))
    return (found > 0) - (found < 0)


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _diagonals(points: list[Point], after: list[int], before: list[int]) -> list[tuple[int, int]]:
    """Diagonals that leave monotone faces only. The inside lies left of each edge (i, after[i])."""
    higher = lambda i, k: (-points[i][1], points[i][0]) < (-points[k][1], points[k][0])
    status: list[int] = []  # edges that go down with the inside on their right, from left to right
    helper: dict[int, tuple[int, bool]] = {}
    made: list[tuple[int, int]] = []

    def x_at(e: int, y: float) -> float:
        (x0, y0), (x1, y1) = points[e], points[after[e]]
        return min(x0, x1) if y0 == y1 else x0 + (y - y0) / (y1 - y0) * (x1 - x0)

    def slot(v: int) -> int:
        return bisect_left(status, points[v][0], key=lambda e: x_at(e, points[v][1]))

    def left_of(v: int) -> int:
        k = slot(v)
        # Rounding may put the edge on either side of the corner; corners decide.
        while k < len(status) and turn(points[status[k]], points[after[status[k]]], points[v]) > 0:
            k += 1
        while k and turn(points[status[k - 1]], points[after[status[k - 1]]], points[v]) < 0:
            k -= 1
        if not k:
            raise ValueError("no edge left of a corner")
        return status[k - 1]

    def joined(v: int, e: int) -> None:
        if helper[e][1]:
            made.append((v, helper[e][0]))

    def remove(e: int) -> None:
        status.remove(e)

    def insert(v: int) -> None:
        k = slot(v)
        while k < len(status) and turn(points[status[k]], points[after[status[k]]], points[v]) > 0:
            k += 1
        while k and turn(points[status[k - 1]], points[after[status[k - 1]]], points[v]) < 0:
            k -= 1
        status.insert(k, v)
        helper[v] = (v, False)

    for v in sorted(range(len(points)), key=lambda i: (-points[i][1], points[i][0])):
        p, n = before[v], after[v]
        down_p, down_n = higher(v, p), higher(v, n)
        convex = turn(points[p], points[v], points[n]) > 0
        if down_p and down_n:
            if not convex:
                e = left_of(v)
                made.append((v, helper[e][0]))
                helper[e] = (v, False)
            insert(v)
        elif not down_p and not down_n:
            joined(v, p)
            remove(p)
            if not convex:
                e = left_of(v)
                joined(v, e)
                helper[e] = (v, True)
        elif down_n:
            joined(v, p)
            remove(p)
            insert(v)
        else:
            e = left_of(v)
            joined(v, e)
            helper[e] = (v, False)
    return made


def _faces(points: list[Point], after: list[int], diagonals: list[tuple[int, int]]) -> list[list[int]]:
    """The faces that border edges and diagonals enclose, each with the inside on its left."""
    round_: dict[int, list[int]] = {v: [] for v in range(len(points))}
    half = []
    for v, n in enumerate(after):
        round_[v].append(n)
        round_[n].append(v)
        half.append((v, n))
    for a, b in set(diagonals):
        round_[a].append(b)
        round_[b].append(a)
        half += [(a, b), (b, a)]
    for v, others in round_.items():
        others.sort(key=lambda o: atan2(points[o][1] - points[v][1], points[o][0] - points[v][0]))
    place = {v: {o: k for k, o in enumerate(others)} for v, others in round_.items()}
    left, faces = set(half), []
    for edge in half:
        if edge not in left:
            continue
        face, (a, b) = [], edge
        while (a, b) in left:
            left.discard((a, b))
            face.append(a)
            a, b = b, round_[b][place[b][a] - 1]
        faces.append(face)
    return faces


def _cut_monotone(points: list[Point], face: list[int]) -> list[tuple[int, int, int]]:
    """Triangles of a face that every horizontal line meets once."""
    if len(face) == 3:
        return [tuple(face)]
    order = sorted(face, key=lambda i: (-points[i][1], points[i][0]))
    top, bottom = face.index(order[0]), face.index(order[-1])
    # From top to bottom along the ring the inside is on the left, so this is the left chain.
    n = len(face)
    lefts = {face[(top + k) % n] for k in range(1, (bottom - top) % n)}
    out, stack = [], order[:2]

    def add(a: int, b: int, c: int) -> None:
        out.append((a, b, c) if turn(points[a], points[b], points[c]) >= 0 else (a, c, b))

    for k in range(2, n - 1):
        v = order[k]
        if (v in lefts) != (stack[-1] in lefts):
            for a, b in zip(stack, stack[1:], strict=False):
                add(v, a, b)
            stack = [stack[-1], v]
            continue
        last, wanted = stack.pop(), 1 if v in lefts else -1
        while stack and turn(points[stack[-1]], points[last], points[v]) == wanted:
            add(v, last, stack[-1])
            last = stack.pop()
        stack += [last, v]
    for a, b in zip(stack, stack[1:], strict=False):
        add(order[-1], a, b)
    return out


def flipped(points: list[Point], triangles: list[tuple[int, int, int]], fixed: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The triangles after flips of all edges that break the empty circle, but for fixed ones (a < b)."""
    triangles = list(triangles)
    across = {(t[k], t[k - 2]): i for i, t in enumerate(triangles) for k in range(3)}
    open_ = [e for e in across if e[0] < e[1] and e not in fixed]
    waiting = set(open_)
    while open_:
        e = open_.pop()
        waiting.discard(e)
        a, b = e
        i, j = across.get((a, b)), across.get((b, a))
        if i is None or j is None:
            continue
        c, d = sum(triangles[i]) - a - b, sum(triangles[j]) - a - b
        pa, pb, pc, pd = points[a], points[b], points[c], points[d]
        flat = turn(pa, pb, pc) == 0 or turn(pb, pa, pd) == 0
        # Both new triangles must turn left; a flat old one is flipped away wherever that is so.
        if turn(pa, pd, pc) <= 0 or turn(pd, pb, pc) <= 0 or not (flat or in_circle(pa, pb, pc, pd) > 0):
            continue
        triangles[i], triangles[j] = (a, d, c), (d, b, c)
        del across[a, b], across[b, a]
        for k, t in ((i, triangles[i]), (j, triangles[j])):
            across.update({(t[m], t[m - 2]): k for m in range(3)})
        for u, v in ((a, d), (d, b), (b, c), (c, a)):
            edge = (min(u, v), max(u, v))
            if edge not in fixed and edge not in waiting:
                waiting.add(edge)
                open_.append(edge)
    return triangles


def triangulated(rings: list[np.ndarray]) -> np.ndarray:
    """Triangles [n, 3, 2] of a polygon: the shell first, then holes, all simple and apart from each other.

    Raises ValueError where the triangles do not make up the polygon, as for
    rings that touch or cross.
    """
    points: list[Point] = []
    after: list[int] = []
    before: list[int] = []
    area = 0.0
    for k, ring in enumerate(rings):
        signed = _area(ring)
        ring = ring if (signed > 0) == (k == 0) else ring[::-1]
        area += abs(signed) if k == 0 else -abs(signed)
        start, n = len(points), len(ring)
        points += [(float(x), float(y)) for x, y in ring]
        after += [start + (i + 1) % n for i in range(n)]
        before += [start + (i - 1) % n for i in range(n)]
    try:
        faces = _faces(points, after, _diagonals(points, after, before))
    except (KeyError, ValueError, IndexError) as e:
        raise ValueError(f"rings touch or cross: {e}") from e
    cut = [t for face in faces if len(face) > 2 for t in _cut_monotone(points, face)]
    made = flipped(points, cut, {(min(v, n), max(v, n)) for v, n in enumerate(after)})
    out = np.array([[points[i] for i in t] for t in made], float).reshape(-1, 3, 2)
    u, v = out[:, 1] - out[:, 0], out[:, 2] - out[:, 0]
    areas = (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / 2
    if len(made) != len(points) + 2 * len(rings) - 4 or abs(areas.sum() - area) > 1e-9 * area or (areas < -1e-12 * area).any():
        raise ValueError("rings touch or cross")
    return out[areas > 0]
