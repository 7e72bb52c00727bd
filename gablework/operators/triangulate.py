"""Convex hulls and constrained Delaunay triangulations, as Arrow-batched functions over a building's arrays.

The triangulation inserts its points one by one into a large outer triangle (Bowyer-Watson), then brings in each
constraint that isn't an edge yet by cutting out the triangles that it passes and filling both sides again. Coordinates
are taken about their mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

NEAR = 1e-9
CELLS = "array<struct<cell_id:int,x0:double,y0:double,x1:double,y1:double,x2:double,y2:double>>"


class CrossingConstraints(ValueError):
    """Two constraints cross within both."""


def convex_hull_of(points: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise from the least; collinear points left out. Fewer than three distinct points come back as they are."""
    points = np.unique(np.asarray(points, dtype=float).reshape(-1, 2), axis=0)
    if len(points) > 1:
        apart = np.abs(np.diff(points, axis=0)).max(axis=1) >= 1e-10
        points = points[np.concatenate([[True], apart])]
    if len(points) < 3:
        return points

    def chain(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _in_circle(a, b, c, p) -> bool:
    """Whether p is strictly within the circle through a, b, c (counter-clockwise)."""
    m = np.array([[q[0] - p[0], q[1] - p[1], (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2] for q in (a, b, c)])
    return float(np.linalg.det(m)) > 1e-12


class Triangulation:
    """triangles: counter-clockwise triples of positions in points."""

    def __init__(self, points: np.ndarray):
        reach = 1e3 * max(1.0, float(np.abs(points).max(initial=0.0)))
        self.n = len(points)
        self.points = np.concatenate([points, [[-reach, -reach], [reach, -reach], [0.0, reach]]])
        self.triangles: set[tuple[int, int, int]] = {(self.n, self.n + 1, self.n + 2)}
        for i in range(self.n):
            self._insert(i)

    def _ccw(self, a: int, b: int, c: int) -> tuple[int, int, int]:
        p = self.points
        a, b, c = (a, b, c) if _turn(p[a], p[b], p[c]) > 0 else (a, c, b)
        k = min(range(3), key=lambda j: (a, b, c)[j])
        return ((a, b, c)[k], (a, b, c)[(k + 1) % 3], (a, b, c)[(k + 2) % 3])

    def _insert(self, i: int) -> None:
        p, q = self.points, self.points[i]
        inside = [t for t in self.triangles if all(_turn(p[t[k]], p[t[(k + 1) % 3]], q) >= -1e-12 for k in range(3))]
        bad = {t for t in self.triangles if _in_circle(p[t[0]], p[t[1]], p[t[2]], q)} | set(inside)
        # only what hangs together with where the point is: rounding can't open a second hole
        grown, todo = set(inside), list(inside)
        while todo:
            t = todo.pop()
            for s in bad - grown:
                if len(set(s) & set(t)) == 2:
                    grown.add(s)
                    todo.append(s)
        edges: dict[frozenset, tuple[int, int]] = {}
        for t in grown:
            for k in range(3):
                e = (t[k], t[(k + 1) % 3])
                if frozenset(e) in edges:
                    edges[frozenset(e)] = None
                else:
                    edges[frozenset(e)] = e
        self.triangles -= grown
        for e in edges.values():
            if e is not None and abs(_turn(p[e[0]], p[e[1]], q)) > 1e-14:
                self.triangles.add(self._ccw(e[0], e[1], i))

    def has_edge(self, a: int, b: int) -> bool:
        return any(a in t and b in t for t in self.triangles)

    def constrain(self, a: int, b: int) -> None:
        """Makes a-b an edge; no point may lie on it."""
        if self.has_edge(a, b):
            return
        p = self.points
        passed = [t for t in self.triangles if any(self._cuts(a, b, t[k], t[(k + 1) % 3]) for k in range(3))]
        sides: tuple[list, list] = ([], [])
        border = {}
        for t in passed:
            for k in range(3):
                e = (t[k], t[(k + 1) % 3])
                border[frozenset(e)] = None if frozenset(e) in border else e
        chain = {e[0]: e[1] for e in border.values() if e is not None}
        for side, (start, end) in zip(sides, ((a, b), (b, a)), strict=True):
            at = start
            side.append(at)
            while at != end:
                at = chain[at]
                side.append(at)
        self.triangles -= set(passed)
        for side in sides:
            self._fill(side, p)

    def _cuts(self, a: int, b: int, c: int, d: int) -> bool:
        if len({a, b, c, d}) < 4:
            return False
        p = self.points
        return _turn(p[a], p[b], p[c]) * _turn(p[a], p[b], p[d]) < 0 and _turn(p[c], p[d], p[a]) * _turn(p[c], p[d], p[b]) < 0

    def _fill(self, ring: list[int], p: np.ndarray) -> None:
        """Triangles of the chain ring[0] ... ring[-1] over the edge between its ends."""
        if len(ring) < 3:
            return
        first, last = ring[0], ring[-1]
        best = 1
        for k in range(2, len(ring) - 1):
            t = self._ccw(first, last, ring[best])
            if _in_circle(p[t[0]], p[t[1]], p[t[2]], p[ring[k]]):
                best = k
        self._fill(ring[: best + 1], p)
        self._fill(ring[best:], p)
        if abs(_turn(p[first], p[last], p[ring[best]])) > 1e-14:
            self.triangles.add(self._ccw(first, last, ring[best]))

    def inner(self) -> list[tuple[int, int, int]]:
        return sorted(t for t in self.triangles if max(t) < self.n)


def _meeting(a, b, c, d) -> np.ndarray | None:
    """Where a-b and c-d cross within both; None if they only touch or miss."""
    size = max(1.0, float(np.linalg.norm(np.subtract(b, a))), float(np.linalg.norm(np.subtract(d, c))))
    sides = [_turn(a, b, c) / size, _turn(a, b, d) / size, _turn(c, d, a) / size, _turn(c, d, b) / size]
    if any(abs(s) <= NEAR for s in sides) or sides[0] * sides[1] > 0 or sides[2] * sides[3] > 0:
        return None
    return np.asarray(a) + (np.subtract(b, a)) * (sides[2] / (sides[2] - sides[3]))


def constrained_cells(ring: np.ndarray, segments: np.ndarray, on_crossing: str = "flat") -> list[np.ndarray]:
    """The triangles (3 x 2) of the ring's vertices (not closed) and the segments' ends, with ring and segments as edges.

    on_crossing: "flat" refuses segments that cross the ring or each other within both (CrossingConstraints), "split"
    breaks them there. Triangles outside the ring are among the result; the caller picks by centroid.
    """
    ring, segments = np.asarray(ring, dtype=float).reshape(-1, 2), np.asarray(segments, dtype=float).reshape(-1, 4)
    origin = ring.mean(axis=0)
    ends = [(ring[i] - origin, ring[(i + 1) % len(ring)] - origin) for i in range(len(ring))]
    ends += [(s[:2] - origin, s[2:] - origin) for s in segments]
    points: list[np.ndarray] = []

    def place(q: np.ndarray) -> int:
        for i, r in enumerate(points):
            if abs(r[0] - q[0]) <= NEAR and abs(r[1] - q[1]) <= NEAR:
                return i
        points.append(q)
        return len(points) - 1

    pairs = [(place(a), place(b)) for a, b in ends]
    for i in range(len(ends)):
        for j in range(i + 1, len(ends)):
            at = _meeting(*ends[i], *ends[j])
            if at is not None:
                if on_crossing != "split":
                    raise CrossingConstraints(f"{ends[i]} and {ends[j]}")
                place(at)
    xy = np.array(points)
    made = Triangulation(xy)
    for a, b in pairs:
        if a == b:
            continue
        along, length = xy[b] - xy[a], float(np.linalg.norm(xy[b] - xy[a]))
        t = (xy - xy[a]) @ along / length**2
        off = np.abs((xy[:, 0] - xy[a][0]) * along[1] - (xy[:, 1] - xy[a][1]) * along[0]) / length
        on = np.flatnonzero((off <= 1e-8) & (t > 0) & (t < 1))
        stops = [a, *on[np.argsort(t[on])].tolist(), b]
        for c, d in zip(stops, stops[1:], strict=False):
            if c != d:
                made.constrain(c, d)
    return [xy[list(t)] + origin for t in made.inner()]


def _ring_of(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], dtype=float).reshape(-1, 2)


def cdt_cells(on_crossing: str = "flat"):
    """Column function (exterior ring, ridges array<struct<x1,y1,x2,y2>>) -> triangles by place; null where constraints cross, the ring has fewer than three corners, or the arithmetic fails."""

    @F.pandas_udf(CELLS)
    def run(rings: pd.Series, ridges: pd.Series) -> pd.Series:
        out = []
        for ring, lines in zip(rings, ridges, strict=True):
            try:
                corners = _ring_of(ring)[:-1]
                if len(corners) < 3:
                    out.append(None)
                    continue
                segments = [] if lines is None else [(s["x1"], s["y1"], s["x2"], s["y2"]) for s in lines]
                cells = sorted((tuple(map(float, t.ravel())) for t in constrained_cells(corners, segments, on_crossing)), key=lambda t: (sum(t[0::2]), sum(t[1::2])))
                out.append([dict(zip(("cell_id", "x0", "y0", "x1", "y1", "x2", "y2"), (i, *t), strict=True)) for i, t in enumerate(cells)])
            except (CrossingConstraints, np.linalg.LinAlgError, ArithmeticError, ValueError):  # one building's failure is its flat roof
                out.append(None)
        return pd.Series(out)

    return run


def hulls():
    """Column function (array<struct<x,y,..>>) -> hull array<struct<x,y>>."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(points: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in convex_hull_of(_ring_of(p))] for p in points])

    return run
