"""Geometry as column expressions: triangles, planes, rings. All stay in the JVM; divisions are guarded for ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(value: float) -> Column:
    return F.lit(float(value))


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


# triangles


def cross2(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """(a - o) x (b - o); positive if o, a, b turn left."""
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def tri_area(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(cross2(x0, y0, x1, y1, x2, y2)) / 2


def tri_centroid(a: Column, b: Column, c: Column) -> Column:
    """One coordinate of the mean of three vertices."""
    return (a + b + c) / 3


# planes n.p + d = 0; n is a unit vector


def plane_from_point(nx: Column, ny: Column, nz: Column, x: Column, y: Column, z: Column) -> Column:
    """d of the plane of normal n through the point."""
    return _d(0) - (nx * x + ny * y + nz * z)


def signed_distance(nx: Column, ny: Column, nz: Column, d: Column, x: Column, y: Column, z: Column) -> Column:
    return nx * x + ny * y + nz * z + d


def plane_distance(nx: Column, ny: Column, nz: Column, d: Column, x: Column, y: Column, z: Column) -> Column:
    return F.abs(signed_distance(nx, ny, nz, d, x, y, z))


def eval_z(nx: Column, ny: Column, nz: Column, d: Column, x: Column, y: Column) -> Column:
    """The plane's height at (x, y); null if it is vertical."""
    return F.when(F.abs(nz) >= 1e-10, (_d(0) - (nx * x + ny * y + d)) / nz)


def slope_degrees(nz: Column) -> Column:
    return F.degrees(F.acos(F.least(_d(1), F.abs(nz))))


def azimuth_degrees(nx: Column, ny: Column) -> Column:
    """Counter-clockwise from +x, 0 to 360; 0 of an exactly flat plane."""
    flat = (nx == 0) & (ny == 0)
    angle = F.degrees(F.atan2(ny, nx))
    return F.when(flat, _d(0)).when(angle < 0, angle + 360).otherwise(angle)


def is_near_horizontal(nz: Column, degrees: float) -> Column:
    return slope_degrees(nz) < degrees


def is_near_vertical(nz: Column, degrees: float) -> Column:
    return slope_degrees(nz) > 90 - degrees


def cross3(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot3(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def fit_3pts(p: Column, q: Column, r: Column) -> Column:
    """struct<nx,ny,nz,d> of the plane through three points (structs of x, y, z); null if they are on a line."""
    u = (q["x"] - p["x"], q["y"] - p["y"], q["z"] - p["z"])
    v = (r["x"] - p["x"], r["y"] - p["y"], r["z"] - p["z"])
    c = cross3(u, v)
    size = F.sqrt(dot3(c, c))
    n = tuple(x / size for x in c)
    d = plane_from_point(*n, p["x"], p["y"], p["z"])
    return F.when(size >= 1e-10, F.struct(*[x.alias(k) for x, k in zip((*n, d), ("nx", "ny", "nz", "d"), strict=True)]))


def intersect_planes(a: Column, b: Column) -> Column:
    """struct<ox,oy,oz,dx,dy,dz>: a point of the line in which two planes (structs of nx, ny, nz, d) meet and its unit direction; null if they are parallel."""
    m, n = ((s["nx"], s["ny"], s["nz"]) for s in (a, b))
    c = cross3(m, n)
    size = F.sqrt(dot3(c, c))
    gram = dot3(m, m) * dot3(n, n) - dot3(m, n) * dot3(m, n)
    e, f = _d(0) - a["d"], _d(0) - b["d"]
    s = (e * dot3(n, n) - f * dot3(m, n)) / gram
    t = (f * dot3(m, m) - e * dot3(m, n)) / gram
    origin = tuple(s * x + t * y for x, y in zip(m, n, strict=True))
    values = (*origin, *(x / size for x in c))
    return F.when((size >= 1e-10) & (F.abs(gram) >= 1e-10), F.struct(*[v.alias(k) for v, k in zip(values, ("ox", "oy", "oz", "dx", "dy", "dz"), strict=True)]))


def clip_line(line: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """struct<x1,y1,x2,y2>: the part of the line over the box; null if it misses the box or is shorter than 1e-5."""

    def slab(o: Column, v: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
        level = F.abs(v) < 1e-15
        safe = F.when(level, _d(1)).otherwise(v)
        a, b = (lo - o) / safe, (hi - o) / safe
        return F.when(level, _d(-1e10)).otherwise(F.least(a, b)), F.when(level, _d(1e10)).otherwise(F.greatest(a, b)), level & ((o < lo) | (o > hi))

    near_x, far_x, out_x = slab(line["ox"], line["dx"], xmin, xmax)
    near_y, far_y, out_y = slab(line["oy"], line["dy"], ymin, ymax)
    near, far = F.greatest(_d(-1e10), near_x, near_y), F.least(_d(1e10), far_x, far_y)
    ends = (line["ox"] + line["dx"] * near, line["oy"] + line["dy"] * near, line["ox"] + line["dx"] * far, line["oy"] + line["dy"] * far)
    long = (ends[2] - ends[0]) * (ends[2] - ends[0]) + (ends[3] - ends[1]) * (ends[3] - ends[1]) >= 1e-10
    kept = line.isNotNull() & ~out_x & ~out_y & (near <= far) & long
    return F.when(kept, F.struct(*[v.alias(k) for v, k in zip(ends, ("x1", "y1", "x2", "y2"), strict=True)]))


# rings: arrays of points, the first repeated at the end


def open_ring(ring: Column) -> Column:
    """The ring without its closing vertex."""
    return F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))


def ring_edges(ring: Column) -> Column:
    """array<struct<x1,y1,x2,y2>> of each vertex and the next."""
    n = F.size(ring)
    edge = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return F.when(n < 2, F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).otherwise(F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), edge))


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right meets the edge: half-open in y, strict in x."""
    rise = F.when(e["y2"] == e["y1"], _d(1)).otherwise(e["y2"] - e["y1"])
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / rise + e["x1"])


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd; a ring of fewer than three vertices contains nothing."""
    hits = F.size(F.filter(ring_edges(ring), lambda e: crosses(e, x, y)))
    return (F.size(ring) >= 3) & (hits % 2 == 1)


def polygon_contains(polygon: Column, x: Column, y: Column) -> Column:
    """In the exterior and in no hole."""
    return ring_contains(polygon["exterior"], x, y) & ~F.exists(polygon["interiors"], lambda hole: ring_contains(hole, x, y))


def ring_box(ring: Column) -> Column:
    """struct<xmin,ymin,xmax,ymax>; null of an empty ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.when(F.size(ring) > 0, F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")))


def signed_area(ring: Column) -> Column:
    """Shoelace over a ring that is closed or closes by itself; positive if counter-clockwise."""
    n = F.size(ring)
    wrapped = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    terms = F.zip_with(ring, wrapped, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, _d(0), lambda a, t: a + t) / 2


def ring_centroid(ring: Column) -> Column:
    """struct<cx,cy>: the mean of the vertices, the closing one included; zeros of an empty ring."""
    n = F.size(ring)
    mean = lambda k: F.aggregate(ring, _d(0), lambda a, p: a + p[k]) / n
    return F.when(n > 0, F.struct(mean("x").alias("cx"), mean("y").alias("cy"))).otherwise(F.struct(_d(0).alias("cx"), _d(0).alias("cy")))
