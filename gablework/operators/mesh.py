"""Building meshes as expressions over a building's arrays.

A mesh is vertices, faces (positions of vertices, position of a semantic surface) and semantic surfaces. Every builder
lays the parts one after the other, so a part's positions are sums of the sizes before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gablework.functions import geometry as g
from gablework.model import FACE, MESH, RING, SEMANTIC


def semantic(kind: str, on_edge: bool | None = None, slope: Column | None = None, azimuth: Column | None = None) -> Column:
    """A semantic surface; kind: GroundSurface, WallSurface, RoofSurface or ClosureSurface."""
    if kind not in ("GroundSurface", "WallSurface", "RoofSurface", "ClosureSurface"):
        raise ValueError(f"no such surface: {kind}")
    none = F.lit(None).cast("double")
    values = {"surface_type": F.lit(kind), "on_footprint_edge": F.lit(on_edge).cast("boolean"), "azimuth": none if azimuth is None else azimuth, "slope": none if slope is None else slope, "h_roof_50p": none, "h_roof_70p": none, "h_roof_min": none, "h_roof_max": none}
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(SEMANTIC)


def roof_with_stats(p: Column) -> Column:
    """The roof surface of a plane (struct of nx, ny, nz)."""
    return semantic("RoofSurface", None, g.slope_degrees(p["nz"]), g.azimuth_degrees(p["nx"], p["ny"]))


def face(indices: Column, semantic_index: Column) -> Column:
    return F.struct(indices.cast("array<int>").alias("indices"), semantic_index.cast("int").alias("semantic_index")).cast(FACE)


def mesh(vertices: Column, faces: Column, semantics: Column) -> Column:
    return F.struct(vertices.cast(RING).alias("vertices"), faces.alias("faces"), semantics.alias("semantics")).cast(MESH)


def _upto(n: Column) -> Column:
    """0 ... n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def flat_roof(exterior: Column, h_ground: Column, h_roof: Column) -> Column:
    """Ground, roof and a wall for each edge; 2n vertices, bottom and top in turn. Null of fewer than three corners."""
    ring = g.open_ring(exterior)
    n = F.size(ring)
    vertices = F.flatten(F.transform(ring, lambda p: F.array(g.point(p["x"], p["y"], h_ground), g.point(p["x"], p["y"], h_roof))))
    ground = face(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: 2 * i), F.lit(0))
    roof = face(F.transform(_upto(n), lambda i: 2 * i + 1), F.lit(2))
    wall = lambda i: face(F.array(2 * i, 2 * ((i + 1) % n), 2 * ((i + 1) % n) + 1, 2 * i + 1), F.lit(1))
    faces = F.concat(F.array(ground, roof), F.transform(_upto(n), wall))
    return F.when(n >= 3, mesh(vertices, faces, F.array(semantic("GroundSurface"), semantic("WallSurface", True), semantic("RoofSurface"))))


def _ground_and_walls(ring: Column, tops: Column, h_ground: Column, first: Column) -> tuple[Column, Column]:
    """Vertices and faces of the ground (surface 0) and a wall for each edge (surface 1), the first vertex at position first. tops: a height for each corner."""
    n = F.size(ring)
    bottom = F.transform(ring, lambda p: g.point(p["x"], p["y"], h_ground))
    corner = lambda i: g.point(F.get(ring, i)["x"], F.get(ring, i)["y"], F.get(tops, i))
    top = F.flatten(F.transform(_upto(n), lambda i: F.array(corner(i), corner((i + 1) % n))))
    ground = face(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: first + i), F.lit(0))
    wall = lambda i: face(F.array(first + i, first + (i + 1) % n, first + n + 2 * i + 1, first + n + 2 * i), F.lit(1))
    return F.concat(bottom, top), F.concat(F.array(ground), F.transform(_upto(n), wall))


def cell_mesh(exterior: Column, cells: Column, planes: Column, tops: Column, h_ground: Column, default: Column, bare: Column) -> Column:
    """The mesh of labelled roof cells: a triangle for each, then ground and walls; 3T + 3n vertices, T + n + 1 faces.

    cells: array<struct<x0..y2, plane_id>> in order. planes: array<struct<plane_id,nx,ny,nz,d>> in order. tops: a height
    for each corner. default: the height over a cell whose plane is vertical; bare: over a cell of no plane, which takes
    the first plane's surface.
    """
    ring = g.open_ring(exterior)
    over = lambda c, x, y: F.coalesce(g.eval_z(*[F.get(planes, c["plane_id"])[k] for k in ("nx", "ny", "nz", "d")], c[x], c[y]), default)
    at = lambda c, x, y: F.when(c["plane_id"].isNull(), bare).otherwise(over(c, x, y))
    roof = F.flatten(F.transform(cells, lambda c: F.array(*[g.point(c[x], c[y], at(c, x, y)) for x, y in (("x0", "y0"), ("x1", "y1"), ("x2", "y2"))])))
    triangles = F.transform(cells, lambda c, i: face(F.array(3 * i, 3 * i + 1, 3 * i + 2), F.coalesce(c["plane_id"], F.lit(0)) + 2))
    vertices, faces = _ground_and_walls(ring, tops, h_ground, 3 * F.size(cells))
    semantics = F.concat(F.array(semantic("GroundSurface"), semantic("WallSurface", True)), F.transform(planes, roof_with_stats))
    return F.when(F.size(ring) >= 3, mesh(F.concat(roof, vertices), F.concat(triangles, faces), semantics))


def extruded_mesh(exterior: Column, parts: Column, h_ground: Column) -> Column:
    """The mesh of hulls extruded to the ground: for each part a roof and a wall for each hull edge, 3h vertices and h + 1 faces; the ground last.

    parts: array<struct<nx,ny,nz,d,hull:array<struct<x,y>>>> in order; a part whose hull has fewer than three corners
    has surfaces but no faces. Null if there are fewer than two faces.
    """
    ring = g.open_ring(exterior)
    n = F.size(ring)
    corners = lambda p: F.when(F.size(p["hull"]) >= 3, p["hull"]).otherwise(_empty("array<struct<x:double,y:double>>"))
    z = lambda p, q: F.coalesce(g.eval_z(p["nx"], p["ny"], p["nz"], p["d"], q["x"], q["y"]), h_ground + 5)
    roof = lambda p: F.transform(corners(p), lambda q: g.point(q["x"], q["y"], z(p, q)))
    foot = lambda q: g.point(q["x"], q["y"], h_ground)
    bottoms = lambda p: F.flatten(F.transform(_upto(F.size(corners(p))), lambda i: F.array(foot(F.get(corners(p), i)), foot(F.get(corners(p), (i + 1) % F.size(corners(p)))))))
    vertices = F.flatten(F.transform(parts, lambda p: F.concat(roof(p), bottoms(p))))
    sizes = F.transform(parts, lambda p: F.size(corners(p)))
    before = lambda i: 3 * F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, s: a + s)

    def part_faces(p: Column, i: Column) -> Column:
        h, first = F.size(corners(p)), before(i)
        top = face(F.transform(_upto(h), lambda k: first + k), 2 * i + 1)
        wall = lambda k: face(F.array(first + k, first + (k + 1) % h, first + h + 2 * k + 1, first + h + 2 * k), 2 * i + 2)
        return F.when(h > 0, F.concat(F.array(top), F.transform(_upto(h), wall))).otherwise(_empty(f"array<{FACE}>"))

    faces = F.flatten(F.transform(parts, part_faces))
    total = before(F.size(parts))
    ground = face(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: total + i), F.lit(0))
    vertices = F.when(n >= 3, F.concat(vertices, F.transform(ring, foot))).otherwise(vertices)
    faces = F.when(n >= 3, F.concat(faces, F.array(ground))).otherwise(faces)
    semantics = F.concat(F.array(semantic("GroundSurface")), F.flatten(F.transform(parts, lambda p: F.array(roof_with_stats(p), semantic("WallSurface", True)))))
    return F.when(F.size(faces) >= 2, mesh(vertices, faces, semantics))


# measures


def face_normal(m: Column, index: Column) -> Column:
    """struct<nx,ny,nz>: the unit normal of a face's first three vertices; null of fewer or of collinear ones."""
    f = F.get(m["faces"], index)
    p, q, r = (F.get(m["vertices"], F.get(f["indices"], F.lit(k))) for k in range(3))
    n = g.cross3((q["x"] - p["x"], q["y"] - p["y"], q["z"] - p["z"]), (r["x"] - p["x"], r["y"] - p["y"], r["z"] - p["z"]))
    size = F.sqrt(g.dot3(n, n))
    return F.when((F.size(f["indices"]) >= 3) & (size >= 1e-15), F.struct(*[(v / size).alias(k) for v, k in zip(n, ("nx", "ny", "nz"), strict=True)]))


def volume(m: Column) -> Column:
    """The absolute sum of the signed tetrahedra of the fan-triangulated faces."""
    vertices = m["vertices"]

    def fan(f: Column) -> Column:
        at = lambda i: F.get(vertices, F.get(f["indices"], i))
        v = lambda p: (p["x"], p["y"], p["z"])
        terms = F.transform(_upto(F.greatest(F.size(f["indices"]) - 2, F.lit(0))), lambda i: g.dot3(v(at(F.lit(0))), g.cross3(v(at(i + 1)), v(at(i + 2)))))
        return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)

    return F.abs(F.aggregate(F.transform(m["faces"], fan), F.lit(0.0), lambda a, t: a + t) / 6)


def extent(m: Column) -> Column:
    """struct<xmin,ymin,zmin,xmax,ymax,zmax>; null without vertices."""
    of = {"x": F.transform(m["vertices"], lambda p: p["x"]), "y": F.transform(m["vertices"], lambda p: p["y"]), "z": F.transform(m["vertices"], lambda p: p["z"])}
    return F.when(F.size(m["vertices"]) > 0, F.struct(*[F.array_min(of[k]).alias(f"{k}min") for k in "xyz"], *[F.array_max(of[k]).alias(f"{k}max") for k in "xyz"]))


def best_lod(lod22: Column, lod12: Column) -> Column:
    return F.coalesce(lod22, lod12)
