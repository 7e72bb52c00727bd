"""The three reconstruction methods as plans over footprints and points.

All share crop, heights and plane detection. A method turns a building's row (footprint, heights, planes) into a mesh;
where it gives none, or its kernel failed, the building gets a flat roof, and the row says why.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.functions import geometry as g
from gablework.model import FEWEST_POINTS, MESH, RansacConfig
from gablework.operators import crop, labels, mesh, planes, triangulate
from gablework.scratch import written


@dataclass(frozen=True)
class Scene:
    """What every method starts from: buildings (fid, polygon, n, z_70p, h_ground), cropped (fid, pid, x, y, z), planes (fid, plane_id, ..., inliers)."""

    buildings: DataFrame
    cropped: DataFrame
    planes: DataFrame

    @property
    def inliers(self) -> DataFrame:
        return self.planes.select("fid", "plane_id", F.explode("inliers").alias("p")).select("fid", "plane_id", "p.*")


def scene(footprints: DataFrame, points: DataFrame, config: RansacConfig = RansacConfig()) -> Scene:
    """Footprints of fewer than five points have no planes. Cropped points, buildings and planes are written: they are read several times, and the crop's join and the kernel are the costly parts."""
    cropped = written(crop.crop_points(points, footprints), "cropped")
    stats = crop.footprint_stats(footprints, cropped)
    buildings = written(footprints.select("fid", "polygon").join(stats.select("fid", "n", "z_70p", F.col("z_min").alias("h_ground")), "fid"), "buildings")
    enough = buildings.where(F.col("n") >= FEWEST_POINTS).select("fid")
    found = written(planes.detect_planes(cropped.join(enough, "fid", "left_semi"), config), "planes")
    return Scene(buildings, cropped, found)


class Reconstructor(Protocol):
    """A method: meshes(scene) gives rows (fid, mesh, failed) for buildings with planes; a null mesh gives way to the flat roof."""

    name: str

    def meshes(self, of: Scene) -> DataFrame: ...


def _plane_arrays(of: Scene) -> DataFrame:
    """Rows (fid, planes array in order, failed) of the buildings that have planes or whose kernel failed."""
    own = F.sort_array(F.collect_list(F.struct("plane_id", "nx", "ny", "nz", "d")))
    return of.planes.groupBy("fid").agg(own.alias("planes"), (F.min("plane_id") < 0).alias("failed"))


class PlaneExtrude:
    """The hull of each plane's points, extruded to the ground."""

    name = "plane-extrude"

    def meshes(self, of: Scene) -> DataFrame:
        flat = of.inliers.groupBy("fid", "plane_id").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("points"))
        flat = flat.select("fid", "plane_id", triangulate.hulls()(F.col("points")).alias("hull"))
        parts = of.planes.where("plane_id >= 0").select("fid", "plane_id", "nx", "ny", "nz", "d").join(flat, ["fid", "plane_id"], "left")
        hull = F.coalesce("hull", F.array().cast("array<struct<x:double,y:double>>"))
        parts = parts.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("plane_id", "nx", "ny", "nz", "d", hull.alias("hull")))).alias("parts"))
        rows = of.buildings.join(parts, "fid")
        made = rows.select("fid", mesh.extruded_mesh(F.col("polygon.exterior"), F.col("parts"), F.col("h_ground")).alias("mesh"), F.lit(False).alias("failed"))
        return made.unionAll(of.planes.where("plane_id < 0").select("fid", F.lit(None).cast(MESH), F.lit(True)))


def roof_cells(of: Scene, on_crossing: str) -> DataFrame:
    """Rows (fid, cells array or null where the triangulation failed, planes, failed) of buildings with planes."""
    lines = planes.ridgelines(of.planes.where("plane_id >= 0"), crop.boxes(of.buildings))
    lines = lines.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("i", "j", "x1", "y1", "x2", "y2"))).alias("lines"))
    rows = of.buildings.join(_plane_arrays(of), "fid").join(lines, "fid", "left")
    ridges = F.transform(F.coalesce("lines", F.array().cast("array<struct<i:int,j:int,x1:double,y1:double,x2:double,y2:double>>")), lambda s: F.struct(s["x1"].alias("x1"), s["y1"].alias("y1"), s["x2"].alias("x2"), s["y2"].alias("y2")))
    return rows.withColumn("ridges", ridges).withColumn("cells", triangulate.cdt_cells(on_crossing)(F.col("polygon.exterior"), F.col("ridges"))).drop("lines", "ridges")


def cells_inside(rows: DataFrame, least_area: float = 0.0) -> DataFrame:
    """Rows (fid, site_id, x0 ... y2, cx, cy, area) of the triangles whose centroid is in the footprint and whose area isn't below the least."""
    c = F.col
    each = rows.where("cells is not null").select("fid", "polygon", F.explode("cells").alias("t")).select("fid", "polygon", "t.*")
    each = each.withColumn("cx", g.tri_centroid(c("x0"), c("x1"), c("x2"))).withColumn("cy", g.tri_centroid(c("y0"), c("y1"), c("y2"))).withColumn("area", g.tri_area(*[c(k) for k in ("x0", "y0", "x1", "y1", "x2", "y2")]))
    kept = each.where((c("area") >= least_area) & g.polygon_contains(c("polygon"), c("cx"), c("cy")))
    return kept.withColumnRenamed("cell_id", "site_id").drop("polygon")


def corners(buildings: DataFrame) -> DataFrame:
    """Rows (fid, seq, vx, vy) of the exteriors' vertices without the closing one."""
    return buildings.select("fid", F.posexplode(g.open_ring(F.col("polygon.exterior"))).alias("seq", "p")).select("fid", "seq", F.col("p.x").alias("vx"), F.col("p.y").alias("vy"))


def _assembled(rows: DataFrame, labelled: DataFrame, tops: DataFrame, default: float, wall_default: float) -> DataFrame:
    """Rows (fid, mesh, failed, n_cells) from buildings' rows, labelled cells and corner heights (fid, seq, z)."""
    cell = F.struct("site_id", "x0", "y0", "x1", "y1", "x2", "y2", "plane_id")
    cells = labelled.groupBy("fid").agg(F.sort_array(F.collect_list(cell)).alias("labelled"))
    heights = tops.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("seq", "z"))).alias("tops"))
    met = rows.join(cells, "fid", "left").join(heights, "fid", "left")
    none = F.array().cast("array<struct<site_id:int,x0:double,y0:double,x1:double,y1:double,x2:double,y2:double,plane_id:int>>")
    held = F.coalesce("labelled", none)
    z = F.transform("tops", lambda t: F.coalesce(t["z"], F.col("h_ground") + wall_default))
    made = mesh.cell_mesh(F.col("polygon.exterior"), held, F.col("planes"), z, F.col("h_ground"), F.col("h_ground") + default, F.col("z_70p"))
    broken = F.col("cells").isNull() | F.col("failed")
    return met.select("fid", F.when(~broken, made).alias("mesh"), broken.alias("failed"), F.size(held).alias("n_cells"))


class Arrangement:
    """Roof cells between the ridges, labelled by the planes' points around them."""

    name = "arrangement"

    def __init__(self, on_crossing: str = "flat"):
        self.on_crossing = on_crossing

    def meshes(self, of: Scene) -> DataFrame:
        rows = written(roof_cells(of, self.on_crossing), "cells")
        return self.assembled(of, rows, cells_inside(rows)).drop("n_cells")

    @staticmethod
    def assembled(of: Scene, rows: DataFrame, cells: DataFrame) -> DataFrame:
        """The meshes of buildings' rows over given cells: cells and corners take the plane with most points around them."""
        edge = corners(rows)
        sites = cells.select("fid", "site_id", "cx", "cy").unionAll(edge.select("fid", -1 - F.col("seq"), "vx", "vy"))
        votes = labels.inlier_votes(sites, of.planes, of.inliers)
        label = written(labels.label_vote(votes, of.planes), "labels")
        labelled = cells.join(label.select("fid", "site_id", "plane_id"), ["fid", "site_id"])
        at = label.where("site_id < 0").select("fid", (-1 - F.col("site_id")).alias("seq"), "plane_id")
        tops = labels.heights(edge.join(at, ["fid", "seq"], "left"), of.planes, "vx", "vy")
        return _assembled(rows, labelled, tops.select("fid", "seq", "z"), 0.0, 3.0)


class GraphCut:
    """Roof cells between the ridges, labelled by least data cost."""

    name = "graph-cut"

    def __init__(self, on_crossing: str = "flat"):
        self.on_crossing = on_crossing

    def meshes(self, of: Scene) -> DataFrame:
        rows = written(roof_cells(of, self.on_crossing), "cells")
        made = self.assembled(of, rows, cells_inside(rows, 1e-6))
        return made.select("fid", F.when(F.col("n_cells") > 0, F.col("mesh")).alias("mesh"), "failed")

    @staticmethod
    def assembled(of: Scene, rows: DataFrame, cells: DataFrame) -> DataFrame:
        """The meshes of buildings' rows over given cells: cells take the plane of least cost, corners that of the nearest cell."""
        label = labels.label_cost(labels.data_costs(cells, of.planes, of.inliers))
        labelled = written(cells.join(label.select("fid", "site_id", "plane_id"), ["fid", "site_id"]), "labelled")
        edge = corners(rows)
        nearest = labels.nearest_cell(edge, labelled)
        tops = labels.heights(edge.join(nearest.select("fid", "seq", "plane_id"), ["fid", "seq"], "left"), of.planes, "vx", "vy")
        return _assembled(rows, labelled, tops.select("fid", "seq", "z"), 3.0, 3.0)


METHODS: dict[str, type] = {m.name: m for m in (PlaneExtrude, Arrangement, GraphCut)}


def reconstruct(footprints: DataFrame, points: DataFrame, method: Reconstructor, config: RansacConfig = RansacConfig()) -> DataFrame:
    """Rows (fid, lod22, lod12, h_ground, attributes, method, fallback), one for each footprint.

    fallback: null of a mesh by the method; few_points, no_planes, kernel (detection or triangulation failed, crossing
    ridges among them) or no_mesh where a flat roof stands in.
    """
    of = scene(footprints, points, config)
    rows = of.buildings.join(method.meshes(of), "fid", "left").join(footprints.select("fid", "attributes"), "fid")
    flat = mesh.flat_roof(F.col("polygon.exterior"), F.col("h_ground"), crop.flat_height())
    why = F.when(F.col("n") < FEWEST_POINTS, "few_points").when(F.col("failed").isNull(), "no_planes").when(F.col("failed"), "kernel").when(F.col("mesh").isNull(), "no_mesh")
    return rows.select("fid", F.coalesce("mesh", flat).alias("lod22"), F.lit(None).cast(MESH).alias("lod12"), "h_ground", "attributes", F.lit(method.name).alias("method"), why.alias("fallback"))


def flat_buildings(footprints: DataFrame, points: DataFrame) -> DataFrame:
    """The buildings of the fallback alone: every roof flat."""
    stats = crop.footprint_stats(footprints, crop.crop_points(points, footprints))
    rows = footprints.join(stats.withColumn("h_ground", F.col("z_min")), "fid")
    flat = mesh.flat_roof(F.col("polygon.exterior"), F.col("h_ground"), crop.flat_height())
    return rows.select("fid", flat.alias("lod22"), F.lit(None).cast(MESH).alias("lod12"), "h_ground", "attributes", F.lit("flat").alias("method"), F.lit(None).cast("string").alias("fallback"))
