"""Points within footprints, and what is known of their heights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.functions import geometry as g
from gablework.model import BARE_HEIGHT

#: Metres of a grid cell: about a building.
CELL = 20.0
#: Metres around a footprint's box that the crop looks at; the polygon decides.
MARGIN = 2.0


def footprint_edges(footprints: DataFrame) -> DataFrame:
    """Rows (fid, ring, seq, x1, y1, x2, y2); ring 0 is the exterior."""
    rings = F.concat(F.array(F.col("polygon.exterior")), F.col("polygon.interiors"))
    rows = footprints.select("fid", F.posexplode(rings).alias("ring", "points"))
    return rows.select("fid", "ring", F.posexplode(g.ring_edges(F.col("points"))).alias("seq", "e")).select("fid", "ring", "seq", "e.*")


def boxes(footprints: DataFrame) -> DataFrame:
    """Rows (fid, xmin, ymin, xmax, ymax) of the exteriors; empty polygons have none."""
    return footprints.select("fid", g.ring_box(F.col("polygon.exterior")).alias("b")).where("b is not null").select("fid", "b.*")


def bbox_filter(points: DataFrame, footprints: DataFrame, margin: float = MARGIN, cell: float = CELL) -> DataFrame:
    """Rows (fid, pid, x, y, z, polygon) of the points within the footprints' boxes and a margin.

    Points and footprints meet by grid cell, an equi-join; a footprint stands in each cell that its box touches.
    """
    box = g.ring_box(F.col("polygon.exterior"))
    spread = footprints.select("fid", "polygon", box.alias("b")).where("b is not null")
    lo = lambda c: F.floor((F.col(f"b.{c}") - margin) / cell)
    hi = lambda c: F.floor((F.col(f"b.{c}") + margin) / cell)
    spread = spread.withColumn("cx", F.explode(F.sequence(lo("xmin"), hi("xmax")))).withColumn("cy", F.explode(F.sequence(lo("ymin"), hi("ymax"))))
    placed = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    met = placed.join(spread, ["cx", "cy"])
    near = F.col("x").between(F.col("b.xmin") - margin, F.col("b.xmax") + margin) & F.col("y").between(F.col("b.ymin") - margin, F.col("b.ymax") + margin)
    return met.where(near).select("fid", "pid", "x", "y", "z", "polygon")


def crop_points(points: DataFrame, footprints: DataFrame, cell: float = CELL) -> DataFrame:
    """Rows (fid, pid, x, y, z): each point once for each footprint that contains it. Holes contain nothing."""
    near = bbox_filter(points, footprints, MARGIN, cell)
    return near.where(g.polygon_contains(F.col("polygon"), F.col("x"), F.col("y"))).drop("polygon")


def z_stats(cropped: DataFrame) -> DataFrame:
    """Rows (fid, n, z_min, z_max, z_mean, z_50p, z_70p): percentiles are the sorted heights at floor(n / 2) and floor(0.7 n) in double precision."""
    sorted_z = F.sort_array(F.collect_list("z"))
    n = F.count("z")
    at = lambda i: F.get(sorted_z, i.cast("int"))
    return cropped.groupBy("fid").agg(n.alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), at(F.floor(n / 2)).alias("z_50p"), at(F.floor(n * F.lit(0.7))).alias("z_70p"))


def footprint_stats(footprints: DataFrame, cropped: DataFrame) -> DataFrame:
    """z_stats of every footprint; zeros of those without points."""
    stats = footprints.select("fid").join(z_stats(cropped), "fid", "left")
    zero = {"n": 0, "z_min": 0.0, "z_max": 0.0, "z_mean": 0.0, "z_50p": 0.0, "z_70p": 0.0}
    return stats.na.fill(zero)


def flat_height():
    """The height of a flat roof, from columns n, z_70p and h_ground."""
    return F.when(F.col("n") > 0, F.col("z_70p")).otherwise(F.col("h_ground") + BARE_HEIGHT)


def dataset_centroid(footprints: DataFrame) -> DataFrame:
    """One row (cx, cy): the mean of the footprints' centroids; zeros without footprints."""
    each = footprints.select(g.ring_centroid(F.col("polygon.exterior")).alias("c"))
    return each.agg(F.coalesce(F.avg("c.cx"), F.lit(0.0)).alias("cx"), F.coalesce(F.avg("c.cy"), F.lit(0.0)).alias("cy"))
