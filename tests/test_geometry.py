import math

import pytest
from pyspark.sql import functions as F

from gablework.functions import geometry as g
from gablework.functions import text as t
from gablework.model import POLYGON

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]


def polygon(ring, holes=()):
    points = lambda r: [(float(x), float(y), 0.0) for x, y in r]
    return (points(ring), [points(h) for h in holes])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("x, y, inside", [(0.5, 0.5, True), (0.0, 0.5, True), (1.0, 0.5, False), (0.5, 0.0, True), (0.5, 1.0, False), (2.0, 0.5, False), (0.0, 0.0, True), (1.0, 1.0, False)])
def test_ring_is_half_open(spark, x, y, inside):
    df = spark.createDataFrame([(polygon(SQUARE),)], f"p {POLYGON}")
    assert df.select(g.polygon_contains(F.col("p"), F.lit(x), F.lit(y)).alias("v")).first().v is inside


def test_holes_and_short_rings(spark):
    hole = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)]
    df = spark.createDataFrame([(polygon(SQUARE, [hole]), polygon(SQUARE[:2]), polygon([]))], f"p {POLYGON}, q {POLYGON}, r {POLYGON}")
    at = lambda c, x: g.polygon_contains(F.col(c), F.lit(x), F.lit(0.5)).alias(f"{c}{x}")
    row = df.select(at("p", 0.5), at("p", 0.1), at("q", 0.5), at("r", 0.5), g.ring_box(F.col("r.exterior")).alias("box"), g.ring_centroid(F.col("r.exterior")).alias("mean")).first()
    assert [row[0], row[1], row[2], row[3]] == [False, True, False, False] and row.box is None and tuple(row["mean"]) == (0.0, 0.0)


def test_plane_functions(spark):
    s = math.sqrt(0.5)
    row = one(spark, g.slope_degrees(F.lit(s)), g.azimuth_degrees(F.lit(0.0), F.lit(-s)), g.azimuth_degrees(F.lit(0.0), F.lit(0.0)), g.slope_degrees(F.lit(1.0 + 1e-12)), g.eval_z(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    assert row[0] == pytest.approx(45) and row[1] == pytest.approx(270) and row[2] == 0 and row[3] == 0 and row[4] is None


def plane(nx, ny, nz, d):
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("nx", "ny", "nz", "d"), (nx, ny, nz, d), strict=True)])


def test_ridge_of_two_planes(spark):
    s = math.sqrt(0.5)
    line = g.intersect_planes(plane(0, -s, s, 0), plane(0, s, s, -2 * s))  # z = y and z = 2 - y meet at y = 1
    cut = g.clip_line(line, *[F.lit(float(v)) for v in (0, 0, 4, 2)])
    row = one(spark, cut.alias("c"), g.intersect_planes(plane(0, 0, 1, 0), plane(0, 0, 1, -1)).alias("none"), g.clip_line(line, *[F.lit(float(v)) for v in (0, 3, 4, 5)]).alias("miss"))
    assert sorted((row.c.x1, row.c.x2)) == pytest.approx([0, 4]) and row.c.y1 == pytest.approx(1) and row.none is None and row.miss is None


def test_text(spark):
    wkt = 'GEOGCS["a",SPHEROID["b",AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","4326"]]'
    row = one(spark, t.wkt_epsg(F.lit(wkt)), t.wkt_epsg(F.lit("none")), t.epsg_url(F.lit("EPSG:EPSG:2154")), t.part_id(F.lit(7)))
    assert tuple(row) == ("7030", None, "https://www.opengis.net/def/crs/EPSG/0/2154", "7-0")
