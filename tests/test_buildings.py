import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablework.model import MESH, POLYGON
from gablework.operators import cityjson, crop, mesh
from gablework.plans import job
from gablework.plans import reconstruct as plans
from gablework.sources import las, shapefile, vector

BOX = [(0.0, 0.0), (12.0, 0.0), (12.0, 10.0), (0.0, 10.0), (0.0, 0.0)]


def footprints(spark, rings):
    rows = [(fid, ([(float(x), float(y), 0.0) for x, y in ring], [])) for fid, ring in rings.items()]
    return spark.createDataFrame(rows, f"fid bigint, polygon {POLYGON}").withColumn("attributes", F.expr("map('a', cast(1 as variant))"))


def points(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid bigint, x double, y double, z double")


def gable(n=300, dx=0.0):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0.1, 11.9, n), rng.uniform(0.1, 9.9, n)
    return np.stack([x + dx, y, 8 - 0.25 * np.abs(y - 5)], axis=1)


@pytest.mark.parametrize("n, at50, at70", [(1, 0, 0), (2, 1, 1), (10, 5, 7), (90, 45, 62)])
def test_order_statistics(spark, n, at50, at70):
    ring = footprints(spark, {1: BOX})
    stats = crop.footprint_stats(ring, crop.crop_points(points(spark, [(1 + i / 10, 5, i) for i in range(n)]), ring)).first()
    assert (stats.n, stats.z_50p, stats.z_70p) == (n, at50, at70)


def test_no_points(spark):
    ring = footprints(spark, {1: BOX})
    row = plans.reconstruct(ring, points(spark, [(99, 99, 1)]), plans.GraphCut()).first()
    assert row.fallback == "few_points" and row.h_ground == 0 and max(v.z for v in row.lod22.vertices) == 5


@pytest.mark.parametrize("method", [plans.PlaneExtrude(), plans.Arrangement(), plans.GraphCut()], ids=lambda m: m.name)
def test_methods(spark, method):
    ring = footprints(spark, {1: BOX, 2: [(x + 20, y) for x, y in BOX], 3: [(40, 0), (41, 0), (40, 0)]})
    cloud = points(spark, np.concatenate([gable(), gable(4, 20.0)]))
    rows = {r.fid: r for r in plans.reconstruct(ring, cloud, method).collect()}
    assert rows[1].fallback is None and rows[2].fallback == "few_points" and rows[3].lod22 is None
    made = rows[1].lod22
    assert all(0 <= i < len(made.vertices) for f in made.faces for i in f.indices)
    assert all(0 <= f.semantic_index < len(made.semantics) for f in made.faces)
    if method.name != "plane-extrude":
        t = sum(len(f.indices) == 3 for f in made.faces)
        assert len(made.vertices) == 3 * t + 12 and len(made.faces) == t + 5
        assert max(v.z for v in made.vertices) == pytest.approx(8, abs=0.2)  # points near the ridge are within reach of either plane


def test_crossing_ridge_falls_back(spark):
    bent = [(0.0, 0.0), (12.0, 0.0), (12.0, 4.0), (6.0, 4.0), (6.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    ring = footprints(spark, {1: bent})
    cloud = points(spark, gable(600))
    assert plans.reconstruct(ring, cloud, plans.GraphCut()).first().fallback == "kernel"
    assert plans.reconstruct(ring, cloud, plans.GraphCut("split")).first().fallback is None


def test_cells_of_no_plane_take_the_roof_height_and_the_first_surface(spark):
    kind = "array<struct<nx:double,ny:double,nz:double,d:double>>"
    cell = "named_struct('x0', 0D, 'y0', 0D, 'x1', 12D, 'y1', 0D, 'x2', 5D, 'y2', 4D, 'plane_id', {})"
    cells = F.array(F.expr(cell.format("cast(null as int)")), F.expr(cell.format("0")))
    planes = F.expr(f"from_json('[{{\"nx\":1,\"ny\":0,\"nz\":0,\"d\":-3}}]', '{kind}')")
    made = footprints(spark, {1: BOX}).select(mesh.cell_mesh(F.col("polygon.exterior"), cells, planes, F.array(*[F.lit(4.0)] * 4), F.lit(1.0), F.lit(1.0), F.lit(6.5)).alias("m")).first().m
    assert [v.z for v in made.vertices[:6]] == [6.5, 6.5, 6.5, 1.0, 1.0, 1.0] and [f.semantic_index for f in made.faces[:2]] == [2, 2]


def test_quantised_towards_zero(spark):
    row = spark.range(1).select(*[cityjson.quantised(F.lit(v), F.lit(0.0)).alias(str(i)) for i, v in enumerate((-0.0019, 0.0019, float("nan"), 1e30, -1e30))]).first()
    assert tuple(row) == (-1, 1, 0, 2**63 - 1, -(2**63))


def test_lines(spark, tmp_path):
    ring = footprints(spark, {1: BOX, 2: [(40, 0), (41, 0), (40, 0)]})
    made = plans.flat_buildings(ring, points(spark, gable()))
    lines = cityjson.city_lines(made, crop.dataset_centroid(ring), date="2024-01-01")
    cityjson.write_city(lines, str(tmp_path / "out"), single_file=True)
    text = [json.loads(x) for x in spark.read.text(str(tmp_path / "out")).toPandas()["value"]]
    assert text[0]["type"] == "CityJSON" and [x["id"] for x in text[1:]] == ["1", "2"]
    assert text[2]["CityObjects"] == {} and text[2]["vertices"] == []
    solid = text[1]["CityObjects"]["1-0"]["geometry"][0]
    assert len(solid["boundaries"][0]) == len(solid["semantics"]["values"][0]) == 6
    shift = text[0]["transform"]["translate"]
    assert text[1]["vertices"][0][0] * 0.001 + shift[0] == pytest.approx(0, abs=1e-3)
    assert cityjson.run_summary(made).first().asDict() == {"succeeded": 1, "failed": 1}


def test_volume_and_extent(spark):
    ring = footprints(spark, {1: BOX})
    flat = ring.select(mesh.flat_roof(F.col("polygon.exterior"), F.lit(0.0), F.lit(2.0)).alias("m"))
    row = flat.select(mesh.volume(F.col("m")).alias("v"), mesh.extent(F.col("m")).alias("e"), F.lit(None).cast(MESH).alias("none")).first()
    assert row.v == pytest.approx(240) and tuple(row.e) == (0, 0, 0, 12, 10, 2)


def test_las_round_trip(spark, tmp_path):
    xyz = np.round(gable() + [900_000, 6_500_000, 0], 4)
    (tmp_path / "a.las").write_bytes(las.encode_las(xyz, epsg=2154))
    back = las.scan_las(spark, str(tmp_path / "a.las")).toPandas()
    assert np.allclose(back[["x", "y", "z"]].to_numpy(), xyz, atol=1e-9) and back["pid"].is_unique
    (tmp_path / "b.las").write_bytes(las.encode_las(xyz))
    assert las.scan_las(spark, str(tmp_path / "*.las")).select("pid").distinct().count() == 2 * len(xyz)
    assert las.scan_las_crs(spark, str(tmp_path / "a.las")).first().epsg == "2154"
    with pytest.raises(las.LasError):
        las.decode_points(b"LASF" + bytes(100))
    packed = bytearray(las.encode_las(xyz))
    packed[104] |= 0x80
    with pytest.raises(las.LasError, match="LAZ"):
        las.decode_points(bytes(packed))
    with pytest.raises(Exception, match="(?i)path"):
        las.scan_las(spark, str(tmp_path / "none.las")).count()


def wkb(rings, kind=3):
    import struct

    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    one = b"\x01" + struct.pack("<II", 3, len(rings)) + b"".join(map(ring, rings))
    return one if kind == 3 else b"\x01" + struct.pack("<II", 6, 2) + one + one


def test_geopackage(spark, tmp_path):
    import sqlite3

    path = tmp_path / "f.gpkg"
    with sqlite3.connect(path) as base:
        base.executescript("""create table gpkg_contents (table_name text); create table gpkg_geometry_columns (table_name text, column_name text, srs_id int);
            create table gpkg_spatial_ref_sys (srs_id int, organization_coordsys_id int); insert into gpkg_contents values ('b');
            insert into gpkg_geometry_columns values ('b', 'geom', 2154); insert into gpkg_spatial_ref_sys values (2154, 2154);
            create table b (fid integer primary key, geom blob, name text, floors int, height real, day blob)""")
        head = b"GP\x00\x01" + bytes(4)
        base.execute("insert into b values (5, ?, 'x', 3, 2.5, ?)", (head + wkb([BOX]), b"1"))
        base.execute("insert into b values (6, ?, null, null, null, null)", (head + wkb([BOX], 6),))
        base.execute("insert into b values (7, null, 'y', 1, 1.0, null)")
    rows = {r.fid: r for r in vector.scan_geopackage(spark, str(path)).select("fid", "polygon", F.to_json("attributes").alias("a")).collect()}
    assert set(rows) == {"5", "6"} and len(rows["6"].polygon.exterior) == 5
    assert json.loads(rows["5"].a) == {"name": "x", "floors": 3, "height": 2.5} and json.loads(rows["6"].a) == {}
    assert vector.scan_geopackage_crs(spark, str(path)).first().epsg == "2154"


def test_geojson_and_wkt(spark, tmp_path):
    ring = [list(p) for p in BOX]
    features = [{"type": "Feature", "id": 9, "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"n": 1, "none": None}}, {"type": "Feature", "geometry": None, "properties": {}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {}}]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = vector.scan_geojson(spark, str(tmp_path / "f.geojson")).select("fid", F.to_json("attributes").alias("a")).collect()
    assert [tuple(r) for r in rows] == [("9", '{"n":1}')]
    assert vector.wkt_rings("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))") == [[[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 0, 0]]]
    assert vector.wkt_rings("POLYGON EMPTY") == vector.wkt_rings(None) == vector.wkt_rings("LINESTRING (0 0, 1 1)") == []


def test_shapefile(spark, tmp_path):
    hole = [(4.0, 3.0, 1.0), (8.0, 3.0, 1.0), (8.0, 7.0, 1.0), (4.0, 7.0, 1.0), (4.0, 3.0, 1.0)]
    box = [(x, y, 2.0) for x, y in BOX]
    far = [(x + 50, y, 0.0) for x, y in BOX]
    shp, dbf = shapefile.encode_shapefile([([box, hole], {"name": "ü", "n": 3}), ([], {"name": "none"}), ([box], {"h": 2.5, "n": -1}), ([box, far], {})])
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(dbf)
    (tmp_path / "a.prj").write_text('PROJCS["x",AUTHORITY["EPSG","2154"]]')
    rows = {r.fid: r for r in shapefile.scan_shapefile(spark, str(tmp_path)).select("fid", "polygon", F.to_json("attributes").alias("a")).collect()}
    assert sorted(rows) == ["0", "2", "3"] and json.loads(rows["0"].a) == {"name": "ü", "n": 3} and json.loads(rows["2"].a) == {"h": 2.5, "n": -1}
    assert len(rows["0"].polygon.interiors) == 1 and not rows["3"].polygon.interiors and {(p.x, p.y, p.z) for p in rows["0"].polygon.exterior} == set(box)
    assert shapefile.scan_shapefile_crs(spark, str(tmp_path)).first().epsg == "2154"
    ground, epsg = job.read_footprints(spark, str(tmp_path / "a.shp"))
    assert epsg == "2154" and ground.count() == 3
    with pytest.raises(vector.VectorError):
        list(shapefile.shapes(b"none"))
    with pytest.raises(vector.VectorError):
        list(shapefile.shapes(shp[:-9]))


def test_shapefile_outer_rings_run_clockwise(spark):
    shp, _ = shapefile.encode_shapefile([([[(x, y, 0.0) for x, y in BOX]], {})])
    (rings,) = shapefile.shapes(shp)
    assert shapefile._turn(np.array(rings[0])) < 0


def test_geojson_crs():
    crs = lambda name: json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": name}}, "features": []})
    assert [vector.geojson_epsg(crs(n)) for n in ("urn:ogc:def:crs:EPSG::2154", "EPSG:3035", "urn:ogc:def:crs:EPSG:9.9.1:4258", "urn:ogc:def:crs:OGC:1.3:CRS84", "local")] == ["2154", "3035", "4258", "4326", None]
    assert vector.geojson_epsg('{"type": "Feature"}\n{"type": "Feature"}') == vector.geojson_epsg("") == "4326"


def test_job(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las.encode_las(gable()))
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "Feature", "id": 1, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in BOX]]}, "properties": {}}))
    done = job.run(spark, str(tmp_path / "f.geojson"), str(tmp_path / "a.las"), str(tmp_path), "arrangement", "2024-01-01", single_file=True)
    assert done == {"succeeded": 1, "failed": 0}
    assert len(spark.read.text(str(tmp_path / "output.city.jsonl")).collect()) == 2


def test_streaming_heights(spark, tmp_path):
    from gablework.streaming.heights import running_heights

    ring = footprints(spark, {1: BOX})
    points(spark, gable()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pid bigint, x double, y double, z double").parquet(str(tmp_path / "in"))
    q = running_heights(stream, ring).writeStream.outputMode("complete").format("memory").queryName("heights").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("heights").first().n == 300
