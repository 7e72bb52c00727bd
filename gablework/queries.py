"""Every operator as a query over the fixture scene, with the same result in DuckDB SQL where SQL can express it.

Values that depend on the order of floating-point sums are rounded alike on both sides; "+ 0.0" makes zeros positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gablework.fixture import FOOTPRINT_CTE, GIVEN_CTE, POINT_CTE, Fixture
from gablework.functions import geometry as g
from gablework.functions import text as t
from gablework.model import DEFAULTS, MESH, RansacConfig
from gablework.operators import cityjson, crop, labels, mesh, planes, triangulate
from gablework.plans import reconstruct as plans
from gablework.scratch import put, scratch_path, written
from gablework.sources import las, shapefile, vector

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
DATE = "2024-01-01"

EDGE = """
edge as (
  select a.fid, a.ring, a.seq, a.x as x1, a.y as y1, b.x as x2, b.y as y2
  from vert a join vert b on a.fid = b.fid and a.ring = b.ring and b.seq = a.seq + 1)"""
CROP = """
cross_count as (
  select pt.pid, pt.x, pt.y, pt.z, edge.fid, edge.ring,
    sum(case when (y1 > pt.y) <> (y2 > pt.y)
              and pt.x < (x2 - x1)*(pt.y - y1)/(case when y2 = y1 then 1.0e0 else y2 - y1 end) + x1
             then 1 else 0 end) as k
  from pt
  join (select fid as cfid, cast(floor(ox/20) as bigint) as gx, cast(floor(oy/20) as bigint) as gy from fp) cell
    on cast(floor(pt.x/20) as bigint) = cell.gx and cast(floor(pt.y/20) as bigint) = cell.gy
  join edge on edge.fid = cell.cfid
  group by pt.pid, pt.x, pt.y, pt.z, edge.fid, edge.ring),
cropped as (
  select fid, pid, x, y, z from cross_count group by fid, pid, x, y, z
  having sum(case when ring = 0 then k % 2 else 0 end) = 1
     and sum(case when ring > 0 then k % 2 else 0 end) = 0)"""
STATS = """
heights as (select fid, count(z) as n, min(z) as z_min, max(z) as z_max, avg(z) as z_mean, list_sort(list(z)) as zs from cropped group by fid),
stats as (select fp.fid, coalesce(n, 0) as n, coalesce(z_min, 0.0e0) as z_min, coalesce(z_max, 0.0e0) as z_max, coalesce(z_mean, 0.0e0) as z_mean,
  coalesce(zs[cast(floor(n/2) as int) + 1], 0.0e0) as z_50p, coalesce(zs[cast(floor(n*0.7e0) as int) + 1], 0.0e0) as z_70p
  from fp left join heights on heights.fid = fp.fid)"""
BOX = "box as (select fid, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from vert where ring = 0 group by fid)"
CENTRE = "centre as (select avg(cx) as cx, avg(cy) as cy from (select avg(x) as cx, avg(y) as cy from vert where ring = 0 group by fid))"
INLIER = """
inlier as (
  select p.fid, p.plane_id, q.pid, q.x, q.y, q.z, p.nx, p.ny, p.nz, p.d
  from plane_given p join cropped q on q.fid = p.fid
  where abs(p.nx*q.x + p.ny*q.y + p.nz*q.z + p.d) < 0.25e0)"""
CORNER = "corner as (select fid, seq, x, y, count(*) over (partition by fid) as n from vert where ring = 0 and seq < (select max(seq) from vert w where w.fid = vert.fid and w.ring = 0))"
PAIR = """
two as (
  select p.fid, p.plane_id as i, q.plane_id as j, p.nx as ux, p.ny as uy, p.nz as uz, p.d as ad, q.nx as wx, q.ny as wy, q.nz as wz, q.d as bd
  from plane_given p join plane_given q on p.fid = q.fid and p.plane_id < q.plane_id),
met as (
  select *, uy*wz - uz*wy as dx0, uz*wx - ux*wz as dy0, ux*wy - uy*wx as dz0, ux*wx + uy*wy + uz*wz as ab, ux*ux + uy*uy + uz*uz as aa, wx*wx + wy*wy + wz*wz as bb from two),
ridge as (
  select fid, i, j, dx0/sqrt(dx0*dx0 + dy0*dy0 + dz0*dz0) as dx, dy0/sqrt(dx0*dx0 + dy0*dy0 + dz0*dz0) as dy,
    ((0.0e0 - ad)*bb - (0.0e0 - bd)*ab)/(aa*bb - ab*ab)*ux + ((0.0e0 - bd)*aa - (0.0e0 - ad)*ab)/(aa*bb - ab*ab)*wx as ox,
    ((0.0e0 - ad)*bb - (0.0e0 - bd)*ab)/(aa*bb - ab*ab)*uy + ((0.0e0 - bd)*aa - (0.0e0 - ad)*ab)/(aa*bb - ab*ab)*wy as oy
  from met where sqrt(dx0*dx0 + dy0*dy0 + dz0*dz0) >= 1e-10)"""
VOTE = """
vote as (
  select e.fid, e.cell_id as site_id, e.plane_id, coalesce(v.votes, 0) as votes
  from (select k.fid, k.cell_id, p.plane_id from cell_given k join plane_given p on p.fid = k.fid) e
  left join (select k.fid, k.cell_id, i.plane_id, count(*) as votes from cell_given k join inlier i on i.fid = k.fid
    where (i.x - k.cx)*(i.x - k.cx) + (i.y - k.cy)*(i.y - k.cy) < 9.0e0 group by k.fid, k.cell_id, i.plane_id) v
  on v.fid = e.fid and v.cell_id = e.cell_id and v.plane_id = e.plane_id)"""
COST = """
cost as (
  select e.fid, e.cell_id as site_id, e.plane_id, coalesce(v.support, 0) as support, coalesce(v.cost, 10.0e0) as cost
  from (select k.fid, k.cell_id, p.plane_id from cell_given k join plane_given p on p.fid = k.fid) e
  left join (select k.fid, k.cell_id, i.plane_id, count(*) as support,
      avg((i.z - (0.0e0 - (i.nx*i.x + i.ny*i.y + i.d))/i.nz) * (i.z - (0.0e0 - (i.nx*i.x + i.ny*i.y + i.d))/i.nz)) as cost
    from cell_given k join inlier i on i.fid = k.fid
    where (i.x - k.cx)*(i.x - k.cx) + (i.y - k.cy)*(i.y - k.cy) < 4.0e0 group by k.fid, k.cell_id, i.plane_id) v
  on v.fid = e.fid and v.cell_id = e.cell_id and v.plane_id = e.plane_id)"""
SCENE = [FOOTPRINT_CTE, EDGE, POINT_CTE, CROP]
GIVEN = [*SCENE, GIVEN_CTE, INLIER]


def sql(ctes: list[str], select: str) -> str:
    return "with " + ",".join(ctes) + "\n" + select


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r(value: Column, digits: int) -> Column:
    return F.round(value, digits) + F.lit(0.0)


def _cropped(f: Fixture) -> DataFrame:
    return crop.crop_points(f.points, f.footprints)


def _inliers(f: Fixture) -> DataFrame:
    return planes.plane_inliers(f.planes, _cropped(f))


def _flat(f: Fixture) -> DataFrame:
    return plans.flat_buildings(f.footprints, f.points)


# sources


def _las_files(f: Fixture) -> str:
    """The cloud as LAS files in the scratch folder, one for each last digit of pid."""

    def encoded(group: pa.Table) -> pa.Table:
        xyz = np.stack([group[k].to_numpy() for k in "xyz"], axis=1)
        return pa.table({"file": group["file"][:1], "data": pa.array([las.encode_las(xyz, epsg=2154)], type=pa.binary())})

    folder = scratch_path(f.spark, "cloud")
    parts = f.points.withColumn("file", c("pid") % 10).select("file", "x", "y", "z").groupBy("file").applyInArrow(encoded, "file long, data binary")
    for row in parts.toLocalIterator():
        put(f.spark, f"{folder}/{row['file']}.las", bytes(row["data"]))
    return folder


@query("scan_las", sql([FOOTPRINT_CTE, POINT_CTE], "select round(x, 4) + 0.0e0 as x, round(y, 4) + 0.0e0 as y, round(z, 4) + 0.0e0 as z from pt"))
def _(f):
    return las.scan_las(f.spark, _las_files(f)).select(*[r(c(k), 4).alias(k) for k in "xyz"])


@query("las_files_crs", sql([FOOTPRINT_CTE, POINT_CTE], "select distinct cast(pid % 10 as varchar) || '.las' as file, '2154' as epsg from pt"))
def _(f):
    return las.scan_las_crs(f.spark, _las_files(f)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "epsg")


_WKT_SQL = """select s_suppkey as fid, case s_suppkey % 3 when 0 then 'PROJCS["a",GEOGCS["b",AUTHORITY["EPSG","' || cast(4000 + s_suppkey % 900 as varchar) || '"]],AUTHORITY["EPSG","2154"]]'
  when 1 then 'LOCAL_CS["none"]' else 'GEOGCS["b",AUTHORITY["EPSG","x7"]]' end as wkt from supplier"""
_EPSG_SQL = f"""select fid, case when regexp_full_match(regexp_extract(wkt, 'AUTHORITY\\["EPSG","([^"]*)"', 1), '[0-9]+')
  then regexp_extract(wkt, 'AUTHORITY\\["EPSG","([^"]*)"', 1) end as epsg from ({_WKT_SQL})"""


def _wkt(f: Fixture) -> DataFrame:
    return f.spark.sql(_WKT_SQL.replace("as varchar", "as string").replace("from supplier", "from {supplier}"), supplier=f.tables["supplier"])


@query("las_crs", _EPSG_SQL)
def _(f):
    return _wkt(f).select("fid", t.wkt_epsg(c("wkt")).alias("epsg"))


QUERIES["wkt_epsg"], ORACLES["wkt_epsg"] = QUERIES["las_crs"], ORACLES["las_crs"]

_VERT = sql([FOOTPRINT_CTE], "select cast(fid as varchar) as fid, ring, seq, x, y from vert")


def _vertices(footprints: DataFrame) -> DataFrame:
    rings = F.concat(F.array("polygon.exterior"), c("polygon.interiors"))
    return footprints.select("fid", F.posexplode(rings).alias("ring", "points")).select("fid", "ring", F.posexplode("points").alias("seq", "p")).select("fid", "ring", "seq", "p.x", "p.y")


@query("scan_footprints", _VERT)
def _(f):
    folder = scratch_path(f.spark, "footprints")
    vector.to_geojson(f.footprints).write.text(folder)
    return _vertices(vector.scan_geojson(f.spark, folder))


@query("scan_shapefile", "select s_suppkey as fid, s_name as name, s_acctbal as balance, case s_suppkey % 4 when 1 then 7 else 5 end as n, case s_suppkey % 4 when 2 then 1 else 0 end as holes from supplier")
def _(f):
    def encoded(group: pa.Table) -> pa.Table:
        point = lambda p: (p["x"], p["y"], p["z"])
        rows = [([[point(p) for p in ring] for ring in (r["polygon"]["exterior"], *r["polygon"]["interiors"])], {"id": r["fid"], "name": r["name"], "balance": r["balance"]}) for r in group.to_pylist()]
        shp, dbf = shapefile.encode_shapefile(rows)
        return pa.table({"file": group["file"][:1], "shp": pa.array([shp], type=pa.binary()), "dbf": pa.array([dbf], type=pa.binary())})

    folder, value = scratch_path(f.spark, "shapes"), lambda k, kind: F.try_variant_get(F.try_element_at("attributes", F.lit(k)), "$", kind)
    parts = f.footprints.select((c("fid") % 5).alias("file"), "fid", "polygon", value("name", "string").alias("name"), value("balance", "double").alias("balance"))
    for row in parts.groupBy("file").applyInArrow(encoded, "file long, shp binary, dbf binary").toLocalIterator():
        put(f.spark, f"{folder}/{row['file']}.shp", bytes(row["shp"]))
        put(f.spark, f"{folder}/{row['file']}.dbf", bytes(row["dbf"]))
    back = shapefile.scan_shapefile(f.spark, folder)
    return back.select(value("id", "bigint").alias("fid"), value("name", "string").alias("name"), value("balance", "double").alias("balance"), F.size("polygon.exterior").alias("n"), F.size("polygon.interiors").alias("holes"))


@query("footprint_crs", "select * from (values ('a.geojson', '4326'), ('b.geojson', '2154'), ('c.gpkg', '3035')) v(file, epsg)")
def _(f):
    folder = scratch_path(f.spark, "crs")
    put(f.spark, f"{folder}/a.geojson", b'{"type": "FeatureCollection", "features": []}')
    put(f.spark, f"{folder}/b.geojson", b'{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::2154"}}, "features": []}')
    put(f.spark, f"{folder}/c.gpkg", vector.empty_geopackage(3035))
    found = vector.scan_geojson_crs(f.spark, f"{folder}/*.geojson").unionAll(vector.scan_geopackage_crs(f.spark, f"{folder}/*.gpkg"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "epsg")


@query("footprints_of_wkt", _VERT)
def _(f):
    texts = f.footprints.select("fid", vector.to_wkt(c("polygon")).alias("wkt"))
    return _vertices(vector.from_wkt(texts))


@query("ring_vertices", sql([FOOTPRINT_CTE], "select fid, ring, seq, x, y from vert"))
def _(f):
    return _vertices(f.footprints)


@query("rings_split", sql([FOOTPRINT_CTE], "select fid, count(*) filter (where ring = 0) as n_exterior, count(distinct ring) filter (where ring > 0) as n_holes from vert group by fid"))
def _(f):
    return f.footprints.select("fid", F.size("polygon.exterior").alias("n_exterior"), F.size("polygon.interiors").alias("n_holes"))


@query("geom_normalise", sql([FOOTPRINT_CTE], "select cast(v.fid as varchar) as fid, count(*) as n from vert v join fp on fp.fid = v.fid where shape < 3 and ring = 0 group by v.fid"))
def _(f):
    whole = vector.to_wkt(c("polygon"))
    body = F.expr("substring(w, 9)")
    kinds = f.footprints.select("fid", whole.alias("w")).select("fid", F.when(c("fid") % 4 == 3, F.lit("POINT (1 2)")).when(c("fid") % 4 == 1, F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(", ((0 0, 1 0, 1 1, 0 0)))"))).otherwise(c("w")).alias("wkt"))
    return vector.from_wkt(kinds).select("fid", F.size("polygon.exterior").alias("n"))


@query("attr_coerce", "select s_suppkey as fid, s_name as name, s_nationkey as nation, case when s_acctbal >= 0 then s_acctbal end as balance, case when s_acctbal >= 0 then 3 else 2 end as n_keys from supplier")
def _(f):
    rows = f.tables["supplier"]
    found = rows.select(c("s_suppkey").alias("fid"), t.attribute_map({"name": c("s_name"), "nation": c("s_nationkey"), "balance": F.when(c("s_acctbal") >= 0, c("s_acctbal"))}).alias("a"))
    get = lambda k, kind: F.try_variant_get(F.try_element_at("a", F.lit(k)), "$", kind)
    return found.select("fid", get("name", "string").alias("name"), get("nation", "bigint").alias("nation"), get("balance", "double").alias("balance"), F.size(F.map_keys("a")).alias("n_keys"))


@query("map_iter", "select s_suppkey as fid, unnest(['balance', 'name', 'nation']) as key, unnest([to_json(s_acctbal), to_json(s_name), to_json(s_nationkey)])::varchar as value from supplier")
def _(f):
    return f.footprints.select("fid", F.explode(F.map_entries("attributes")).alias("e")).select("fid", "e.key", F.to_json("e.value").alias("value"))


@query("map_insert", "select s_suppkey as fid, 4 as n_keys, 'x' as name, true as seen from supplier")
def _(f):
    more = t.with_attribute(t.with_attribute(c("attributes"), "name", F.lit("x")), "seen", F.lit(True))
    a = f.footprints.select("fid", more.alias("a"))
    return a.select("fid", F.size(F.map_keys("a")).alias("n_keys"), F.variant_get(F.element_at("a", "name"), "$", "string").alias("name"), F.variant_get(F.element_at("a", "seen"), "$", "boolean").alias("seen"))


@query("errors", "select 'LasError' as kind, 'not a LAS file' as message union all select 'LasError', 'the file ends within its points' union all select 'VectorError', 'not a GeoPackage geometry'")
def _(f):
    found = []
    for read, data in ((las.decode_points, b"none"), (las.decode_points, las.encode_las(np.zeros((2, 3)))[:-5]), (vector._gpkg_wkb, b"none")):
        try:
            read(data)
        except ValueError as e:
            found.append((type(e).__name__, str(e)))
    return f.spark.createDataFrame(found, "kind string, message string")


# polygons


@query("bbox_2d", sql([FOOTPRINT_CTE, BOX], "select * from box"))
def _(f):
    return crop.boxes(f.footprints)


@query("area_2d", sql([FOOTPRINT_CTE, EDGE], "select fid, round(abs(sum(x1*y2 - x2*y1))/2, 6) as area from edge where ring = 0 group by fid"))
def _(f):
    return f.footprints.select("fid", r(F.abs(g.signed_area(c("polygon.exterior"))), 6).alias("area"))


@query("centroid_2d", sql([FOOTPRINT_CTE], "select fid, round(avg(x), 6) as cx, round(avg(y), 6) as cy from vert where ring = 0 group by fid"))
def _(f):
    return f.footprints.select("fid", g.ring_centroid(c("polygon.exterior")).alias("m")).select("fid", r(c("m.cx"), 6).alias("cx"), r(c("m.cy"), 6).alias("cy"))


@query("dataset_centroid", sql([FOOTPRINT_CTE, CENTRE], "select round(cx, 6) as cx, round(cy, 6) as cy from centre"))
def _(f):
    return crop.dataset_centroid(f.footprints).select(r(c("cx"), 6).alias("cx"), r(c("cy"), 6).alias("cy"))


@query("edge_ring", sql([FOOTPRINT_CTE, EDGE], "select * from edge"))
def _(f):
    return crop.footprint_edges(f.footprints)


@query("polygon_is_empty", sql([FOOTPRINT_CTE], "select fid, false as is_empty from fp"))
def _(f):
    return f.footprints.select("fid", (F.size("polygon.exterior") == 0).alias("is_empty"))


@query("reverse_ring", sql([FOOTPRINT_CTE], "select fid, max(seq) over (partition by fid) - seq as place, x, y from vert where ring = 0"))
def _(f):
    return f.footprints.select("fid", F.posexplode(F.reverse("polygon.exterior")).alias("place", "p")).select("fid", "place", "p.x", "p.y")


# crop and heights


@query("bbox_filter", sql([*SCENE[:1], POINT_CTE, BOX], "select fid, pid from pt join box on x between xmin - 2.0e0 and xmax + 2.0e0 and y between ymin - 2.0e0 and ymax + 2.0e0"))
def _(f):
    return crop.bbox_filter(f.points, f.footprints).select("fid", "pid")


@query("point_in_ring", sql(SCENE, "select fid, pid from cross_count where ring = 0 and k % 2 = 1"))
def _(f):
    near = crop.bbox_filter(f.points, f.footprints)
    return near.where(g.ring_contains(c("polygon.exterior"), c("x"), c("y"))).select("fid", "pid")


@query("point_in_polygon", sql(SCENE, "select fid, pid from cropped"))
def _(f):
    return _cropped(f).select("fid", "pid")


@query("crop_points", sql(SCENE, "select fid, pid, x, y, z from cropped"))
def _(f):
    return _cropped(f)


@query("z_stats", sql([*SCENE, STATS], "select fid, n, z_min, z_max, round(z_mean, 9) as z_mean, z_50p, z_70p from stats"))
def _(f):
    return crop.footprint_stats(f.footprints, _cropped(f)).withColumn("z_mean", r(c("z_mean"), 9))


@query("h_ground", sql([*SCENE, STATS], "select fid, z_min as h_ground from stats"))
def _(f):
    return crop.footprint_stats(f.footprints, _cropped(f)).select("fid", c("z_min").alias("h_ground"))


@query("flat_height", sql([*SCENE, STATS], "select fid, case when n > 0 then z_70p else z_min + 5.0e0 end as h_roof from stats"))
def _(f):
    return crop.footprint_stats(f.footprints, _cropped(f)).withColumn("h_ground", c("z_min")).select("fid", crop.flat_height().alias("h_roof"))


@query("min_points_guard", sql([*SCENE, STATS], "select fid, n < 5 as is_flat from stats"))
def _(f):
    return crop.footprint_stats(f.footprints, _cropped(f)).select("fid", (c("n") < 5).alias("is_flat"))


@query("sort_z", sql(SCENE, "select fid, row_number() over (partition by fid order by z, pid) - 1 as place, z from cropped"))
def _(f):
    return _cropped(f).groupBy("fid").agg(F.sort_array(F.collect_list("z")).alias("zs")).select("fid", F.posexplode("zs").alias("place", "z"))


@query("sort_xy", sql(SCENE, "select fid, row_number() over (partition by fid order by x, y, pid) - 1 as place, x, y from cropped"))
def _(f):
    return _cropped(f).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("ps")).select("fid", F.posexplode("ps").alias("place", "p")).select("fid", "place", "p.x", "p.y")


@query("dedup_xy", sql(SCENE, "select distinct fid, x, y from cropped"))
def _(f):
    return _cropped(f).select("fid", "x", "y").distinct()


@query("cloud_union", sql([FOOTPRINT_CTE, POINT_CTE], "select pid, x, y, z from pt union all select pid + 1000000000, x, y, z from pt where z > 8.0e0"))
def _(f):
    return f.points.unionByName(f.points.where("z > 8.0").withColumn("pid", c("pid") + 1_000_000_000))


# planes


def _plane_query(name: str, select: str, value):
    @query(name, sql([FOOTPRINT_CTE, GIVEN_CTE], f"select fid, plane_id, {select} from plane_given join (select fid as k, ox, oy from fp) o on o.k = fid"))
    def _(f):
        rows = f.planes.join(f.footprints.select("fid", F.get("polygon.exterior", F.lit(0)).alias("v"), (c("fid") % 4 == 3).cast("int").alias("skew")), "fid")
        return rows.withColumn("ox", c("v.x") - c("skew")).withColumn("oy", c("v.y")).select("fid", "plane_id", value().alias(name))


_n = lambda: (c("nx"), c("ny"), c("nz"))
_at = lambda: (c("ox") + 5.0, c("oy") + 4.0)
_plane_query("plane_slope", "round(degrees(acos(least(1.0e0, abs(nz)))), 6) + 0.0e0 as plane_slope", lambda: r(g.slope_degrees(c("nz")), 6))
_plane_query("plane_azimuth", "case when nx = 0 and ny = 0 then 0.0e0 when atan2(ny, nx) < 0 then round(degrees(atan2(ny, nx)) + 360, 6) else round(degrees(atan2(ny, nx)), 6) + 0.0e0 end as plane_azimuth", lambda: r(g.azimuth_degrees(c("nx"), c("ny")), 6))
_plane_query("plane_eval_z", "round((0.0e0 - (nx*(ox + 5.0e0) + ny*(oy + 4.0e0) + d))/nz, 6) + 0.0e0 as plane_eval_z", lambda: r(g.eval_z(*_n(), c("d"), *_at()), 6))
_plane_query("plane_distance", "round(abs(nx*(ox + 5.0e0) + ny*(oy + 4.0e0) + nz*9.0e0 + d), 6) + 0.0e0 as plane_distance", lambda: r(g.plane_distance(*_n(), c("d"), *_at(), F.lit(9.0)), 6))
_plane_query("plane_signed_distance", "round(nx*(ox + 5.0e0) + ny*(oy + 4.0e0) + nz*1.0e0 + d, 6) + 0.0e0 as plane_signed_distance", lambda: r(g.signed_distance(*_n(), c("d"), *_at(), F.lit(1.0)), 6))
_plane_query("plane_from_point", "round(0.0e0 - (nx*(ox + 5.0e0) + ny*(oy + 4.0e0) + nz*2.0e0), 6) + 0.0e0 as plane_from_point", lambda: r(g.plane_from_point(*_n(), *_at(), F.lit(2.0)), 6))
_plane_query("plane_near_horizontal", "degrees(acos(least(1.0e0, abs(nz)))) < 12.0e0 as plane_near_horizontal", lambda: g.is_near_horizontal(c("nz"), 12.0))
_plane_query("plane_near_vertical", "degrees(acos(least(1.0e0, abs(nz)))) > 20.0e0 as plane_near_vertical", lambda: g.is_near_vertical(c("nz"), 70.0))


@query("inlier_filter", sql(GIVEN, "select fid, plane_id, pid from inlier"))
def _(f):
    return _inliers(f).select("fid", "plane_id", "pid")


@query("hull_in_footprint", sql(GIVEN, "select fid, plane_id, count(*) as n from inlier group by fid, plane_id"))
def _(f):
    inside = _inliers(f).join(f.footprints, "fid").where(g.polygon_contains(c("polygon"), c("x"), c("y")))
    return inside.groupBy("fid", "plane_id").agg(F.count("*").alias("n"))


@query("remaining_points", sql(GIVEN, "select fid, pid from cropped where (fid, pid) not in (select (fid, pid) from inlier)"))
def _(f):
    return planes.remaining_points(_cropped(f), _inliers(f)).select("fid", "pid")


@query("point_except", sql(GIVEN, "select fid, pid from cropped except select fid, pid from inlier where plane_id = 0"))
def _(f):
    return planes.remaining_points(_cropped(f), _inliers(f).where("plane_id = 0")).select("fid", "pid")


@query("inlier_union", sql(GIVEN, "select fid, pid from inlier where plane_id = 0 union all select fid, pid from inlier where plane_id = 1"))
def _(f):
    own = _inliers(f).select("fid", "pid", "plane_id")
    return own.where("plane_id = 0").unionByName(own.where("plane_id = 1")).drop("plane_id")


@query("distinct_inliers", sql(GIVEN, "select distinct fid, pid from inlier"))
def _(f):
    return _inliers(f).select("fid", "pid").distinct()


@query("inlier_centroid", sql(GIVEN, "select fid, plane_id, count(*) as n, round(avg(x), 9) as mx, round(avg(y), 9) as my, round(avg(z), 9) as mz from inlier group by fid, plane_id"))
def _(f):
    return planes.inlier_centroids(_inliers(f)).select("fid", "plane_id", "n", *[r(c(k), 9).alias(k) for k in ("mx", "my", "mz")])


_COV = """
mean as (select fid, plane_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz from inlier group by fid, plane_id),
cov as (select i.fid, i.plane_id, n, mx, my, mz, sum((x - mx)*(x - mx)) as xx, sum((x - mx)*(y - my)) as xy, sum((x - mx)*(z - mz)) as xz,
  sum((y - my)*(y - my)) as yy, sum((y - my)*(z - mz)) as yz, sum((z - mz)*(z - mz)) as zz
  from inlier i join mean m on m.fid = i.fid and m.plane_id = i.plane_id group by i.fid, i.plane_id, n, mx, my, mz)"""


@query("covariance3", sql([*GIVEN, _COV], "select fid, plane_id, " + ", ".join(f"round({k}, 4) + 0.0e0 as {k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz")) + " from cov"))
def _(f):
    return planes.covariances(_inliers(f)).select("fid", "plane_id", *[r(c(k), 4).alias(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")])


_FIT = """
q1 as (select *, (xx + yy + zz)/3 as q from cov where n >= 3),
q2 as (select *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz))/6) as p from q1),
q3 as (select *, greatest(-1.0e0, least(1.0e0, ((xx-q)/p*((yy-q)/p*(zz-q)/p - yz/p*yz/p) - xy/p*(xy/p*(zz-q)/p - yz/p*xz/p) + xz/p*(xy/p*yz/p - (yy-q)/p*xz/p))/2)) as h from q2 where p > 0),
q4 as (select *, q + 2*p*cos(acos(h)/3 + 2*pi()/3) as lo from q3),
q5 as (select *, xy*yz - xz*(yy-lo) as vx, xz*xy - (xx-lo)*yz as vy, (xx-lo)*(yy-lo) - xy*xy as vz from q4),
fit as (select fid, plane_id, n, mx, my, mz, lo, vx*sgn/len as nx, vy*sgn/len as ny, vz*sgn/len as nz from
  (select *, sqrt(vx*vx + vy*vy + vz*vz) as len, case when vz < 0 then -1.0e0 else 1.0e0 end as sgn from q5) where len > 0)"""


@query("fit_plane_ls", sql([*GIVEN, _COV, _FIT], "select fid, plane_id, n, round(nx, 5) + 0.0e0 as nx, round(ny, 5) + 0.0e0 as ny, round(nz, 5) + 0.0e0 as nz from fit"))
def _(f):
    return planes.fitted_planes(_inliers(f)).select("fid", "plane_id", "n", *[r(c(k), 5).alias(k) for k in ("nx", "ny", "nz")])


@query("rmse", sql([*GIVEN, _COV, _FIT], "select fid, plane_id, round(sqrt(greatest(0.0e0, lo)/n), 5) + 0.0e0 as rmse from fit"))
def _(f):
    return planes.fitted_planes(_inliers(f)).select("fid", "plane_id", r(c("rmse"), 5).alias("rmse"))


@query("min_eigen", sql([*GIVEN, _COV, _FIT], "select fid, plane_id, round(lo, 4) + 0.0e0 as least from fit"))
def _(f):
    return planes.fitted_planes(_inliers(f)).select("fid", "plane_id", r(c("rmse") * c("rmse") * c("n"), 4).alias("least"))


@query("fit_3pts", sql([*SCENE, "three as (select fid, x, y, z, row_number() over (partition by fid order by pid) as k from cropped)", """
w as (select a.fid, a.x, a.y, a.z, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, e.x - a.x as vx, e.y - a.y as vy, e.z - a.z as vz from three a join three b on b.fid = a.fid join three e on e.fid = a.fid where a.k = 1 and b.k = 2 and e.k = 3),
m as (select *, uy*vz - uz*vy as px, uz*vx - ux*vz as py, ux*vy - uy*vx as pz from w)"""],
    "select fid, round(px/l, 6) + 0.0e0 as nx, round(py/l, 6) + 0.0e0 as ny, round(pz/l, 6) + 0.0e0 as nz from (select *, sqrt(px*px + py*py + pz*pz) as l from m) where l >= 1e-10"))
def _(f):
    pts = _cropped(f).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("pid", "x", "y", "z"))).alias("p")).where(F.size("p") >= 3)
    fit = g.fit_3pts(*[F.get("p", F.lit(k)) for k in range(3)])
    return pts.select("fid", fit.alias("n")).where("n is not null").select("fid", *[r(c(f"n.{k}"), 6).alias(k) for k in ("nx", "ny", "nz")])


@query("plane_pairs", sql([FOOTPRINT_CTE, GIVEN_CTE, PAIR], "select fid, i, j from two"))
def _(f):
    return planes.plane_pairs(f.planes).select("fid", "i", "j")


@query("intersect_planes", sql([FOOTPRINT_CTE, GIVEN_CTE, PAIR], "select fid, i, j, round(abs(dx), 6) + 0.0e0 as dx, round(abs(dy), 6) + 0.0e0 as dy, round(oy, 4) + 0.0e0 as oy from ridge"))
def _(f):
    met = planes.plane_pairs(f.planes).withColumn("l", g.intersect_planes(c("a"), c("b"))).where("l is not null")
    return met.select("fid", "i", "j", r(F.abs("l.dx"), 6).alias("dx"), r(F.abs("l.dy"), 6).alias("dy"), r(c("l.oy"), 4).alias("oy"))


_RIDGE = "select l.fid, i, j, round(xmin, 4) + 0.0e0 as xa, round(xmax, 4) + 0.0e0 as xb, round(oy, 4) + 0.0e0 as y from ridge l join box on box.fid = l.fid where oy between ymin and ymax and abs(dx) > 0.999999e0"


@query("ridgelines", sql([FOOTPRINT_CTE, GIVEN_CTE, PAIR, BOX], _RIDGE))
def _(f):
    lines = planes.ridgelines(f.planes, crop.boxes(f.footprints))
    return lines.select("fid", "i", "j", r(F.least("x1", "x2"), 4).alias("xa"), r(F.greatest("x1", "x2"), 4).alias("xb"), r((c("y1") + c("y2")) / 2, 4).alias("y"))


QUERIES["clip_line"], ORACLES["clip_line"] = QUERIES["ridgelines"], ORACLES["ridgelines"]

_ROUND = f"""
ranked as (select fid, pid, x, y, z, row_number() over (partition by fid order by pid) - 1 as k, count(*) over (partition by fid) as n from cropped),
it as (select fid, n, i, (i*7919 + fid*31) % 10007 % n as k0, (i*104729 + fid*17 + 1) % 20011 % n as k1, (i*1299709 + fid*7 + 2) % 30011 % n as k2
  from (select distinct fid, n from ranked where n >= 3) b, (select unnest(range({RansacConfig.max_iterations})) as i) s),
hyp as (select it.fid, it.i, a.x as px, a.y as py, a.z as pz, (b.y-a.y)*(e.z-a.z) - (b.z-a.z)*(e.y-a.y) as nx, (b.z-a.z)*(e.x-a.x) - (b.x-a.x)*(e.z-a.z) as ny, (b.x-a.x)*(e.y-a.y) - (b.y-a.y)*(e.x-a.x) as nz
  from it join ranked a on a.fid = it.fid and a.k = k0 join ranked b on b.fid = it.fid and b.k = k1 join ranked e on e.fid = it.fid and e.k = k2 where k0 <> k1 and k0 <> k2 and k1 <> k2),
unit as (select fid, i, nx/l as nx, ny/l as ny, nz/l as nz, 0.0e0 - (nx/l*px + ny/l*py + nz/l*pz) as d from (select *, sqrt(nx*nx + ny*ny + nz*nz) as l from hyp) where l >= 1e-10),
held as (select u.fid, u.i, count(*) as n_inliers from unit u join cropped q on q.fid = u.fid where not degrees(acos(least(1.0e0, abs(nz)))) > 20 and abs(nx*q.x + ny*q.y + nz*q.z + d) < 0.25e0 group by u.fid, u.i)"""


@query("best_hypothesis", sql([*SCENE, _ROUND], "select fid, max(n_inliers)::int as n_inliers from held group by fid"))
def _(f):
    return planes.hypothesis_round(_cropped(f))


_ONE = """
top as (select fid, arg_min(i, (0 - n_inliers, i)) as i, max(n_inliers) as n from held group by fid having max(n_inliers) >= 10),
inlier as (select q.fid, 0 as plane_id, q.pid, q.x, q.y, q.z from top join unit u on u.fid = top.fid and u.i = top.i join cropped q on q.fid = u.fid where abs(nx*q.x + ny*q.y + nz*q.z + d) < 0.25e0)"""


@query("ransac_one", sql([*SCENE, _ROUND, _ONE, _COV, _FIT, "flat as (select *, 0.0e0 - (nx*mx + ny*my + nz*mz) as d from fit where not degrees(acos(least(1.0e0, abs(nz)))) > 20)"],
    "select flat.fid, round(nx, 5) + 0.0e0 as nx, round(ny, 5) + 0.0e0 as ny, round(nz, 5) + 0.0e0 as nz, round(sqrt(greatest(0.0e0, lo)/n), 5) + 0.0e0 as rmse, count(*)::int as n_inliers from flat join cropped q on q.fid = flat.fid where abs(nx*q.x + ny*q.y + nz*q.z + d) < 0.25e0 group by all having count(*) >= 10"))
def _(f):
    return planes.ransac_round(_cropped(f)).select("fid", *[r(c(k), 5).alias(k) for k in ("nx", "ny", "nz", "rmse")], "n_inliers")


@query("detect_planes")
def _(f):
    return planes.detect_planes(_cropped(f)).drop("inliers")


@query("limit_planes")
def _(f):
    return planes.detect_planes(_cropped(f), most=2).groupBy("fid").agg(F.max("plane_id").alias("last"))


@query("early_stop", sql([*SCENE, STATS], "select count(*) as buildings_without_planes from stats where n < 10000000"))
def _(f):
    none = planes.detect_planes(_cropped(f), RansacConfig(min_points=10_000_000))
    return f.footprints.join(none, "fid", "left_anti").agg(F.count("*").alias("buildings_without_planes"))


_MERGED = """
centre as (select fid, plane_id, avg(x) as mx, avg(y) as my, avg(z) as mz from inlier group by fid, plane_id),
joined as (select two.fid, j from two join centre m on m.fid = two.fid and m.plane_id = i where acos(least(1.0e0, abs(ux*wx + uy*wy + uz*wz))) <= radians(30.0e0) and abs(wx*mx + wy*my + wz*mz + bd) <= 1.5e0)"""
_REFIT = _COV.replace("inlier i", "merged i").replace("from inlier", "from merged")


@query("merge_planes", sql([*GIVEN, PAIR, _MERGED, "merged as (select v.fid, case when joined.j is null then v.plane_id else 0 end as plane_id, pid, x, y, z from inlier v left join joined on joined.fid = v.fid and joined.j = v.plane_id)", _REFIT, _FIT],
    """select fit.fid, plane_id, n::int as n_inliers, round(case when k > 1 then nx else gx end, 5) + 0.0e0 as nx, round(case when k > 1 then ny else gy end, 5) + 0.0e0 as ny,
      round(case when k > 1 then nz else gz end, 5) + 0.0e0 as nz, case when k > 1 then round(sqrt(greatest(0.0e0, lo)/n), 5) + 0.0e0 else 0.0e0 end as rmse
      from fit join (select fid, count(*) as k, min(nx) as gx, min(ny) as gy, min(nz) as gz from plane_given group by fid) g on g.fid = fit.fid"""))
def _(f):  # a plane alone stays as it is
    own = _given_scene(f).planes
    return planes.merge_planes(own, RansacConfig(merge_angle=30.0, merge_distance=1.5)).select("fid", "plane_id", "n_inliers", *[r(c(k), 5).alias(k) for k in ("nx", "ny", "nz", "rmse")])


@query("merge_candidates", sql([*GIVEN, PAIR, _MERGED], "select fid, 0 as i, j from joined"))
def _(f):
    return planes.merge_candidates(f.planes, planes.inlier_centroids(_inliers(f)), RansacConfig(merge_angle=30.0, merge_distance=1.5))


@query("ransac_config", "select * from (values ('own', 0.25e0, 2000, 10, 25, 70.0e0, 10.0e0, 0.4e0), ('library', 0.3e0, 1000, 15, 20, 70.0e0, 7.5e0, 0.5e0)) v(name, epsilon, max_iterations, min_points, max_planes, near_vertical, merge_angle, merge_distance)")
def _(f):
    rows = [(n, *[getattr(k, a) for a in RansacConfig.__dataclass_fields__]) for n, k in (("own", RansacConfig()), ("library", DEFAULTS))]
    return f.spark.createDataFrame(rows, "name string, epsilon double, max_iterations int, min_points int, max_planes int, near_vertical double, merge_angle double, merge_distance double")


# cells and labels


def _cell_query(name: str, select: str, value):
    @query(name, sql([FOOTPRINT_CTE, GIVEN_CTE], f"select fid, cell_id as site_id, {select} from cell_given"))
    def _(f):
        return f.cells.select("fid", "site_id", value().alias(name))


_xy = lambda: [c(k) for k in ("x0", "y0", "x1", "y1", "x2", "y2")]
_cell_query("tri_area", "round(abs((x1 - x0)*(y2 - y0) - (y1 - y0)*(x2 - x0))/2, 6) as tri_area", lambda: r(g.tri_area(*_xy()), 6))
_cell_query("tri_centroid", "round((x0 + x1 + x2)/3, 6) as tri_centroid", lambda: r(g.tri_centroid(c("x0"), c("x1"), c("x2")), 6))
_cell_query("cross2", "round((x1 - x0)*(y2 - y0) - (y1 - y0)*(x2 - x0), 6) as cross2", lambda: r(g.cross2(*_xy()), 6))
_cell_query("cell_min_area", "abs((x1 - x0)*(y2 - y0) - (y1 - y0)*(x2 - x0))/2 >= 24.5e0 as cell_min_area", lambda: g.tri_area(*_xy()) >= 24.5)


@query("cell_in_footprint", sql([FOOTPRINT_CTE, EDGE, GIVEN_CTE, """
hit as (select k.fid, k.cell_id, ring, sum(case when (y1e > cy) <> (y2e > cy) and cx < (x2e - x1e)*(cy - y1e)/(case when y2e = y1e then 1.0e0 else y2e - y1e end) + x1e then 1 else 0 end) as n
  from cell_given k join (select fid, ring, x1 as x1e, y1 as y1e, x2 as x2e, y2 as y2e from edge) e on e.fid = k.fid group by k.fid, k.cell_id, ring)"""],
    "select fid, cell_id as site_id from hit group by fid, cell_id having sum(case when ring = 0 then n % 2 else 0 end) = 1 and sum(case when ring > 0 then n % 2 else 0 end) = 0"))
def _(f):
    return f.cells.join(f.footprints, "fid").where(g.polygon_contains(c("polygon"), c("cx"), c("cy"))).select("fid", "site_id")


@query("inlier_vote", sql([*GIVEN, VOTE], "select fid, site_id, plane_id, votes from vote"))
def _(f):
    return labels.inlier_votes(f.cells, f.planes, _inliers(f))


_BEST = """
best as (select fid, site_id, arg_min(plane_id, (0 - votes, plane_id)) as top, max(votes) as votes from vote group by fid, site_id),
firsts as (select fid, min(plane_id) as first from plane_given group by fid)"""
_LABEL = sql([*GIVEN, VOTE, _BEST], "select best.fid, site_id, case when votes >= 2 then top else first end as plane_id, votes from best join firsts on firsts.fid = best.fid")


@query("label_vote", _LABEL)
def _(f):
    return labels.label_vote(labels.inlier_votes(f.cells, f.planes, _inliers(f)), f.planes)


QUERIES["best_plane_vote"], ORACLES["best_plane_vote"] = QUERIES["label_vote"], ORACLES["label_vote"]


@query("best_plane_fallback", sql([FOOTPRINT_CTE, GIVEN_CTE], "select k.fid, cell_id as site_id, min(plane_id) as plane_id, 0 as votes from cell_given k join plane_given p on p.fid = k.fid group by k.fid, cell_id"))
def _(f):
    return labels.label_vote(labels.inlier_votes(f.cells, f.planes, _inliers(f), 0.0), f.planes)


@query("data_cost", sql([*GIVEN, COST], "select fid, site_id, plane_id, support, round(cost, 9) as cost from cost"))
def _(f):
    return labels.data_costs(f.cells, f.planes, _inliers(f)).withColumn("cost", r(c("cost"), 9))


@query("cell_plane_inliers", sql([*GIVEN, COST], "select fid, site_id, plane_id, support from cost"))
def _(f):
    return labels.data_costs(f.cells, f.planes, _inliers(f)).select("fid", "site_id", "plane_id", "support")


_ARGMIN = "least_cost as (select fid, site_id, arg_min(plane_id, (cost, plane_id)) as plane_id, min(cost) as cost from cost group by fid, site_id)"


@query("label_cost", sql([*GIVEN, COST, _ARGMIN], "select fid, site_id, plane_id, round(cost, 9) as cost from least_cost"))
def _(f):
    return labels.label_cost(labels.data_costs(f.cells, f.planes, _inliers(f))).withColumn("cost", r(c("cost"), 9))


QUERIES["label_argmin"], ORACLES["label_argmin"] = QUERIES["label_cost"], ORACLES["label_cost"]

_NEAREST = f"""{CORNER},
near as (select v.fid, v.seq, v.x, v.y, arg_min(k.cell_id, ((k.cx - v.x)*(k.cx - v.x) + (k.cy - v.y)*(k.cy - v.y), k.cell_id)) as cell_id from corner v join cell_given k on k.fid = v.fid group by v.fid, v.seq, v.x, v.y)"""


def _nearest(f: Fixture) -> DataFrame:
    own = labels.label_cost(labels.data_costs(f.cells, f.planes, _inliers(f)))
    return labels.nearest_cell(plans.corners(f.footprints), f.cells.join(own, ["fid", "site_id"]))


@query("nearest_cell", sql([FOOTPRINT_CTE, GIVEN_CTE, _NEAREST], "select fid, seq, cell_id from near"))
def _(f):
    return _nearest(f).select("fid", "seq", "cell_id")


QUERIES["nearest_face"], ORACLES["nearest_face"] = QUERIES["nearest_cell"], ORACLES["nearest_cell"]


@query("height_nearest", sql([*GIVEN, COST, _ARGMIN, _NEAREST], "select near.fid, seq, round((0.0e0 - (nx*x + ny*y + d))/nz, 6) + 0.0e0 as z from near join least_cost b on b.fid = near.fid and b.site_id = near.cell_id join plane_given p on p.fid = near.fid and p.plane_id = b.plane_id"))
def _(f):
    edge = plans.corners(f.footprints).join(_nearest(f).select("fid", "seq", "plane_id"), ["fid", "seq"])
    return labels.heights(edge, f.planes, "vx", "vy").select("fid", "seq", r(c("z"), 6).alias("z"))


@query("height_vote", sql([*GIVEN, VOTE, _BEST], """select best.fid, best.site_id, round((0.0e0 - (nx*cx + ny*cy + d))/nz, 6) + 0.0e0 as z from best join firsts on firsts.fid = best.fid
  join cell_given k on k.fid = best.fid and k.cell_id = best.site_id join plane_given p on p.fid = best.fid and p.plane_id = case when votes >= 2 then top else first end"""))
def _(f):
    own = labels.label_vote(labels.inlier_votes(f.cells, f.planes, _inliers(f)), f.planes)
    return labels.heights(f.cells.join(own, ["fid", "site_id"]), f.planes, "cx", "cy").select("fid", "site_id", r(c("z"), 6).alias("z"))


@query("cell_adjacency", sql([FOOTPRINT_CTE, GIVEN_CTE], """select k.fid, cell_id as a, 1 + cell_id as b, round(sqrt((x2 - x1)*(x2 - x1) + (y2 - y1)*(y2 - y1)), 6) as len from cell_given k where cell_id < 3
  union all select k.fid, 0, 3, round(sqrt((x2 - x0)*(x2 - x0) + (y2 - y0)*(y2 - y0)), 6) from cell_given k where cell_id = 0"""))
def _(f):
    return labels.cell_adjacency(f.cells).withColumn("len", r(c("len"), 6))


# hulls and triangulations


@query("convex_hull", sql(SCENE, "select fid, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from cropped group by fid"))
def _(f):
    pts = _cropped(f).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p"))
    box = pts.select("fid", g.ring_box(F.transform(triangulate.hulls()(c("p")), lambda q: g.point(q["x"], q["y"], F.lit(0.0)))).alias("b"))
    return box.select("fid", "b.*")


def _given_scene(f: Fixture) -> plans.Scene:
    stats = crop.footprint_stats(f.footprints, _cropped(f)).select("fid", "n", "z_70p", c("z_min").alias("h_ground"))
    own = f.planes.withColumn("rmse", F.lit(0.0))
    some = _inliers(f).groupBy("fid", "plane_id").agg(F.count("*").cast("int").alias("n_inliers"), F.sort_array(F.collect_list(F.struct("pid", "x", "y", "z"))).alias("inliers"))
    return plans.Scene(f.footprints.join(stats, "fid"), _cropped(f), own.join(some, ["fid", "plane_id"]))


@query("cdt", sql([FOOTPRINT_CTE, EDGE], "select fid, round(abs(sum(x1*y2 - x2*y1))/2, 4) as area from edge where ring = 0 group by fid"))
def _(f):
    # the triangles fill the exterior, of whatever shape; what holes take away is cell_in_footprint's part
    none = F.array().cast("array<array<struct<x:double,y:double,z:double>>>")
    rows = plans.roof_cells(_given_scene(f), "split")
    rows = rows.withColumn("polygon", F.struct(c("polygon.exterior").alias("exterior"), none.alias("interiors")))
    return plans.cells_inside(rows).groupBy("fid").agg(r(F.sum("area"), 4).alias("area"))


@query("cells")
def _(f):
    return plans.cells_inside(plans.roof_cells(_given_scene(f), "split")).select("fid", "site_id", r(c("cx"), 4).alias("cx"), r(c("cy"), 4).alias("cy"), r(c("area"), 4).alias("area"))


# meshes


_FLAT = [*SCENE, STATS, CORNER]


def _faces(f: Fixture) -> DataFrame:
    return _flat(f).select("fid", c("lod22").alias("m"))


@query("mesh_flat_roof", sql(_FLAT, "select corner.fid, 2*seq + top as place, x, y, case when top = 1 then z_70p else z_min end as z from corner join stats on stats.fid = corner.fid, (values (0), (1)) t(top)"))
def _(f):
    return _faces(f).select("fid", F.posexplode("m.vertices").alias("place", "v")).select("fid", "place", "v.x", "v.y", "v.z")


_SHELL = """
n0 as (select distinct fid, n from corner),
ring as (
  select fid, 0 as face, list_transform(range(n), lambda i: 2*i) as ids, 0 as sem from n0 union all
  select fid, 1, list_transform(range(n), lambda i: 2*i + 1), 2 from n0 union all
  select fid, 2 + seq, [2*seq + 1, 2*((seq + 1) % n) + 1, 2*((seq + 1) % n), 2*seq], 1 from corner)"""


@query("solid_boundaries", sql([FOOTPRINT_CTE, CORNER, _SHELL], "select fid, face, array_to_string(ids, ',') as ids from ring"))
def _(f):
    return _faces(f).select("fid", F.posexplode(cityjson.solid_boundaries(c("m"))).alias("face", "rings")).select("fid", "face", F.array_join(F.get("rings", F.lit(0)).cast("array<string>"), ",").alias("ids"))


@query("footprint_boundaries", sql([FOOTPRINT_CTE, CORNER, _SHELL], "select fid, array_to_string(ids, ',') as ids from ring where sem = 0"))
def _(f):
    return _faces(f).select("fid", F.explode(cityjson.footprint_boundaries(c("m"))).alias("rings")).select("fid", F.array_join(F.get("rings", F.lit(0)).cast("array<string>"), ",").alias("ids"))


@query("ground_face_filter", sql([FOOTPRINT_CTE, CORNER, _SHELL], "select fid, count(*) as n from ring where sem = 0 group by fid"))
def _(f):
    return _faces(f).select("fid", F.size(cityjson.footprint_boundaries(c("m"))).alias("n"))


@query("is_ccw_2d", sql([FOOTPRINT_CTE, CORNER, _SHELL], "select fid, face, face = 1 as is_ccw from ring"))
def _(f):
    return _faces(f).select("fid", "m", F.posexplode("m.faces").alias("face", "f")).select("fid", "face", cityjson.is_ccw(c("m"), c("f.indices")).alias("is_ccw"))


@query("face_semantics", sql([FOOTPRINT_CTE, CORNER, _SHELL], "select fid, face, ['GroundSurface', 'WallSurface', 'RoofSurface'][sem + 1] as surface from ring"))
def _(f):
    return _faces(f).select("fid", "m", F.posexplode("m.faces").alias("face", "f")).select("fid", "face", F.get("m.semantics", c("f.semantic_index"))["surface_type"].alias("surface"))


@query("semantics_json", sql([FOOTPRINT_CTE, CORNER, _SHELL], """select fid, '[{"type":"GroundSurface"},{"type":"WallSurface","on_footprint_edge":true},{"type":"RoofSurface"}]' as surfaces, array_to_string(list(sem order by face), ',') as sems from ring group by fid"""))
def _(f):
    return _faces(f).select("fid", F.to_json(cityjson.semantic_surfaces(c("m"))).alias("surfaces"), F.array_join(cityjson.semantic_values(c("m")).cast("array<string>"), ",").alias("sems"))


@query("semantic_ctors", "select * from (values (0, 'GroundSurface', null, null), (1, 'WallSurface', true, null), (2, 'RoofSurface', null, null), (3, 'RoofSurface', null, 45.0e0)) v(place, surface_type, on_footprint_edge, slope)")
def _(f):
    tilted = F.struct(F.lit(0.0).alias("nx"), F.sqrt(F.lit(0.5)).alias("ny"), F.sqrt(F.lit(0.5)).alias("nz"))
    made = F.array(mesh.semantic("GroundSurface"), mesh.semantic("WallSurface", True), mesh.semantic("RoofSurface"), mesh.roof_with_stats(tilted))
    return f.spark.range(1).select(F.posexplode(made).alias("place", "s")).select("place", "s.surface_type", "s.on_footprint_edge", F.round("s.slope", 6).alias("slope"))


@query("mesh_builder", sql([FOOTPRINT_CTE, CORNER], "select distinct fid, 2*n as n_vertices, n + 2 as n_faces, 2*n - 1 as last_index from corner"))
def _(f):
    last = F.array_max(F.flatten(F.transform("m.faces", lambda x: x["indices"])))
    return _faces(f).select("fid", F.size("m.vertices").alias("n_vertices"), F.size("m.faces").alias("n_faces"), last.alias("last_index"))


@query("mesh_volume", sql([*SCENE, STATS], "select stats.fid, round(area*(z_70p - z_min), 3) as volume from stats join (select fid, abs(sum(x1*y2 - x2*y1))/2 as area from edge where ring = 0 group by fid) a on a.fid = stats.fid"))
def _(f):
    first = F.get("m.vertices", F.lit(0))
    local = F.transform("m.vertices", lambda v: g.point(v["x"] - first["x"], v["y"] - first["y"], v["z"]))
    rows = _faces(f).select("fid", F.struct(local.alias("vertices"), c("m.faces").alias("faces"), c("m.semantics").alias("semantics")).cast(MESH).alias("m"))
    return rows.select("fid", r(mesh.volume(c("m")), 3).alias("volume"))


@query("geographic_extent", sql([*SCENE, STATS, BOX], "select stats.fid, xmin, ymin, z_min as zmin, xmax, ymax, greatest(z_min, z_70p) as zmax from stats join box on box.fid = stats.fid"))
def _(f):
    return _faces(f).select("fid", mesh.extent(c("m")).alias("e")).select("fid", "e.*")


@query("face_normal", sql([FOOTPRINT_CTE], "select fid, 0.0e0 as nx, 0.0e0 as ny, 1.0e0 as nz from fp"))
def _(f):
    return _faces(f).select("fid", mesh.face_normal(c("m"), F.lit(1)).alias("n")).select("fid", *[r(c(f"n.{k}"), 9).alias(k) for k in ("nx", "ny", "nz")])


@query("best_lod", sql([FOOTPRINT_CTE], "select fid, case when fid % 2 = 0 then 3 else 9 end as n from fp"))
def _(f):
    a, b = F.when(c("fid") % 2 == 0, F.lit(3)), F.lit(9)
    return f.footprints.select("fid", mesh.best_lod(a, b).alias("n"))


@query("lod_tag", sql([FOOTPRINT_CTE], "select fid, case when fid % 2 = 0 then '2.2' else '1.2' end as lod from fp"))
def _(f):
    return f.footprints.select("fid", cityjson.lod_tag(F.when(c("fid") % 2 == 0, F.lit(1))).alias("lod"))


def _mesh_counts(rows: DataFrame) -> DataFrame:
    return rows.where("mesh is not null").select("fid", F.size("mesh.vertices").alias("n_vertices"), F.size("mesh.faces").alias("n_faces"), F.size("mesh.semantics").alias("n_semantics"))


def _given_cells(f: Fixture, method) -> DataFrame:
    """The method's meshes over the given planes and cells: counts, heights of roof and walls, and the surface of each face."""
    of = _given_scene(f)
    rows = written(of.buildings.join(plans._plane_arrays(of), "fid").withColumn("cells", F.array(F.lit(0))), "given")
    m, total = c("mesh"), lambda v: r(F.aggregate(v, F.lit(0.0), lambda a, p: a + p["z"]), 4)
    n = (F.size("mesh.vertices") / 3).cast("int") - 4
    surfaces = F.array_join(F.transform(m["faces"], lambda x: x["semantic_index"]).cast("array<string>"), ",")
    made = method.assembled(of, rows, f.cells).where("mesh is not null")
    heights = total(F.slice(m["vertices"], 1, 12)).alias("roof_z"), total(F.slice(m["vertices"], 13 + n, 2 * n)).alias("wall_z")
    return made.select("fid", F.size("mesh.vertices").alias("n_vertices"), F.size("mesh.faces").alias("n_faces"), F.size("mesh.semantics").alias("n_semantics"), *heights, surfaces.alias("surfaces"))


_GIVEN_MESH = """
shown as (select l.fid, l.site_id, l.plane_id, (0.0e0 - (nx*x0 + ny*y0 + d))/nz + (0.0e0 - (nx*x1 + ny*y1 + d))/nz + (0.0e0 - (nx*x2 + ny*y2 + d))/nz as z
  from labelled l join cell_given k on k.fid = l.fid and k.cell_id = l.site_id join plane_given p on p.fid = l.fid and p.plane_id = l.plane_id),
roofs as (select fid, sum(z) as z, string_agg(cast(plane_id + 2 as varchar), ',' order by site_id) as surfaces from shown group by fid),
walls as (select t.fid, count(*) as n, sum(2*(0.0e0 - (nx*x + ny*y + d))/nz) as z from tops t join plane_given p on p.fid = t.fid and p.plane_id = t.plane_id group by t.fid)"""
_GIVEN_SELECT = """select roofs.fid, 12 + 3*n as n_vertices, 4 + n + 1 as n_faces, 2 + k as n_semantics, round(roofs.z, 4) + 0.0e0 as roof_z, round(walls.z, 4) + 0.0e0 as wall_z, surfaces || ',0' || repeat(',1', n::int) as surfaces
  from roofs join walls on walls.fid = roofs.fid join (select fid, count(*) as k from plane_given group by fid) c on c.fid = roofs.fid"""
_CORNER_VOTE = f"""{CORNER},
corner_vote as (
  select e.fid, e.seq, e.x, e.y, e.plane_id, coalesce(v.votes, 0) as votes
  from (select k.fid, k.seq, k.x, k.y, p.plane_id from corner k join plane_given p on p.fid = k.fid) e
  left join (select k.fid, k.seq, i.plane_id, count(*) as votes from corner k join inlier i on i.fid = k.fid
    where (i.x - k.x)*(i.x - k.x) + (i.y - k.y)*(i.y - k.y) < 9.0e0 group by k.fid, k.seq, i.plane_id) v
  on v.fid = e.fid and v.seq = e.seq and v.plane_id = e.plane_id),
corner_best as (select fid, seq, x, y, arg_min(plane_id, (0 - votes, plane_id)) as top, max(votes) as votes from corner_vote group by fid, seq, x, y),
tops as (select b.fid, seq, x, y, case when votes >= 2 then top else first end as plane_id from corner_best b join firsts on firsts.fid = b.fid)"""


@query("mesh_arrangement", sql([*GIVEN, VOTE, _BEST, "labelled as (select best.fid, site_id, case when votes >= 2 then top else first end as plane_id from best join firsts on firsts.fid = best.fid)", _CORNER_VOTE, _GIVEN_MESH], _GIVEN_SELECT))
def _(f):
    return _given_cells(f, plans.Arrangement)


@query("mesh_graphcut", sql([*GIVEN, COST, _ARGMIN, "labelled as (select fid, site_id, plane_id from least_cost)", _NEAREST, "tops as (select near.fid, seq, x, y, plane_id from near join least_cost b on b.fid = near.fid and b.site_id = near.cell_id)", _GIVEN_MESH], _GIVEN_SELECT))
def _(f):
    return _given_cells(f, plans.GraphCut)


@query("mesh_extrude")
def _(f):
    return _mesh_counts(plans.PlaneExtrude().meshes(_given_scene(f)))


# the writer


@query("quantise_vertices", sql([FOOTPRINT_CTE, CENTRE], "select fid, seq, cast(trunc((x - cx)/0.001e0) as bigint) as qx, cast(trunc((y - cy)/0.001e0) as bigint) as qy from vert, centre where ring = 0"))
def _(f):
    at = F.broadcast(crop.dataset_centroid(f.footprints))
    return _vertices(f.footprints).where("ring = 0").crossJoin(at).select("fid", "seq", cityjson.quantised(c("x"), c("cx")).alias("qx"), cityjson.quantised(c("y"), c("cy")).alias("qy"))


@query("cityjson_header", sql([FOOTPRINT_CTE, CENTRE], f"select 'CityJSON' as type, '2.0' as version, 'https://www.opengis.net/def/crs/EPSG/0/2154' as system, '{DATE}' as date, '0' as identifier, round(cx, 4) as cx, round(cy, 4) as cy from centre"))
def _(f):
    line = cityjson.header(crop.dataset_centroid(f.footprints), "EPSG:2154", DATE)
    at = lambda p: F.get_json_object("line", f"$.{p}")
    return line.select(at("type").alias("type"), at("version").alias("version"), at("metadata.referenceSystem").alias("system"), at("metadata.referenceDate").alias("date"), at("metadata.identifier").alias("identifier"), r(at("transform.translate[0]").cast("double"), 4).alias("cx"), r(at("transform.translate[1]").cast("double"), 4).alias("cy"))


@query("cityjson_feature", sql([*_FLAT, CENTRE], """select cast(corner.fid as varchar) as id, '2.2' as lod, max(corner.n) + 2 as n_faces, sum(2*cast(trunc((x - cx)/0.001e0) as bigint))::bigint as sx, sum(2*cast(trunc((y - cy)/0.001e0) as bigint))::bigint as sy,
  sum(cast(trunc(z_min/0.001e0) as bigint) + cast(trunc(z_70p/0.001e0) as bigint))::bigint as sz from corner join stats on stats.fid = corner.fid, centre group by corner.fid"""))
def _(f):
    lines = cityjson.features(_flat(f), crop.dataset_centroid(f.footprints))
    id_ = F.get_json_object("line", "$.id")
    solid = F.get_json_object(c("line"), "$.CityObjects")
    part = F.from_json(solid, "map<string,struct<geometry:array<struct<lod:string,boundaries:string>>>>")
    vertices = F.from_json(F.get_json_object("line", "$.vertices"), "array<array<bigint>>")
    rows = lines.select(id_.alias("id"), F.get(part[F.concat(id_, F.lit("-0"))]["geometry"], F.lit(0)).alias("g"), vertices.alias("v"))
    shells = F.from_json("g.boundaries", "array<array<array<array<int>>>>")
    total = lambda k: F.aggregate("v", F.lit(0).cast("bigint"), lambda a, p: a + F.get(p, F.lit(k)))
    return rows.select("id", "g.lod", F.size(F.get(shells, F.lit(0))).alias("n_faces"), total(0).alias("sx"), total(1).alias("sy"), total(2).alias("sz"))


QUERIES["json_build"], ORACLES["json_build"] = QUERIES["cityjson_feature"], ORACLES["cityjson_feature"]


@query("attr_json", "select s_suppkey as fid, s_name as name, s_nationkey as nation, s_acctbal as balance from supplier")
def _(f):
    at = lambda k: F.get_json_object(F.to_json("attributes"), f"$.{k}")
    return f.footprints.select("fid", at("name").alias("name"), at("nation").cast("bigint").alias("nation"), at("balance").cast("double").alias("balance"))


@query("features_concat", sql([FOOTPRINT_CTE], "select 0 as section, cast(null as bigint) as fid, 'CityJSON' as type union all select 1, fid, 'CityJSONFeature' from fp"))
def _(f):
    lines = cityjson.city_lines(_flat(f), crop.dataset_centroid(f.footprints), date=DATE)
    return lines.select("section", "fid", F.get_json_object("line", "$.type").alias("type"))


def _city_file(f: Fixture) -> DataFrame:
    """The city as the writer leaves it: rows (line) of its files."""
    folder = scratch_path(f.spark, "city")
    cityjson.write_city(cityjson.city_lines(_flat(f), crop.dataset_centroid(f.footprints), date=DATE), folder)
    return f.spark.read.text(folder).withColumnRenamed("value", "line")


@query("sink_open", f"select 'CityJSON' as type, '2.0' as version, '{DATE}' as date, 1 as headers")
def _(f):
    top = _city_file(f).where(F.get_json_object("line", "$.type") == "CityJSON")
    at = lambda p: F.max(F.get_json_object("line", f"$.{p}"))
    return top.agg(at("type").alias("type"), at("version").alias("version"), at("metadata.referenceDate").alias("date"), F.count("*").cast("int").alias("headers"))


@query("sink_feature", sql([FOOTPRINT_CTE, CORNER], "select cast(fid as varchar) as id, 2*max(n) as n_vertices from corner group by fid"))
def _(f):
    rows = _city_file(f).where(F.get_json_object("line", "$.type") == "CityJSONFeature")
    return rows.select(F.get_json_object("line", "$.id").alias("id"), F.size(F.from_json(F.get_json_object("line", "$.vertices"), "array<array<bigint>>")).alias("n_vertices"))


@query("sink_close", sql([FOOTPRINT_CTE], "select count(*) + 1 as lines from fp"))
def _(f):
    return _city_file(f).agg(F.count("*").alias("lines"))


@query("run_summary", sql([FOOTPRINT_CTE], "select count(*) as succeeded, 0 as failed from fp"))
def _(f):
    return cityjson.run_summary(_flat(f))


@query("epsg_url", "select s_suppkey as fid, 'https://www.opengis.net/def/crs/EPSG/0/' || cast(2000 + s_suppkey as varchar) as url from supplier")
def _(f):
    return f.footprints.select("fid", t.epsg_url(F.concat(F.when(c("fid") % 2 == 0, "EPSG:EPSG:").otherwise(""), (2000 + c("fid")).cast("string"))).alias("url"))


@query("part_id", sql([FOOTPRINT_CTE], "select fid, cast(fid as varchar) || '-0' as part from fp"))
def _(f):
    return f.footprints.select("fid", t.part_id(c("fid")).alias("part"))


@query("utc_date", "select strftime(timestamp '2024-02-29 23:59:59', '%Y-%m-%d') as day")
def _(f):
    return f.spark.range(1).select(t.utc_date(F.to_timestamp(F.lit("2024-02-29T23:59:59Z"))).alias("day"))


# whole buildings


@query("flat_roof_buildings", sql([*_FLAT], "select corner.fid, max(2*corner.n) as n_vertices, max(corner.n) + 2 as n_faces, any_value(z_min) as h_ground, any_value(z_70p) as h_roof from corner join stats on stats.fid = corner.fid group by corner.fid"))
def _(f):
    top = F.get("lod22.vertices", F.lit(1))["z"]
    return _flat(f).select("fid", F.size("lod22.vertices").alias("n_vertices"), F.size("lod22.faces").alias("n_faces"), "h_ground", top.alias("h_roof"))


def _whole(name: str, method):
    @query(name)
    def _(f):
        made = plans.reconstruct(f.footprints, f.points, method)
        return made.select("fid", "method", "fallback", "h_ground", F.size("lod22.vertices").alias("n_vertices"), F.size("lod22.faces").alias("n_faces"))


_whole("reconstruct_extrude", plans.PlaneExtrude())
_whole("reconstruct_arrangement", plans.Arrangement())
_whole("reconstruct_graphcut", plans.GraphCut())


@query("panic_fallback", sql([*_FLAT], "select corner.fid, 'kernel' as fallback, max(n) + 2 as n_faces from corner group by corner.fid"))
def _(f):
    class Broken:
        name = "broken"

        def meshes(self, of):
            return of.buildings.select("fid", F.lit(None).cast(MESH).alias("mesh"), F.lit(True).alias("failed"))

    made = plans.reconstruct(f.footprints, f.points, Broken())
    return made.select("fid", "fallback", F.size("lod22.faces").alias("n_faces"))
