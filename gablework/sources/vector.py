"""Footprints from GeoPackage, GeoJSON, WKT and WKB, as (fid, polygon, attributes).

Features without geometry are skipped, as are those whose polygon comes out empty. A multipolygon counts by its first
part; other kinds are empty. Rings that don't close are closed. Integers, reals and text become attributes; nulls and
all else have no key. The id is the source's, else a number.
"""

from __future__ import annotations

import json
import re
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gablework.model import POLYGON, RING

_ROW = "fid string, geometry string, attributes string"


class VectorError(ValueError):
    """A geometry or file that can't be read."""


# geometry as nested lists: a polygon is a list of rings, a ring a list of [x, y, z]


def read_wkb(data: bytes) -> tuple[str, list]:
    """(kind, parts) of a WKB geometry: polygons with their rings; no parts of other kinds. Multipolygons with M aren't read, as the kinds list says."""

    def number(at: int, order: str) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    def body(at: int) -> tuple[str, list, int]:
        order = "<" if data[at] == 1 else ">"
        code, at = number(at + 1, order)
        has_z, has_m = bool(code & 0x80000000), bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        code &= 0x0FFFFFFF
        has_z, has_m = has_z or code // 1000 in (1, 3), has_m or code // 1000 in (2, 3)
        width, kind = 2 + has_z + has_m, code % 1000
        if kind == 3:
            rings, at = number(at, order)
            out = []
            for _ in range(rings):
                n, at = number(at, order)
                flat = struct.unpack_from(f"{order}{n * width}d", data, at)
                at += 8 * n * width
                out.append([[flat[i], flat[i + 1], flat[i + 2] if has_z else 0.0] for i in range(0, len(flat), width)])
            return "Polygon", out, at
        if kind == 6:
            n, at = number(at, order)
            parts = []
            for _ in range(n):
                _, part, at = body(at)
                parts.append(part)
            return "MultiPolygonM" if has_m else "MultiPolygon", parts, at
        return "Other", [], at

    kind, parts, _ = body(0)
    return kind, parts


def normalised_polygon(kind: str, parts: list) -> list:
    """The rings of a polygon, of a multipolygon's first part; none of other kinds."""
    if kind == "Polygon":
        return parts
    return parts[0] if kind == "MultiPolygon" and parts else []


def _gpkg_wkb(blob: bytes) -> bytes:
    if blob[:2] != b"GP":
        raise VectorError("not a GeoPackage geometry")
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return blob[8 + envelope :]


def geojson_rings(geometry: dict | None) -> list:
    if not geometry:
        return []
    kind, parts = geometry.get("type"), geometry.get("coordinates") or []
    rings = normalised_polygon(kind, parts) if kind in ("Polygon", "MultiPolygon") else []
    return [[[float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0] for p in ring] for ring in rings]


_WKT = re.compile(r"\s*(MULTIPOLYGON|POLYGON)\s*(Z?M?)\s*(EMPTY|\(.*\))\s*\Z", re.IGNORECASE | re.DOTALL)


def wkt_rings(text: str | None) -> list:
    """The rings of WKT text."""
    found = _WKT.match(text or "")
    if not found or found[3].upper() == "EMPTY" or (found[1].upper() == "MULTIPOLYGON" and "M" in found[2].upper()):
        return []
    has_z = "Z" in found[2].upper()
    numbers = lambda p: [float(v) for v in p.split()]
    rings = []
    body = found[3]
    if found[1].upper() == "MULTIPOLYGON":
        body = re.match(r"\(\s*(\((?:[^()]*|\([^()]*\))*\))", body)[1]
    for ring in re.findall(r"\(([^()]*)\)", body):
        rows = [numbers(p) for p in ring.split(",") if p.strip()]
        rings.append([[r[0], r[1], r[2] if len(r) > 2 and (has_z or "M" not in found[2].upper()) else 0.0] for r in rows])
    return rings


def _closed(ring: list) -> list:
    return ring if not ring or ring[0][:2] == ring[-1][:2] else [*ring, ring[0]]


def _attributes(values: dict) -> dict:
    return {k: v for k, v in values.items() if isinstance(v, (bool, int, float, str)) and not isinstance(v, bool)}


def typed(rows: DataFrame) -> DataFrame:
    """(fid, polygon, attributes) of rows (fid, geometry, attributes): rings and attributes as JSON text. Empty polygons are dropped."""
    point = "array<double>"
    rings = F.from_json("geometry", f"array<array<{point}>>")
    as_ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"), F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)).alias("z")))
    split = rows.withColumn("rings", F.transform(rings, as_ring))
    polygon = rings_split(F.col("rings"))
    pairs = F.from_json(F.col("attributes"), "map<string,variant>")
    return split.select("fid", polygon.alias("polygon"), F.coalesce(pairs, F.expr("cast(map() as map<string,variant>)")).alias("attributes")).where(F.size("polygon.exterior") > 0)


def rings_split(rings: Column) -> Column:
    """A polygon of its rings: the first is the exterior."""
    none = F.array().cast(RING)
    return F.struct(F.coalesce(F.get(rings, F.lit(0)), none).alias("exterior"), F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))).alias("interiors")).cast(POLYGON)


def _given(rows: Iterator[tuple[str, list, dict]]) -> pa.RecordBatch:
    out = [(str(fid), json.dumps([_closed(r) for r in rings]), json.dumps(_attributes(values))) for fid, rings, values in rows if rings and rings[0]]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.string()) for i in range(3)], names=["fid", "geometry", "attributes"])


def _gpkg_rows(data: bytes) -> Iterator[tuple[str, list, dict]]:
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as file:  # the library reads files only; it lives while its task reads it
        file.write(data)
        file.flush()
        with sqlite3.connect(file.name) as base:
            table, column = _layer(base)
            cursor = base.execute(f'select * from "{table}" order by rowid')
            names = [c[0] for c in cursor.description]
            key = next((r[1] for r in base.execute(f'pragma table_info("{table}")') if r[5]), None)
            counter = 0
            for row in cursor:
                values = dict(zip(names, row, strict=True))
                blob, fid = values.pop(column), values.pop(key, None) if key else None
                rings = normalised_polygon(*read_wkb(_gpkg_wkb(blob))) if blob is not None else []
                if rings and rings[0]:
                    yield (counter if fid is None else fid), rings, values
                    counter += 1


def _layer(base: sqlite3.Connection) -> tuple[str, str]:
    first = base.execute("select c.table_name, c.column_name from gpkg_geometry_columns c join gpkg_contents t on t.table_name = c.table_name order by t.rowid limit 1").fetchone()
    if first is None:
        raise VectorError("no layer of features")
    return first


def empty_geopackage(epsg: int) -> bytes:
    """A GeoPackage of one layer without features."""
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as file:
        with sqlite3.connect(file.name) as base:
            base.executescript(f"""create table gpkg_contents (table_name text); create table gpkg_geometry_columns (table_name text, column_name text, srs_id int);
                create table gpkg_spatial_ref_sys (srs_id int, organization_coordsys_id int); insert into gpkg_contents values ('layer');
                insert into gpkg_geometry_columns values ('layer', 'geom', {epsg:d}); insert into gpkg_spatial_ref_sys values ({epsg:d}, {epsg:d});
                create table layer (fid integer primary key, geom blob)""")
        base.close()
        with open(file.name, "rb") as made:
            return made.read()


def scan_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """Footprints of the first layer of each file; a file is a task's row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for data in batch.column(0):
                yield _given(_gpkg_rows(data.as_py()))

    return typed(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _ROW))


def scan_geopackage_crs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, epsg): the code of the first layer's reference system."""

    def code(data: bytes) -> str | None:
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as file:
            file.write(data)
            file.flush()
            with sqlite3.connect(file.name) as base:
                table, _ = _layer(base)
                row = base.execute("select s.organization_coordsys_id from gpkg_geometry_columns c join gpkg_spatial_ref_sys s on s.srs_id = c.srs_id where c.table_name = ?", (table,)).fetchone()
        return str(row[0]) if row and row[0] is not None and row[0] > 0 else None

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code(x.as_py()) for x in batch.column(1)], type=pa.string())], names=["path", "epsg"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, epsg string")


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Footprints of feature collections (a file each) or of one feature a line."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for data in batch.column(0):
                text = data.as_py().decode()
                try:
                    whole = json.loads(text)
                    found = whole.get("features", [whole])
                except ValueError:
                    found = [json.loads(line) for line in text.splitlines() if line.strip()]
                kept = [(f, geojson_rings(f.get("geometry"))) for f in found]
                kept = [(f, r) for f, r in kept if r and r[0]]
                yield _given((f.get("id", i), r, f.get("properties") or {}) for i, (f, r) in enumerate(kept))

    return typed(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _ROW))


_CRS_NAME = re.compile(r"EPSG:(?::|[0-9.]+:)?([0-9]+)\Z")


def geojson_epsg(text: str) -> str | None:
    """The EPSG code that the text's crs member names; 4326, which the format stands for, without one; None of another name."""
    try:
        whole = json.loads(text)
    except ValueError:
        whole = next((json.loads(line) for line in text.splitlines() if line.strip()), {})
    crs = whole.get("crs") if isinstance(whole, dict) else None
    if not crs:
        return "4326"
    name = str((crs.get("properties") or {}).get("name", ""))
    found = _CRS_NAME.search(name)
    return found[1] if found else "4326" if name.endswith("CRS84") else None


def scan_geojson_crs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, epsg) of the files."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([geojson_epsg(x.as_py().decode()) for x in batch.column(1)], type=pa.string())], names=["path", "epsg"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, epsg string")


def to_geojson(footprints: DataFrame) -> DataFrame:
    """Rows (line) of footprints (fid, polygon, attributes): a feature each, as scan_geojson reads them."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"], p["z"]))
    rings = F.concat(F.array(ring(F.col("polygon.exterior"))), F.transform("polygon.interiors", ring))
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return footprints.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("fid").alias("id"), geometry.alias("geometry"), F.col("attributes").alias("properties"))).alias("line"))


def from_wkt(rows: DataFrame, fid: str = "fid", wkt: str = "wkt") -> DataFrame:
    """Footprints of rows that hold WKT; the other columns are their attributes where they are numbers or text."""
    from gablework.functions.text import attribute_map

    kept = {n for n, kind in rows.dtypes if n not in (fid, wkt) and kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "string")}

    @F.pandas_udf("string")
    def rings(texts):
        return texts.map(lambda t: json.dumps([_closed(r) for r in wkt_rings(t)]))

    made = rows.select(F.col(fid).cast("string").alias("fid"), rings(F.col(wkt)).alias("geometry"), F.to_json(attribute_map({n: F.col(n) for n in sorted(kept)})).alias("attributes"))
    return typed(made)


def to_wkt(polygon: Column) -> Column:
    """A polygon as WKT of x and y."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    rings = F.concat(F.array(polygon["exterior"]), polygon["interiors"])
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))
