"""CityJSON sequences: a header line, then a feature line for each building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablework.functions import geometry as g
from gablework.functions import text as t
from gablework.model import DEFAULT_EPSG, MESH, SCALE

#: Areas below this are a wall's rounding, not a direction.
LEVEL = 1e-9


def quantised(value: Column, translate: Column, scale: float = SCALE) -> Column:
    """(value - translate) / scale cut towards zero; 0 of NaN, the nearest bigint beyond its range."""
    q = (value - translate) / scale
    most, least = F.lit(2**63 - 1), F.lit(-(2**63 - 1)) - 1
    inside = F.when(F.abs(q) < 9.2e18, q).otherwise(0.0).cast("long")
    return F.when(F.isnan(q), F.lit(0).cast("long")).when(q >= 9.2e18, most).when(q <= -9.2e18, least).otherwise(inside)


def quantised_vertices(m: Column, cx: Column, cy: Column, scale: float = SCALE) -> Column:
    return F.transform(m["vertices"], lambda v: F.array(quantised(v["x"], cx, scale), quantised(v["y"], cy, scale), quantised(v["z"], F.lit(0.0), scale)))


def is_ccw(m: Column, indices: Column) -> Column:
    """Whether a face turns left in xy; upright faces don't."""
    ring = F.transform(indices, lambda i: F.get(m["vertices"], i))
    return (F.size(indices) >= 3) & (2 * g.signed_area(ring) > LEVEL)


def _rings(m: Column, faces: Column) -> Column:
    return F.transform(F.filter(faces, lambda f: F.size(f["indices"]) >= 3), lambda f: F.array(F.when(is_ccw(m, f["indices"]), f["indices"]).otherwise(F.reverse(f["indices"]))))


def solid_boundaries(m: Column) -> Column:
    """The shell: each face of three vertices or more as a ring that turns left."""
    return _rings(m, m["faces"])


def footprint_boundaries(m: Column) -> Column:
    """The rings of the ground faces."""
    ground = lambda f: F.coalesce(F.get(m["semantics"], f["semantic_index"])["surface_type"] == "GroundSurface", F.lit(False))
    return _rings(m, F.filter(m["faces"], ground))


def semantic_surfaces(m: Column) -> Column:
    """type, on_footprint_edge where known, azimuth and slope of roofs."""
    roof = lambda s, k: F.when((s["surface_type"] == "RoofSurface") & ~F.isnan(s[k]), s[k])
    return F.transform(m["semantics"], lambda s: F.struct(s["surface_type"].alias("type"), s["on_footprint_edge"].alias("on_footprint_edge"), roof(s, "azimuth").alias("rf_azimuth"), roof(s, "slope").alias("rf_slope")))


def semantic_values(m: Column) -> Column:
    """The surface of each face that has a ring."""
    return F.transform(F.filter(m["faces"], lambda f: F.size(f["indices"]) >= 3), lambda f: f["semantic_index"])


def lod_tag(lod22: Column) -> Column:
    return F.when(lod22.isNotNull(), "2.2").otherwise("1.2")


def header(transform: DataFrame, epsg: str | None = DEFAULT_EPSG, date: str | None = None) -> DataFrame:
    """One row (line) from one row (cx, cy). date: of the reference, today in UTC if None."""
    at = F.lit(date) if date else t.utc_date()
    none = lambda: F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fields = [F.lit("CityJSON").alias("type"), F.lit("2.0").alias("version"), none().alias("CityObjects"), F.array().cast("array<int>").alias("vertices"), F.struct(F.array(*[F.lit(SCALE)] * 3).alias("scale"), F.array("cx", "cy", F.lit(0.0)).alias("translate")).alias("transform")]
    if epsg is not None:
        fields.append(F.struct(t.epsg_url(F.lit(epsg)).alias("referenceSystem"), at.alias("referenceDate"), F.lit("0").alias("identifier")).alias("metadata"))
    return transform.select(F.to_json(F.struct(*fields)).alias("line"))


def feature(fid: Column, lod22: Column, lod12: Column, attributes: Column, cx: Column, cy: Column) -> Column:
    """A building's line: its part with the solid, then itself with attributes and ground. Without a mesh: an empty feature."""
    m = F.coalesce(lod22, lod12.cast(MESH))
    key, part = fid.cast("string"), t.part_id(fid)
    solid = F.struct(F.lit("Solid").alias("type"), lod_tag(lod22).alias("lod"), F.array(solid_boundaries(m)).alias("boundaries"), F.struct(semantic_surfaces(m).alias("surfaces"), F.array(semantic_values(m)).alias("values")).alias("semantics"))
    part_json = F.to_json(F.struct(F.lit("BuildingPart").alias("type"), F.array(key).alias("parents"), F.array(solid).alias("geometry")))
    ground = footprint_boundaries(m)
    base = F.struct(F.lit("MultiSurface").alias("type"), F.lit("0").alias("lod"), ground.alias("boundaries"))
    own_json = F.to_json(F.struct(F.lit("Building").alias("type"), attributes.alias("attributes"), F.array(part).alias("children"), F.when(F.size(ground) > 0, F.array(base)).alias("geometry")))
    named = lambda k, v: F.concat(_quoted(k), F.lit(":"), v)
    objects = F.concat(F.lit("{"), named(part, part_json), F.lit(","), named(key, own_json), F.lit("}"))
    head = F.concat(F.lit('{"type":"CityJSONFeature","id":'), _quoted(key), F.lit(',"CityObjects":'))
    full = F.concat(head, objects, F.lit(',"vertices":'), F.to_json(quantised_vertices(m, cx, cy)), F.lit("}"))
    return F.when(m.isNotNull(), full).otherwise(F.concat(head, F.lit('{},"vertices":[]}')))


def _quoted(value: Column) -> Column:
    whole = F.to_json(F.array(value))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def features(buildings: DataFrame, transform: DataFrame) -> DataFrame:
    """Rows (fid, line) of buildings (fid, lod22, lod12, attributes); transform: one row (cx, cy), broadcast."""
    c = F.col
    return buildings.crossJoin(F.broadcast(transform)).select("fid", feature(c("fid"), c("lod22"), c("lod12"), c("attributes"), c("cx"), c("cy")).alias("line"))


def city_lines(buildings: DataFrame, transform: DataFrame, epsg: str | None = DEFAULT_EPSG, date: str | None = None) -> DataFrame:
    """Rows (section, fid, line): the header (section 0) and the features (section 1), to be ordered by both."""
    top = header(transform, epsg, date).select(F.lit(0).alias("section"), F.lit(None).cast(dict(buildings.dtypes)["fid"]).alias("fid"), "line")
    return top.unionAll(features(buildings, transform).select(F.lit(1).alias("section"), "fid", "line"))


def write_city(lines: DataFrame, path: str, single_file: bool = False) -> None:
    """Text files whose names sort in line order, the header first; one file if asked for."""
    ordered = lines.orderBy("section", "fid") if not single_file else lines.coalesce(1).sortWithinPartitions("section", "fid")
    ordered.select("line").write.mode("overwrite").text(path)


def run_summary(buildings: DataFrame) -> DataFrame:
    """One row (succeeded, failed): buildings with and without a mesh."""
    some = F.coalesce(F.col("lod22"), F.col("lod12")).isNotNull()
    return buildings.agg(F.count_if(some).alias("succeeded"), F.count_if(~some).alias("failed"))
