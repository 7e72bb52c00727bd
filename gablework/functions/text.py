"""String and map expressions of the readers and the writer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wkt_epsg(wkt: Column) -> Column:
    """The first EPSG authority code of a coordinate system's WKT; null if there is none or it isn't digits."""
    code = F.regexp_extract(wkt, 'AUTHORITY\\["EPSG","([^"]*)"', 1)
    return F.when(code.rlike("^[0-9]+$"), code)


def epsg_url(code: Column) -> Column:
    """The OGC address of a code, however often EPSG: stands before it."""
    return F.concat(F.lit("https://www.opengis.net/def/crs/EPSG/0/"), F.regexp_replace(code, "^(EPSG:)+", ""))


def part_id(fid: Column) -> Column:
    return F.concat(fid.cast("string"), F.lit("-0"))


def utc_date(at: Column | None = None) -> Column:
    """The date of a time (now) in UTC as yyyy-MM-dd, in sessions that run in UTC or not."""
    at = F.current_timestamp() if at is None else at
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd")


def attribute_map(pairs: dict[str, Column]) -> Column:
    """map<string,variant> of the typed values; nulls have no key."""
    entries = [F.create_map(F.lit(k), v.cast("variant")) for k, v in pairs.items()]
    merged = F.map_concat(*entries) if entries else F.expr("cast(map() as map<string,variant>)")
    return F.map_filter(merged, lambda k, v: v.isNotNull())


def with_attribute(attributes: Column, name: str, value: Column) -> Column:
    """The map with a typed value inserted; the last of a name wins."""
    others = F.map_filter(attributes, lambda k, v: k != name)
    return F.map_concat(others, F.create_map(F.lit(name), value.cast("variant")))
