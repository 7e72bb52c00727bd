"""Polygon shapefiles: shapes (.shp), attributes (.dbf) and the reference system (.prj) of one name.

Spark lists and reads the files; a name's files come together by their path without its ending, and are decoded in one
task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gablework.functions.text import wkt_epsg
from gablework.sources.vector import VectorError, _given, _ROW, typed

#: The file's code, and the codes of polygon shapes, flat, with heights and with measures.
_CODE, _FLAT, _WITH_Z, _WITH_M = 9994, 5, 15, 25


def _turn(ring: np.ndarray) -> float:
    """Twice the signed area; negative of an outer ring."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def _inside(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring[:-1, :2], ring[1:, :2]
    over = (a[:, 1] > y) != (b[:, 1] > y)
    rise = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
    return bool((over & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / rise + a[:, 0])).sum() % 2)


def shapes(data: bytes) -> Iterator[list]:
    """Of each record the rings (x, y, z) of its first polygon, exterior first; none of a null shape."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != _CODE:
        raise VectorError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if len(body) < size:
            raise VectorError("the file ends within a shape")
        kind = struct.unpack_from("<i", body)[0]
        if kind not in (_FLAT, _WITH_Z, _WITH_M):
            yield []
            continue
        parts, n = struct.unpack_from("<2i", body, 36)
        starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
        xy = np.frombuffer(body, dtype="<f8", count=2 * n, offset=44 + 4 * parts).reshape(n, 2)
        z = np.frombuffer(body, dtype="<f8", count=n, offset=44 + 4 * parts + 16 * n + 16) if kind == _WITH_Z else np.zeros(n)
        rings = [np.column_stack([xy[a:b], z[a:b]]) for a, b in zip(starts, starts[1:], strict=False) if b > a]
        outer = next((r for r in rings if _turn(r) < 0), rings[0] if rings else None)
        holes = [r for r in rings if r is not outer and _turn(r) > 0 and _inside(outer, r[0, 0], r[0, 1])]
        yield [r.tolist() for r in ([outer, *holes] if outer is not None else [])]


def attributes(data: bytes) -> Iterator[dict | None]:
    """The values of each record by their names, text and numbers; None of a deleted record."""
    count, first, length = struct.unpack_from("<IHH", data, 4)
    fields, at, place = [], 32, 1
    while at + 32 <= first and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("utf-8", "replace")
        kind, size, decimals = chr(data[at + 11]), data[at + 16], data[at + 17]
        fields.append((name, kind, place, place + size, decimals))
        at, place = at + 32, place + size
    for i in range(count):
        record = data[first + i * length : first + (i + 1) * length]
        if len(record) < length:
            raise VectorError("the table ends within a record")
        values = {}
        for name, kind, a, b, decimals in fields:
            text = record[a:b].decode("utf-8", "replace").strip("\0 ")
            if text and kind == "C":
                values[name] = text
            elif text and kind in "NF":
                try:
                    values[name] = int(text) if not decimals and kind == "N" else float(text)
                except ValueError:
                    continue
        yield None if record[:1] == b"*" else values


def _together(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, shp, dbf, prj) of the files below a folder, or of a pattern that covers all three endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    named = files.withColumn("name", F.regexp_replace("path", r"\.[^./]*$", "")).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    own = lambda k: F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k)
    return named.where(F.col("kind").isin("shp", "dbf", "prj")).groupBy("name").agg(own("shp"), own("dbf"), own("prj")).where("shp is not null")


def scan_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Footprints (fid, polygon, attributes) of a folder's shapefiles; fid is the record's place. Null shapes and deleted records are left out."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for shp, dbf in zip(batch.column(0), batch.column(1), strict=True):
                table = attributes(dbf.as_py()) if dbf.is_valid else iter(())
                yield _given((i, rings, values) for i, (rings, values) in enumerate((r, next(table, {})) for r in shapes(shp.as_py())) if values is not None)

    return typed(_together(spark, path).select("shp", "dbf").mapInArrow(run, _ROW))


def scan_shapefile_crs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, epsg): the code that each file's .prj names; null without one."""
    return _together(spark, path).select(F.element_at(F.split("name", "/"), -1).alias("name"), wkt_epsg(F.decode("prj", "utf-8")).alias("epsg"))


def encode_shapefile(rows: list[tuple[list, dict]]) -> tuple[bytes, bytes]:
    """(.shp, .dbf) of polygons as rings of (x, y, z), exterior first, and their attributes: text and numbers."""
    out, number = [], 0
    for rings, _ in rows:
        number += 1
        turned = []
        for i, ring in enumerate(rings):
            r = np.array(ring, dtype=float)
            turned.append(r[::-1] if (_turn(r) < 0) == bool(i) else r)
        if not turned:
            out.append(struct.pack(">2i", number, 2) + struct.pack("<i", 0))
            continue
        flat, starts = np.concatenate(turned), np.cumsum([0, *map(len, turned)])[:-1]
        box = [*flat[:, :2].min(axis=0), *flat[:, :2].max(axis=0)]
        body = struct.pack("<i4d2i", _WITH_Z, *box, len(turned), len(flat)) + starts.astype("<i4").tobytes() + flat[:, :2].astype("<f8").tobytes()
        body += struct.pack("<2d", flat[:, 2].min(), flat[:, 2].max()) + flat[:, 2].astype("<f8").tobytes()
        out.append(struct.pack(">2i", number, len(body) // 2) + body)
    size = 100 + sum(map(len, out))
    shp = struct.pack(">7i", _CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, _WITH_Z, *[0.0] * 8) + b"".join(out)
    names = sorted({k for _, values in rows for k in values})
    kinds = {k: "C" if any(isinstance(v.get(k), str) for _, v in rows) else "F" if any(isinstance(v.get(k), float) for _, v in rows) else "N" for k in names}
    text = lambda v, kind: "" if v is None else str(v) if kind != "F" else repr(float(v))
    width = {k: max(1, *(len(text(v.get(k), kinds[k]).encode()) for _, v in rows)) for k in names}
    fields = b"".join(struct.pack("<11sc4xBB14x", k.encode()[:10], kinds[k].encode(), width[k], 6 if kinds[k] == "F" else 0) for k in names)
    records = b"".join(b" " + b"".join(text(v.get(k), kinds[k]).encode().ljust(width[k]) for k in names) for _, v in rows)
    head = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(fields), 1 + sum(width.values()))
    return shp, head + fields + b"\r" + records
