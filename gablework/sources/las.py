"""Uncompressed LAS point clouds.

A cloud is many files. Spark lists and reads them (any store that it reads), each file is a task's row, and its point
records are decoded in numpy. Only x, y and z are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADER = 227
#: GeoTIFF keys that hold a projected system's code, and the records that hold keys and WKT.
_EPSG_KEYS, _KEY_RECORD, _WKT_RECORD = (2048, 3072), 34735, 2112


class LasError(ValueError):
    """A file that isn't readable as uncompressed LAS."""


def _head(data: bytes) -> dict:
    if len(data) < _HEADER or data[:4] != b"LASF":
        raise LasError("not a LAS file")
    minor, size, offset, records = data[25], *struct.unpack_from("<HII", data, 94)
    kind, length, count = struct.unpack_from("<BHI", data, 104)
    if kind & 0xC0:
        raise LasError("LAZ-compressed points need a decompressor, which isn't at hand; decompress the file to LAS first")
    if minor >= 4 and size >= 375 and len(data) >= 375:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    return {"size": size, "offset": offset, "records": records, "length": length, "count": count, "scale": struct.unpack_from("<3d", data, 131), "shift": struct.unpack_from("<3d", data, 155)}


def decode_points(data: bytes) -> np.ndarray:
    """The points (n x 3) of a file's bytes; LasError if any can't be read."""
    h = _head(data)
    if len(data) < h["offset"] + h["count"] * h["length"]:
        raise LasError("the file ends within its points")
    record = np.dtype({"names": ["p"], "formats": [("<i4", 3)], "offsets": [0], "itemsize": h["length"]})
    raw = np.frombuffer(data, dtype=record, count=h["count"], offset=h["offset"])["p"]
    return raw * np.array(h["scale"]) + np.array(h["shift"])


def epsg_of(data: bytes) -> str | None:
    """The EPSG code of the file's keys, else of its WKT."""
    h, wkt, at = _head(data), None, 0
    at = h["size"]
    for _ in range(h["records"]):
        record, length = struct.unpack_from("<HH", data, at + 18)
        body = data[at + 54 : at + 54 + length]
        if record == _KEY_RECORD:
            for i in range(8, len(body) - 7, 8):
                key, place, _, value = struct.unpack_from("<4H", body, i)
                if key in _EPSG_KEYS and place == 0:
                    return str(value)
        elif record == _WKT_RECORD:
            wkt = body.decode("utf-8", "replace")
        at += 54 + length
    code = re.search(r'AUTHORITY\["EPSG","([^"]*)"', wkt or "")
    return code[1] if code and re.fullmatch("[0-9]+", code[1]) else None


def encode_las(points: np.ndarray, scale: float = 0.0001, epsg: int | None = None) -> bytes:
    """A LAS 1.2 file of format 0 that holds the points."""
    points = np.asarray(points, dtype=float).reshape(-1, 3)
    shift = np.floor(points.min(axis=0)) if len(points) else np.zeros(3)
    keys = b"" if epsg is None else struct.pack("<4H4H", 1, 1, 0, 1, 3072, 0, 1, epsg)
    record = b"" if epsg is None else struct.pack("<H16sHH32s", 0, b"LASF_Projection", _KEY_RECORD, len(keys), b"") + keys
    low, high = (points.min(axis=0), points.max(axis=0)) if len(points) else (np.zeros(3), np.zeros(3))
    head = b"LASF" + bytes(20) + bytes([1, 2]) + bytes(64) + bytes(4)
    head = head[:94] + struct.pack("<HIIBHI", _HEADER, _HEADER + len(record), int(epsg is not None), 0, 20, len(points)) + bytes(20)
    head += struct.pack("<12d", *[scale] * 3, *shift, *[v for pair in zip(high, low, strict=True) for v in pair])
    raw = np.zeros(len(points), dtype=np.dtype({"names": ["p"], "formats": [("<i4", 3)], "offsets": [0], "itemsize": 20}))
    raw["p"] = np.rint((points - shift) / scale)
    return head + record + raw.tobytes()


def point_ids(file: int, start: int, n: int) -> np.ndarray:
    """Ids of a file's points from a place on: a different one for each place of a file, spread over 64 bits by the file's hash."""
    x = np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(file % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def scan_las(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pid, x, y, z) of a file, folder or pattern. pid: a hash of 64 bits of the file's path and the point's place in it, so that no two points of a building share one. Coordinates that aren't finite are an error, as are missing paths."""

    def decoded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                xyz = decode_points(data.as_py())
                if not np.isfinite(xyz).all():
                    raise LasError("coordinates that aren't finite")
                for start in range(0, len(xyz), 1 << 20):
                    part = xyz[start : start + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(point_ids(file, start, len(part))), *(pa.array(part[:, k]) for k in range(3))], names=["pid", "x", "y", "z"])

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content")
    return files.mapInArrow(decoded, "pid long, x double, y double, z double")


def scan_las_crs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, epsg) of the files."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([epsg_of(x.as_py()) for x in batch.column(1)], type=pa.string())], names=["path", "epsg"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, epsg string")
