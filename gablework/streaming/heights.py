"""Heights as points come in: an extension, since building tables are otherwise made from whole clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.operators.crop import crop_points


def running_heights(points: DataFrame, footprints: DataFrame) -> DataFrame:
    """A streaming (fid, n, z_min, z_max, z_mean) of streaming points over static footprints; for update or complete output. State is a row for each footprint."""
    cropped = crop_points(points, footprints)
    return cropped.groupBy("fid").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"))
