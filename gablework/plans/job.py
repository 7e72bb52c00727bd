"""The whole run: python -m gablework.plans.job --footprints F --pointcloud P --output O [--method M]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from gablework.model import DEFAULT_EPSG, RansacConfig
from gablework.operators import cityjson, crop
from gablework.plans.reconstruct import METHODS, reconstruct
from gablework.scratch import clear, written
from gablework.sources import las, shapefile, vector


def read_footprints(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Footprints and their EPSG code by the path's ending: .gpkg, .geojson or .json, .shp (its .dbf and .prj beside it), else Parquet of (fid, polygon, attributes)."""
    if path.endswith(".gpkg"):
        found = vector.scan_geopackage_crs(spark, path).where("epsg is not null").select("epsg").first()
        return vector.scan_geopackage(spark, path), found and found["epsg"]
    if path.endswith((".geojson", ".json")):
        found = vector.scan_geojson_crs(spark, path).where("epsg is not null").select("epsg").first()
        return vector.scan_geojson(spark, path), found and found["epsg"]
    if path.endswith(".shp"):
        beside = f"{path[:-4]}.{{shp,dbf,prj}}"
        found = shapefile.scan_shapefile_crs(spark, beside).where("epsg is not null").select("epsg").first()
        return shapefile.scan_shapefile(spark, beside), found and found["epsg"]
    return spark.read.parquet(path), None


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of LAS files (.las, .laz is refused) or of Parquet (pid, x, y, z)."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else las.scan_las(spark, path)


def run(spark: SparkSession, footprints: str, pointcloud: str, output: str, method: str = "graph-cut", date: str | None = None, single_file: bool = False, config: RansacConfig = RansacConfig()) -> dict:
    """Writes output/output.city.jsonl and returns how many buildings have a mesh and how many don't."""
    ground, epsg = read_footprints(spark, footprints)
    try:
        ground = written(ground, "footprints")
        buildings = written(reconstruct(ground, read_points(spark, pointcloud), METHODS[method](), config), "reconstructed")
        lines = cityjson.city_lines(buildings, crop.dataset_centroid(ground), epsg or DEFAULT_EPSG, date)
        cityjson.write_city(lines, f"{output.rstrip('/')}/output.city.jsonl", single_file)
        return cityjson.run_summary(buildings).first().asDict()
    finally:
        clear(spark)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Buildings from a point cloud and footprints")
    for name in ("footprints", "pointcloud", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--method", choices=sorted(METHODS), default="graph-cut")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gablework").getOrCreate()
    print(run(spark, args.footprints, args.pointcloud, args.output, args.method))


if __name__ == "__main__":
    main()
