"""Roof planes: their detection in a grouped kernel, and the algebra around them as plans."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.functions import geometry as g
from gablework.model import MOST_PLANES, RansacConfig

PLANES_SCHEMA = "fid {fid}, plane_id int, nx double, ny double, nz double, d double, rmse double, n_inliers int, inliers array<struct<pid:long,x:double,y:double,z:double>>"


# the kernel; points are taken about their mean, so large coordinates don't cost precision


def triples(n: int, iterations: int, seed: int) -> np.ndarray:
    """Three different positions below n for each iteration, each triple as likely as another; the same for the same n and seed. None where n < 3."""
    if n < 3:
        return np.zeros((0, 3), dtype=np.int64)
    first, second, third = np.random.default_rng([seed, n]).integers(0, [[n], [n - 1], [n - 2]], size=(3, iterations))
    second = second + (second >= first)
    third = third + (third >= np.minimum(first, second))
    return np.stack([first, second, third + (third >= np.maximum(first, second))], axis=1)


def _slope(nz: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.minimum(1.0, np.abs(nz))))


def least_squares(points: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """Normal (upward), d and rmse of the plane that fits best; None of fewer than three points."""
    if len(points) < 3:
        return None
    centre = points.mean(axis=0)
    away = points - centre
    values, vectors = np.linalg.eigh(away.T @ away)
    normal = vectors[:, int(np.argmin(np.abs(values)))]
    if normal[2] < 0:
        normal = -normal
    return normal, -float(normal @ centre), float(np.sqrt(np.mean((away @ normal) ** 2)))


def best_hypothesis(points: np.ndarray, picked: np.ndarray, config: RansacConfig) -> np.ndarray | None:
    """Which points the best triple's plane holds; of ties the earliest."""
    best, held = 0, None
    for start in range(0, len(picked), 512):
        p = points[picked[start : start + 512]]
        normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        size = np.linalg.norm(normal, axis=1)
        fit = size >= 1e-10
        normal = normal[fit] / size[fit, None]
        keep = ~(_slope(normal[:, 2]) > 90 - config.near_vertical)
        normal, origin = normal[keep], p[fit][keep][:, 0]
        if not len(normal):
            continue
        near = np.abs(normal @ points.T - np.einsum("ij,ij->i", normal, origin)[:, None]) < config.epsilon
        counts = near.sum(axis=1)
        i = int(counts.argmax())
        if counts[i] > best:
            best, held = int(counts[i]), near[i]
    return held


def ransac_one(points: np.ndarray, picked: np.ndarray, config: RansacConfig) -> tuple[np.ndarray, float, float, np.ndarray] | None:
    """One plane: the best hypothesis of the picked triples, fitted anew to its points by least squares, its points counted anew; None if they are too few or the plane too steep. (normal, d, rmse, which points)."""
    held = best_hypothesis(points, picked, config)
    if held is None or held.sum() < config.min_points or (fit := least_squares(points[held])) is None:
        return None
    normal, d, rmse = fit
    inlier = np.abs(points @ normal + d) < config.epsilon
    if inlier.sum() < config.min_points or _slope(normal[2]) > 90 - config.near_vertical:
        return None
    return normal, d, rmse, inlier


def detect_planes_of(points: np.ndarray, seed: int, config: RansacConfig, most: int = MOST_PLANES) -> list[tuple[np.ndarray, float, float, np.ndarray]]:
    """(normal, d, rmse, positions of its points) of each plane: found one after the other, each on what the ones before left, then merged."""
    if not len(points):
        return []
    origin = points.mean(axis=0)
    local, left, planes = points - origin, np.arange(len(points)), []
    for _ in range(min(most, config.max_planes)):
        if len(left) < max(3, config.min_points):
            break
        found = ransac_one(local[left], triples(len(left), config.max_iterations, seed), config)
        if found is None:
            break
        normal, d, rmse, inlier = found
        planes.append((normal, d, rmse, left[inlier]))
        left = left[~inlier]
    return [(n, d - float(n @ origin), r, at) for n, d, r, at in merged_planes(local, planes, config)]


def merged_planes(points: np.ndarray, planes: list, config: RansacConfig) -> list:
    """Each plane takes in the later ones that lie in its direction and near its points' mean; all are fitted anew."""
    if len(planes) <= 1:
        return planes
    gone, out = set(), []
    for i, (normal, _, _, at) in enumerate(planes):
        if i in gone:
            continue
        together, centre = [at], points[at].mean(axis=0)
        for j in range(i + 1, len(planes)):
            other, d = planes[j][0], planes[j][1]
            angle = math.acos(min(1.0, abs(float(normal @ other))))
            if j not in gone and angle <= math.radians(config.merge_angle) and abs(float(other @ centre) + d) <= config.merge_distance:
                together.append(planes[j][3])
                gone.add(j)
        all_at = np.concatenate(together)
        if (fit := least_squares(points[all_at])) is not None:
            out.append((*fit, all_at))
    return out


def seed_of(fid) -> int:
    return int(fid) % 2**64 if isinstance(fid, (int, np.integer)) else zlib.crc32(str(fid).encode())


#: What a kernel's arithmetic can fail with; anything else is an error of the program and ends the run.
FAILURES = (np.linalg.LinAlgError, ArithmeticError, ValueError)
_POINT = pa.struct([("pid", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])


def _plane_rows(fid: pa.Scalar, found: list, pid: np.ndarray, points: np.ndarray) -> pa.Table:
    """(plane_id, (normal, d, rmse, positions)) as rows of PLANES_SCHEMA; the points' lists are cut from columns, none is made a Python object."""
    at = [np.sort(p[3]) for _, p in found]
    flat = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
    own = pa.StructArray.from_arrays([pa.array(pid[flat]), *(pa.array(points[flat, k]) for k in range(3))], fields=list(_POINT))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, at)]), type=pa.int32()), own)
    numbers = [[float(x) for x in (*p[0], p[1], p[2])] for _, p in found]
    columns = [pa.array([fid.as_py()] * len(found), type=fid.type), pa.array([i for i, _ in found], type=pa.int32())]
    columns += [pa.array([row[k] for row in numbers], type=pa.float64()) for k in range(5)]
    return pa.Table.from_arrays([*columns, pa.array([len(x) for x in at], type=pa.int32()), lists], names=["fid", "plane_id", "nx", "ny", "nz", "d", "rmse", "n_inliers", "inliers"])


def _by_building(cropped: DataFrame, kernel) -> DataFrame:
    """Rows of PLANES_SCHEMA: kernel(points, fid) of each building's points in the order of pid."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pid")
        pid, points = group["pid"].to_numpy(), np.stack([group[k].to_numpy() for k in "xyz"], axis=1)
        fid = group["fid"][0]
        return _plane_rows(fid, kernel(points, fid.as_py()), pid, points)

    kind = dict(cropped.dtypes)["fid"]
    session = cropped.sparkSession  # so many tasks however few bytes: the kernel's time is in its arithmetic
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return cropped.select("fid", F.col("pid").cast("long"), "x", "y", "z").repartition(tasks, "fid").groupBy("fid").applyInArrow(run, PLANES_SCHEMA.format(fid=kind))


def detect_planes(cropped: DataFrame, config: RansacConfig = RansacConfig(), most: int = MOST_PLANES) -> DataFrame:
    """Rows (fid, plane_id, nx, ny, nz, d, rmse, n_inliers, inliers) of the buildings' planes; inliers are (pid, x, y, z), in the order of pid.

    One building is one group. A building whose kernel fails gives a row of plane_id -1, and no other suffers.
    """

    def kernel(points: np.ndarray, fid) -> list:
        try:
            return list(enumerate(detect_planes_of(points, seed_of(fid), config, most)))
        except FAILURES:
            return [(-1, (np.zeros(3), 0.0, 0.0, np.zeros(0, dtype=np.int64)))]

    return _by_building(cropped, kernel)


def numbered_triples(n: int, iterations: int, fid: int) -> np.ndarray:
    """Three different positions below n for each iteration that has them, by a rule that SQL can state too; the iterations without are left out."""
    i = np.arange(iterations, dtype=np.int64)
    k = [(i * a + fid * b + e) % prime % n for e, (a, b, prime) in enumerate(((7_919, 31, 10_007), (104_729, 17, 20_011), (1_299_709, 7, 30_011)))]
    return np.stack([i, *k], axis=1)[(k[0] != k[1]) & (k[0] != k[2]) & (k[1] != k[2])]


def ransac_round(cropped: DataFrame, config: RansacConfig = RansacConfig()) -> DataFrame:
    """Rows of PLANES_SCHEMA: ransac_one of all points of each building (of a number as fid), over numbered_triples; plane_id 0. Buildings without such a plane have none."""

    def kernel(points: np.ndarray, fid) -> list:
        found = ransac_one(points, numbered_triples(len(points), config.max_iterations, fid)[:, 1:], config) if len(points) >= 3 else None
        return [(0, (*found[:3], np.flatnonzero(found[3])))] if found else []

    return _by_building(cropped, kernel)


def hypothesis_round(cropped: DataFrame, config: RansacConfig = RansacConfig()) -> DataFrame:
    """Rows (fid, n_inliers) of each building's best first hypothesis over numbered_triples."""

    def kernel(points: np.ndarray, fid) -> list:
        held = best_hypothesis(points, numbered_triples(len(points), config.max_iterations, fid)[:, 1:], config) if len(points) >= 3 else None
        return [(0, (np.zeros(3), 0.0, 0.0, np.flatnonzero(held)))] if held is not None else []

    return _by_building(cropped, kernel).select("fid", "n_inliers")


def merge_planes(planes: DataFrame, config: RansacConfig = RansacConfig()) -> DataFrame:
    """Rows of PLANES_SCHEMA with the planes of each building merged: in the order of plane_id each takes in the later ones near it, and what comes out is fitted to all their points and numbered anew."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("plane_id")
        lists = group["inliers"].combine_chunks()
        points = lists.flatten()
        xyz, ends = np.stack([points.field(k).to_numpy() for k in "xyz"], axis=1).reshape(-1, 3), np.cumsum([0, *(len(x) for x in lists)])
        normals = np.stack([group[k].to_numpy() for k in ("nx", "ny", "nz")], axis=1)
        own = [(n, d, r, np.arange(ends[i], ends[i + 1])) for i, (n, d, r) in enumerate(zip(normals, group["d"].to_pylist(), group["rmse"].to_pylist(), strict=True))]
        origin = xyz.mean(axis=0) if len(xyz) else np.zeros(3)
        local = [(n, d + float(n @ origin), r, at) for n, d, r, at in own]
        found = merged_planes(xyz - origin, local, config)
        return _plane_rows(group["fid"][0], [(i, (n, d - float(n @ origin), r, at)) for i, (n, d, r, at) in enumerate(found)], points.field("pid").to_numpy(), xyz)

    kind = dict(planes.dtypes)["fid"]
    return planes.where("plane_id >= 0").groupBy("fid").applyInArrow(run, PLANES_SCHEMA.format(fid=kind))


# plans


def plane_inliers(planes: DataFrame, cropped: DataFrame, epsilon: float = RansacConfig.epsilon) -> DataFrame:
    """Rows (fid, plane_id, pid, x, y, z) of all points strictly nearer than epsilon to a plane of their building."""
    met = planes.select("fid", "plane_id", "nx", "ny", "nz", "d").join(cropped, "fid")
    c = F.col
    return met.where(g.plane_distance(c("nx"), c("ny"), c("nz"), c("d"), c("x"), c("y"), c("z")) < epsilon).select("fid", "plane_id", "pid", "x", "y", "z")


def remaining_points(cropped: DataFrame, inliers: DataFrame) -> DataFrame:
    """The points that are no plane's."""
    return cropped.join(inliers.select("fid", "pid").distinct(), ["fid", "pid"], "left_anti")


def inlier_centroids(inliers: DataFrame) -> DataFrame:
    return inliers.groupBy("fid", "plane_id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))


def covariances(inliers: DataFrame) -> DataFrame:
    """Rows (fid, plane_id, n, mx, my, mz, xx, xy, xz, yy, yz, zz): sums of products about the mean, taken in two passes."""
    means = inlier_centroids(inliers)
    away = inliers.join(means, ["fid", "plane_id"]).select("fid", "plane_id", "n", "mx", "my", "mz", *[(F.col(a) - F.col(f"m{a}")).alias(f"d{a}") for a in "xyz"])
    sums = [F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return away.groupBy("fid", "plane_id", "n", "mx", "my", "mz").agg(*sums)


def fitted_planes(inliers: DataFrame) -> DataFrame:
    """Rows (fid, plane_id, nx, ny, nz, d, rmse, n) of the least-squares planes, by the closed form of a symmetric matrix's smallest eigenvalue.

    Planes of fewer than three points, and points without a plane of their own, have none.
    """
    c, z = F.col, F.lit(0.0)
    m = covariances(inliers).where("n >= 3").withColumn("q", (c("xx") + c("yy") + c("zz")) / 3)
    spread = ((c("xx") - c("q")) * (c("xx") - c("q")) + (c("yy") - c("q")) * (c("yy") - c("q")) + (c("zz") - c("q")) * (c("zz") - c("q")) + 2 * (c("xy") * c("xy") + c("xz") * c("xz") + c("yz") * c("yz"))) / 6
    m = m.withColumn("p", F.sqrt(spread)).where("p > 0")
    for k, v in (("a", c("xx") - c("q")), ("b", c("yy") - c("q")), ("e", c("zz") - c("q"))):
        m = m.withColumn(k, v / c("p"))
    for k in ("xy", "xz", "yz"):
        m = m.withColumn(f"u{k}", c(k) / c("p"))
    det = c("a") * (c("b") * c("e") - c("uyz") * c("uyz")) - c("uxy") * (c("uxy") * c("e") - c("uyz") * c("uxz")) + c("uxz") * (c("uxy") * c("uyz") - c("b") * c("uxz"))
    m = m.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2)))
    m = m.withColumn("least", c("q") + 2 * c("p") * F.cos(F.acos(c("r")) / 3 + F.lit(2 * math.pi / 3)))
    row1, row2 = (c("xx") - c("least"), c("xy"), c("xz")), (c("xy"), c("yy") - c("least"), c("yz"))
    v = g.cross3(row1, row2)
    m = m.withColumn("vx", v[0]).withColumn("vy", v[1]).withColumn("vz", v[2]).withColumn("size", F.sqrt(c("vx") * c("vx") + c("vy") * c("vy") + c("vz") * c("vz"))).where("size > 0")
    m = m.withColumn("sign", F.when(c("vz") < 0, -1.0).otherwise(1.0) / c("size"))
    for k in "xyz":
        m = m.withColumn(f"n{k}", c(f"v{k}") * c("sign"))
    m = m.withColumn("d", z - (c("nx") * c("mx") + c("ny") * c("my") + c("nz") * c("mz")))
    return m.select("fid", "plane_id", "nx", "ny", "nz", "d", F.sqrt(F.greatest(z, c("least")) / c("n")).alias("rmse"), "n")


def plane_pairs(planes: DataFrame) -> DataFrame:
    """Rows (fid, i, j, a, b) of every two planes of a building, i < j; a and b are structs."""
    one = planes.select("fid", "plane_id", F.struct("nx", "ny", "nz", "d").alias("p"))
    other = one.select("fid", F.col("plane_id").alias("j"), F.col("p").alias("b"))
    return one.withColumnRenamed("plane_id", "i").withColumnRenamed("p", "a").join(other, "fid").where("i < j")


def ridgelines(planes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows (fid, i, j, x1, y1, x2, y2): where two planes of a building meet, cut to its box."""
    met = plane_pairs(planes).withColumn("line", g.intersect_planes(F.col("a"), F.col("b"))).where("line is not null").join(boxes, "fid")
    cut = g.clip_line(F.col("line"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return met.withColumn("s", cut).where("s is not null").select("fid", "i", "j", "s.*")


def merge_candidates(planes: DataFrame, centroids: DataFrame, config: RansacConfig = RansacConfig()) -> DataFrame:
    """Rows (fid, i, j) of the plane pairs that a merge would join: directions and distance within the limits."""
    c = F.col
    pairs = plane_pairs(planes).join(centroids.select("fid", c("plane_id").alias("i"), "mx", "my", "mz"), ["fid", "i"])
    cosine = F.abs(c("a.nx") * c("b.nx") + c("a.ny") * c("b.ny") + c("a.nz") * c("b.nz"))
    near = g.plane_distance(c("b.nx"), c("b.ny"), c("b.nz"), c("b.d"), c("mx"), c("my"), c("mz")) <= config.merge_distance
    return pairs.where((F.acos(F.least(F.lit(1.0), cosine)) <= F.radians(F.lit(config.merge_angle))) & near).select("fid", "i", "j")
