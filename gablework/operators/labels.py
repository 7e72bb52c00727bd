"""Which plane a roof cell belongs to: by votes or by cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.functions import geometry as g
from gablework.model import COST_RADIUS, LEAST_VOTES, NO_SUPPORT, VOTE_RADIUS


def _supported(sites: DataFrame, planes: DataFrame, inliers: DataFrame, radius: float, measure) -> DataFrame:
    """For every site and plane of a building the measure over the plane's inliers strictly within the radius; null or 0 without any."""
    c = F.col
    near = (c("x") - c("cx")) * (c("x") - c("cx")) + (c("y") - c("cy")) * (c("y") - c("cy")) < radius * radius
    # a grid of the radius: an inlier is in one square, a site asks its own and the eight around it
    square = lambda v: F.floor(v / (radius or 1.0))
    around = lambda v: F.explode(F.sequence(square(v) - 1, square(v) + 1))
    asked = sites.select("fid", "site_id", "cx", "cy", around(c("cx")).alias("gx")).select("*", around(c("cy")).alias("gy"))
    some = asked.join(inliers.withColumn("gx", square(c("x"))).withColumn("gy", square(c("y"))), ["fid", "gx", "gy"]).where(near).drop("gx", "gy")
    some = some.join(planes.select("fid", "plane_id", "nx", "ny", "nz", "d"), ["fid", "plane_id"])
    found = some.groupBy("fid", "site_id", "plane_id").agg(F.count("*").alias("support"), measure.alias("measure"))
    every = sites.select("fid", "site_id").join(planes.select("fid", "plane_id"), "fid")
    return every.join(found, ["fid", "site_id", "plane_id"], "left").withColumn("support", F.coalesce("support", F.lit(0)))


def inlier_votes(sites: DataFrame, planes: DataFrame, inliers: DataFrame, radius: float = VOTE_RADIUS) -> DataFrame:
    """Rows (fid, site_id, plane_id, votes) of every site (fid, site_id, cx, cy) and plane of a building."""
    return _supported(sites, planes, inliers, radius, F.count("*")).select("fid", "site_id", "plane_id", F.col("support").alias("votes"))


def label_vote(votes: DataFrame, planes: DataFrame) -> DataFrame:
    """Rows (fid, site_id, plane_id, votes): the plane with most votes, ties to the first.

    Below two votes the first plane that isn't vertical is taken: the points of every plane are equally near to it, so no
    distance tells planes apart there.
    """
    best = votes.groupBy("fid", "site_id").agg(F.max(F.struct("votes", (-F.col("plane_id")).alias("late"))).alias("b"))
    first = planes.where(F.abs("nz") >= 1e-10).groupBy("fid").agg(F.min("plane_id").alias("first"))
    best = best.join(first, "fid", "left").select("fid", "site_id", (-F.col("b.late")).alias("plane_id"), F.col("b.votes").alias("votes"), "first")
    own = F.when(F.col("votes") >= LEAST_VOTES, F.col("plane_id")).otherwise(F.coalesce("first", F.when(F.col("votes") > 0, F.col("plane_id"))))
    return best.select("fid", "site_id", own.alias("plane_id"), "votes")


def data_costs(sites: DataFrame, planes: DataFrame, inliers: DataFrame, radius: float = COST_RADIUS, penalty: float = NO_SUPPORT) -> DataFrame:
    """Rows (fid, site_id, plane_id, support, cost): the mean squared height error of the plane's own inliers around the site; the penalty without any."""
    c = F.col
    error = c("z") - g.eval_z(c("nx"), c("ny"), c("nz"), c("d"), c("x"), c("y"))
    return _supported(sites, planes, inliers, radius, F.avg(error * error)).select("fid", "site_id", "plane_id", "support", F.coalesce("measure", F.lit(penalty)).alias("cost"))


def label_cost(costs: DataFrame) -> DataFrame:
    """Rows (fid, site_id, plane_id, cost): the plane of least cost, ties to the first."""
    best = costs.groupBy("fid", "site_id").agg(F.min(F.struct("cost", "plane_id")).alias("b"))
    return best.select("fid", "site_id", "b.plane_id", "b.cost")


def nearest_cell(vertices: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows (fid, seq, cell_id, plane_id): for each vertex (fid, seq, vx, vy) the cell whose centre is nearest, ties to the first."""
    c = F.col
    met = vertices.join(labelled.select("fid", "site_id", "cx", "cy", "plane_id"), "fid")
    d2 = (c("cx") - c("vx")) * (c("cx") - c("vx")) + (c("cy") - c("vy")) * (c("cy") - c("vy"))
    best = met.groupBy("fid", "seq").agg(F.min(F.struct(d2.alias("d2"), "site_id", "plane_id")).alias("b"))
    return best.select("fid", "seq", F.col("b.site_id").alias("cell_id"), "b.plane_id")


def heights(rows: DataFrame, planes: DataFrame, x: str, y: str) -> DataFrame:
    """rows (fid, plane_id, x, y) with z: the plane's height there; null without a plane or of a vertical one."""
    c = F.col
    met = rows.join(planes.select("fid", "plane_id", "nx", "ny", "nz", "d"), ["fid", "plane_id"], "left")
    return met.withColumn("z", g.eval_z(c("nx"), c("ny"), c("nz"), c("d"), c(x), c(y))).drop("nx", "ny", "nz", "d")


def cell_adjacency(cells: DataFrame, decimals: int = 6) -> DataFrame:
    """Rows (fid, a, b, len), a < b: cells (fid, site_id, x0 ... y2) of a building that share an edge, and its length. Corners are the same where they agree to so many decimals. Costs and votes don't use it; a smoothing labelling would."""
    c, r = F.col, lambda k: F.round(k, decimals)
    corner = lambda i: F.struct(r(f"x{i}").alias("x"), r(f"y{i}").alias("y"))
    side = lambda i, j: F.struct(F.least(corner(i), corner(j)).alias("p"), F.greatest(corner(i), corner(j)).alias("q"))
    edges = cells.select("fid", "site_id", F.explode(F.array(side(0, 1), side(1, 2), side(2, 0))).alias("e"))
    own = edges.groupBy("fid", "e").agg(F.min("site_id").alias("a"), F.max("site_id").alias("b")).where("a < b")
    dx, dy = c("e.q.x") - c("e.p.x"), c("e.q.y") - c("e.p.y")
    return own.select("fid", "a", "b", F.sqrt(dx * dx + dy * dy).alias("len"))
