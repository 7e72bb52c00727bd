"""A deterministic scene from the tables supplier and lineitem: a footprint for each supplier, a point for each line.

The text is the same SQL for Spark and DuckDB. Four footprint shapes and four roofs; some points lie outside every
footprint, some are lifted as outliers. pid counts a supplier's lines, so numbering needs no global order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gablework.functions import geometry as g
from gablework.functions import text as t

#: Corners of the four shapes (shape, ring, place, u, v) in metres.
SHAPES = """
  (0,0,0,0.0,0.0),(0,0,1,12.0,0.0),(0,0,2,12.0,10.0),(0,0,3,0.0,10.0),(0,0,4,0.0,0.0),
  (1,0,0,0.0,0.0),(1,0,1,12.0,0.0),(1,0,2,12.0,5.0),(1,0,3,6.0,5.0),(1,0,4,6.0,10.0),(1,0,5,0.0,10.0),(1,0,6,0.0,0.0),
  (2,0,0,0.0,0.0),(2,0,1,12.0,0.0),(2,0,2,12.0,10.0),(2,0,3,0.0,10.0),(2,0,4,0.0,0.0),
  (2,1,0,4.0,3.0),(2,1,1,8.0,3.0),(2,1,2,8.0,7.0),(2,1,3,4.0,7.0),(2,1,4,4.0,3.0),
  (3,0,0,1.0,0.0),(3,0,1,12.0,2.0),(3,0,2,10.0,10.0),(3,0,3,0.0,8.0),(3,0,4,1.0,0.0)"""

FOOTPRINT_CTE = f"""
fp as (
  select s_suppkey as fid, s_name as name, s_nationkey as nation, s_acctbal as balance,
         cast(1000 + 20*(s_suppkey % 32) as double) as ox,
         cast(2000 + 20*cast(floor(s_suppkey/32) as bigint) as double) as oy,
         s_suppkey % 4 as shape, cast(floor(s_suppkey/4) as bigint) % 4 as roof
  from supplier),
tmpl(shape, ring, seq, u, v) as (values {SHAPES}),
vert as (
  select fid, ring, seq, ox + cast(u as double) as x, oy + cast(v as double) as y
  from fp join tmpl on fp.shape = tmpl.shape)"""

POINT_CTE = """
pl as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ox, oy, roof,
    cast((l_orderkey*37 + l_linenumber*11) % 1400 as double)/100.0e0 - 1.0e0 as u,
    cast((l_partkey*53 + l_orderkey*17 + l_linenumber*7) % 1200 as double)/100.0e0 - 1.0e0 as v,
    (l_quantity - 25.5e0)/500.0e0 + case when l_linenumber = 7 then 1.5e0 else 0.0e0 end as e
  from lineitem join fp on l_suppkey = fid),
pt as (
  select l_suppkey*1000000 + row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as pid,
    ox + u as x, oy + v as y,
    case roof when 0 then 8.0e0 + e
              when 1 then 8.0e0 - 0.25e0*abs(v - 5.0e0) + e
              when 2 then 6.0e0 + 0.2e0*u + e
              else 12.0e0 - 1.0e0*abs(v - 5.0e0) + e end as z
  from pl)"""

#: The roofs' exact surfaces z = a u + b v + c (roof, plane, a, b, c), and four cells around (5, 4).
GIVEN_CTE = """
pcoef(roof, plane_id, a, b, c) as (values
  (0,0,0.0,0.0,8.0),
  (1,0,0.0,0.25,6.75),(1,1,0.0,-0.25,9.25),
  (2,0,0.2,0.0,6.0),
  (3,0,0.0,1.0,7.0),(3,1,0.0,-1.0,17.0)),
plane0 as (
  select fid, plane_id, cast(a as double) as a, cast(b as double) as b, cast(c as double) as c, ox, oy
  from fp join pcoef on fp.roof = pcoef.roof),
plane_given as (
  select fid, plane_id, 0.0e0 - a/sqrt(a*a + b*b + 1.0e0) as nx, 0.0e0 - b/sqrt(a*a + b*b + 1.0e0) as ny,
    1.0e0/sqrt(a*a + b*b + 1.0e0) as nz, (a*ox + b*oy - c)/sqrt(a*a + b*b + 1.0e0) as d
  from plane0),
ctmpl(cell_id, u0, v0, u1, v1, u2, v2) as (values
  (0,0.0,0.0,12.0,0.0,5.0,4.0),(1,12.0,0.0,12.0,10.0,5.0,4.0),
  (2,12.0,10.0,0.0,10.0,5.0,4.0),(3,0.0,10.0,0.0,0.0,5.0,4.0)),
cell_given as (
  select fid, cell_id, ox + cast(u0 as double) as x0, oy + cast(v0 as double) as y0, ox + cast(u1 as double) as x1, oy + cast(v1 as double) as y1,
    ox + cast(u2 as double) as x2, oy + cast(v2 as double) as y2,
    ox + cast(u0 + u1 + u2 as double)/3.0e0 as cx, oy + cast(v0 + v1 + v2 as double)/3.0e0 as cy
  from fp cross join ctmpl)"""


class Fixture:
    """The scene's tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("supplier", "lineitem")}

    def _sql(self, ctes: list[str], select: str) -> DataFrame:
        text = "with " + ",".join(ctes) + " " + select
        used = {n: df for n, df in self.tables.items() if n in text}
        for n in used:
            text = text.replace(f"from {n}", f"from {{{n}}}")
        return self.spark.sql(text, **used)

    @property
    def footprints(self) -> DataFrame:
        """(fid, polygon, attributes): name, nation and balance as attributes."""
        vertices = self._sql([FOOTPRINT_CTE], "select v.fid, ring, seq, x, y, name, nation, balance from vert v join fp on fp.fid = v.fid")
        at = F.struct("seq", g.point(F.col("x"), F.col("y"), F.lit(0.0)).alias("p"))
        rings = vertices.groupBy("fid", "name", "nation", "balance", "ring").agg(F.transform(F.sort_array(F.collect_list(at)), lambda s: s["p"]).alias("points"))
        whole = rings.groupBy("fid", "name", "nation", "balance").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("rings"))
        inner = F.transform(F.filter("rings", lambda r: r["ring"] > 0), lambda r: r["points"])
        polygon = F.struct(F.get("rings", F.lit(0))["points"].alias("exterior"), inner.alias("interiors"))
        attributes = t.attribute_map({"name": F.col("name"), "nation": F.col("nation"), "balance": F.col("balance")})
        return whole.select("fid", polygon.alias("polygon"), attributes.alias("attributes"))

    @property
    def points(self) -> DataFrame:
        return self._sql([FOOTPRINT_CTE, POINT_CTE], "select pid, x, y, z from pt")

    @property
    def planes(self) -> DataFrame:
        """The given planes: the roofs' exact surfaces."""
        return self._sql([FOOTPRINT_CTE, GIVEN_CTE], "select fid, plane_id, nx, ny, nz, d from plane_given")

    @property
    def cells(self) -> DataFrame:
        return self._sql([FOOTPRINT_CTE, GIVEN_CTE], "select fid, cell_id as site_id, x0, y0, x1, y1, x2, y2, cx, cy from cell_given")
