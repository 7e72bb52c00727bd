"""Schemas of the flat tables and the parameters of plane detection."""

from __future__ import annotations

from dataclasses import dataclass

POINT = "struct<x:double,y:double,z:double>"
RING = f"array<{POINT}>"
POLYGON = f"struct<exterior:{RING},interiors:array<{RING}>>"
POINTS_SCHEMA = "pid long, x double, y double, z double"
PLANE = "struct<plane_id:int,nx:double,ny:double,nz:double,d:double,rmse:double>"
FACE = "struct<indices:array<int>,semantic_index:int>"
SEMANTIC = (
    "struct<surface_type:string,on_footprint_edge:boolean,azimuth:double,slope:double,"
    "h_roof_50p:double,h_roof_70p:double,h_roof_min:double,h_roof_max:double>"
)
MESH = f"struct<vertices:{RING},faces:array<{FACE}>,semantics:array<{SEMANTIC}>>"


@dataclass(frozen=True)
class RansacConfig:
    """Plane detection. near_vertical: planes steeper than 90 less this many degrees are refused. These defaults are the ones in use; DEFAULTS are the library's own."""

    epsilon: float = 0.25
    max_iterations: int = 2000
    min_points: int = 10
    max_planes: int = 25
    near_vertical: float = 70.0
    merge_angle: float = 10.0
    merge_distance: float = 0.4


#: The detector's library defaults, which no method uses.
DEFAULTS = RansacConfig(0.3, 1000, 15, 20, 70.0, 7.5, 0.5)

#: Planes of a building at most; points below which the roof is flat; roof above ground without points.
MOST_PLANES, FEWEST_POINTS, BARE_HEIGHT = 20, 5, 5.0
#: Radius and least score of a vote; radius and penalty of a data cost; scale of written vertices; CRS where none is known.
VOTE_RADIUS, LEAST_VOTES, COST_RADIUS, NO_SUPPORT, SCALE, DEFAULT_EPSG = 3.0, 2, 2.0, 10.0, 0.001, "2154"
