"""Points as two columns of degrees, lon and lat."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

# Mean radius of the earth in metres, places and boxes as (lon, lat) and (west, south, east, north).
RADIUS = 6371008.8
LISBON, PORTO = (-9.1393, 38.7223), (-8.6291, 41.1579)
BOXES = {"lisbon": (-9.3, 38.6, -9.0, 38.8), "porto": (-8.8, 41.0, -8.4, 41.3), "large": (-9.5, 38.0, -7.5, 42.0)}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Metres on the sphere."""
    a, b, c, d = (F.radians(_col(x)) for x in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((d - b) / 2), F.lit(2)) + F.cos(b) * F.cos(d) * F.pow(F.sin((c - a) / 2), F.lit(2))
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside, not on the edge."""
    west, south, east, north = map(float, box)
    return (lon > west) & (lon < east) & (lat > south) & (lat < north)


def within_radius(lon: Column, lat: Column, point: tuple[float, float], metres: float) -> Column:
    """With a box around it first, which scans can use."""
    up = math.degrees(metres / RADIUS) * (1 + 1e-9)
    far = math.cos(math.radians(min(89.9, abs(point[1]) + up)))
    side = min(180.0, math.degrees(2 * math.asin(min(1.0, math.sin(metres / RADIUS / 2) / far))) * (1 + 1e-9)) if metres / RADIUS < math.pi / 2 else 180.0
    return lat.between(point[1] - up, point[1] + up) & lon.between(point[0] - side, point[0] + side) & (haversine(lon, lat, *point) <= metres)


def planar(lon: Column, lat: Column, point: tuple[float, float]) -> Column:
    """Degrees on the plane."""
    return F.sqrt(F.pow(lon - point[0], F.lit(2)) + F.pow(lat - point[1], F.lit(2)))


def nearer(lon: Column, lat: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    return haversine(lon, lat, *a) < haversine(lon, lat, *b)


def valid(lon: Column, lat: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def parse_point(wkt: Column) -> Column:
    """POINT (lon lat) to a struct, null for anything else."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    pattern = rf"^\s*POINT\s*\(\s*({number})\s+({number})\s*\)\s*$"
    lon, lat = (F.regexp_extract(wkt, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def centroid(ring: Column) -> Column:
    """Of the polygon whose corners an array of (lon, lat) holds, closed or not; null below three corners or without area."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def edge(p: Column, q: Column) -> Column:
        cross = p["lon"] * q["lat"] - q["lon"] * p["lat"]
        return F.struct(cross.alias("area"), ((p["lon"] + q["lon"]) * cross).alias("east"), ((p["lat"] + q["lat"]) * cross).alias("north"))

    def middle(edges: Column) -> Column:
        total = {k: F.aggregate(edges[k], F.lit(0.0), lambda s, v: s + v) for k in ("area", "east", "north")}
        return F.when((F.size(edges) > 2) & (total["area"] != 0), F.struct((total["east"] / (3 * total["area"])).alias("lon"), (total["north"] / (3 * total["area"])).alias("lat")))

    return let(F.zip_with(ring, following, edge), middle)


def cell(lon: Column, lat: Column, degrees: float) -> Column:
    """A grid cell, to partition or block by."""
    return F.concat_ws(":", F.floor(lon / degrees).cast("string"), F.floor(lat / degrees).cast("string"))
