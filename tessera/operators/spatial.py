"""Nearest neighbours and layouts for spatial scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.spatial import RADIUS, haversine, planar
from tessera.sources.scratch import stored


def nearest(points: DataFrame, point: tuple[float, float], k: int, key: str) -> DataFrame:
    """The k nearest on the plane, ties by key."""
    return points.withColumn("distance", planar(F.col("lon"), F.col("lat"), point)).orderBy("distance", key).limit(k)


def batch_nearest(queries: DataFrame, points: DataFrame, k: int, key: str, query: str, degrees: float) -> DataFrame:
    """The k nearest points (metres) of each query, ties by key; exact. Metres are rounded to micrometres before they are compared: two points as far
    away, to the east and to the west, are a tie whatever the last bits of sines and cosines say.

    Points are sought in the query's grid cell and the eight around it. Where what lies outside may be nearer than the k-th found, or fewer
    are found, the query goes on with cells twice as wide, in the end with all points. ``degrees``: width of the first cells.
    Queries of one place are answered once, and of points of one place the k smallest keys take part.
    """
    first = Window.partitionBy("lon", "lat").orderBy(key)
    few = points.where("lon is not null and lat is not null").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    points = stored(few.groupBy("lon", "lat").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key")))).alias("_keys")))
    sites = queries.select(F.col(query), F.col("lon").alias("qlon"), F.col("lat").alias("qlat")).where("qlon is not null and qlat is not null")
    places = stored(sites.select("qlon", "qlat").distinct().withColumn("_place", F.monotonically_increasing_id()))
    near = _nearest_of_places(places, points, k, degrees)
    return sites.join(places, ["qlon", "qlat"]).join(near, "_place").select(query, F.col("key").alias(key), "metres", "rank")


def _nearest_of_places(left: DataFrame, points: DataFrame, k: int, degrees: float) -> DataFrame:
    """``_place, key, metres, rank`` for places (_place, qlon, qlat) among points (lon, lat, _keys)."""
    done = None
    while True:
        whole = degrees >= 360
        found = _ranked(left if whole else _windows(left, degrees), points if whole else points.withColumn("_x", F.floor(F.col("lon") / degrees)).withColumn("_y", F.floor(F.col("lat") / degrees)), k, whole)
        if whole:
            return found if done is None else done.unionByName(found)
        found = stored(found)
        # A metre less for rounding: of points at one distance the smaller key wins, wherever it is.
        full = found.groupBy("_place").agg(F.count("*").alias("_n"), F.max("metres").alias("_far"))
        sure = stored(left.join(full, "_place").where((F.col("_n") >= k) & (F.col("_far") < _reach(F.col("qlon"), F.col("qlat"), degrees) - 1.0)).select("_place"))
        found = found.join(sure, "_place", "left_semi")
        done = found if done is None else done.unionByName(found)
        left = stored(left.join(sure, "_place", "left_anti"))
        if left.isEmpty():
            return done
        degrees *= 2


def _windows(queries: DataFrame, degrees: float) -> DataFrame:
    x, y = F.floor(F.col("qlon") / degrees), F.floor(F.col("qlat") / degrees)
    return queries.select("*", F.explode(F.sequence(x - 1, x + 1)).alias("_x"), F.sequence(y - 1, y + 1).alias("_ys")).select("*", F.explode("_ys").alias("_y")).drop("_ys")


def _ranked(near: DataFrame, points: DataFrame, k: int, whole: bool) -> DataFrame:
    each = near.crossJoin(points) if whole else near.join(points, ["_x", "_y"])
    metres = each.select("_place", F.round(haversine(F.col("qlon"), F.col("qlat"), F.col("lon"), F.col("lat")), 6).alias("metres"), "_keys")
    # Each of the k nearest is at one of the k places that are first by metres and their smallest key.
    rank = lambda key: F.row_number().over(Window.partitionBy("_place").orderBy("metres", key))
    at = metres.withColumn("_r", rank(F.get("_keys", 0))).where(F.col("_r") <= k).select("_place", "metres", F.explode("_keys").alias("_key"))
    return at.select("_place", F.col("_key.key").alias("key"), "metres").withColumn("rank", rank(F.col("key"))).where(F.col("rank") <= k)


def _reach(lon: Column, lat: Column, degrees: float) -> Column:
    """Metres within which no point is outside the cell of a place and the eight around it; none across the 180th meridian, which cells don't cross."""
    x, y = F.floor(lon / degrees), F.floor(lat / degrees)
    east = F.least(lon - (x - 1) * degrees, (x + 2) * degrees - lon, F.lit(180.0) - lon, lon + 180.0, F.lit(90.0))
    north = F.least(lat - (y - 1) * degrees, (y + 2) * degrees - lat)
    return RADIUS * F.least(F.radians(north), F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.greatest(east, F.lit(0.0))))))


def z_value(lon: Column, lat: Column, bits: int = 16) -> Column:
    """The interleaved bits of a place on a grid of 2**bits each way."""
    unit = lambda c, low, span: F.floor((c - low) / span * (2**bits - 1)).cast("long")

    def spread(v):
        out = F.lit(0).cast("long")
        for k in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long")), 2 * k))
        return out

    return spread(unit(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(unit(lat, -90.0, 180.0)), 1))


def z_order(df: DataFrame, lon: str = "lon", lat: str = "lat", bits: int = 16) -> DataFrame:
    """Rows range-partitioned and sorted by interleaved bits of their place, so that a box touches few files."""
    return df.withColumn("_z", z_value(F.col(lon), F.col(lat), bits)).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")
