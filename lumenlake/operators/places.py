"""Places: clusters of coordinates, the home among them, and the nearest destination of an event."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import geo
from lumenlake.functions.lineage import written
from lumenlake.operators import blocks
from lumenlake.operators.search import packed


def _spots(photos: DataFrame) -> DataFrame:
    """The distinct coordinates of each library; photos at one spot need no pairs among themselves."""
    return photos.where(geo.located(F.col("latitude"), F.col("longitude"))).select("library_id", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude")).distinct()


def _within(km: float) -> blocks.Rule:
    return lambda rows, a, b: blocks.kilometres(rows, a, b) <= km


def gps_members(photos: DataFrame, radius_km: float = 40.0) -> DataFrame:
    """Located photos with cluster_id: single linkage at radius_km, numbered by size, then by the first photo."""
    located = photos.where(geo.located(F.col("latitude"), F.col("longitude")))
    node = F.xxhash64(F.col("library_id").cast("string"), F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    # Spots within the radius are within its degrees of latitude, whatever their longitudes.
    found = blocks.linked(_spots(photos).withColumn("node", node), _within(radius_km), at=F.col("latitude"), width=math.degrees(radius_km / geo.EARTH_KM) * 1.0001)
    keyed = located.withColumn("__node", node).join(found.withColumnRenamed("id", "__node"), "__node", "left").withColumn("__group", F.coalesce("component", "__node"))
    sizes = keyed.groupBy("library_id", "__group").agg(F.count("*").alias("__n"), F.min("ord").alias("__head"))
    sizes = sizes.withColumn("cluster_id", (F.row_number().over(Window.partitionBy("library_id").orderBy(F.desc("__n"), "__head")) - 1).cast("long"))
    return keyed.join(sizes, ["library_id", "__group"]).drop("__node", "__group", "component", "__n", "__head")


def gps_clusters(photos: DataFrame, radius_km: float = 40.0, gazetteer: DataFrame | None = None) -> DataFrame:
    """Centre, size, active days and months, span, radius and name of every cluster.

    A gazetteer (name, admin1, cc, latitude, longitude) names each centre by its nearest entry; it must be a table of
    places, not of photos, and is broadcast only if Spark finds it below its own size limit.
    """
    members = gps_members(photos, radius_km)
    centres = members.groupBy("library_id", "cluster_id").agg(
        F.avg("latitude").alias("center_latitude"), F.avg("longitude").alias("center_longitude"), F.count("*").alias("photo_count"),
        F.count_distinct(F.to_date("captured_wall")).alias("active_days"), F.count_distinct(F.date_format("captured_wall", "yyyy-MM")).alias("active_months"),
        F.min("captured_wall").alias("start"), F.max("captured_wall").alias("end"))
    away = geo.haversine_km(F.col("center_latitude"), F.col("center_longitude"), F.col("latitude"), F.col("longitude"))
    spread = (members.join(centres.select("library_id", "cluster_id", "center_latitude", "center_longitude"), ["library_id", "cluster_id"])
              .groupBy("library_id", "cluster_id").agg(F.percentile(away, F.lit(0.9)).alias("__p90")))
    out = centres.join(spread, ["library_id", "cluster_id"]).withColumn("radius_km", F.greatest(F.lit(20.0), F.least(F.lit(150.0), F.col("__p90") + 15.0))).drop("__p90")
    fallback = F.format_string("GPS %.3f,%.3f", "center_latitude", "center_longitude")
    if gazetteer is None:
        return out.withColumn("name", fallback).withColumn("name_source", F.lit("gps_centroid"))
    places = gazetteer.select(F.col("name").alias("g_name"), F.coalesce("admin1", "cc").alias("g_suffix"), F.col("latitude").alias("g_lat"), F.col("longitude").alias("g_lon"))
    near = nearest(out, places, ["library_id", "cluster_id"], ("center_latitude", "center_longitude"), ("g_lat", "g_lon"), ["g_name", "g_suffix"])
    named = F.when(F.col("g_suffix").isNotNull() & (F.col("g_suffix") != F.col("g_name")), F.concat("g_name", F.lit(", "), "g_suffix")).otherwise(F.col("g_name"))
    joined = out.join(near, ["library_id", "cluster_id"], "left")
    return (joined.withColumn("name", F.coalesce(named, fallback)).withColumn("name_source", F.when(F.col("g_name").isNotNull(), "offline_reverse_geocoder").otherwise("gps_centroid"))
            .drop("g_name", "g_suffix", "distance_km"))


#: Degrees within which the nearest place is sought first, then, and at last; whole shares of the globe.
REACH = (1, 8, 60, 180)
#: Points or places of a tile, and points whose distances are computed at once.
TILE, AT_ONCE = 4096, 256
#: Tasks that points are dealt over where they seek among all places.
SHARES = 64


def _cell(lat: Column, lon: Column, reach: int) -> Column:
    """Number of the cell of a point: steps of `reach` degrees of both coordinates."""
    return (F.floor(lat / reach) * 1000 + F.pmod(F.floor(lon / reach), F.lit(360 // reach))).cast("long")


def _cells_near(lat: Column, lon: Column, reach: int) -> Column:
    """Numbers of the cells in which points within `reach` degrees of a place may lie."""
    around = 360 // reach
    bands = F.sequence(F.floor((lat - reach) / reach), F.floor((lat + reach) / reach))
    # So far apart in longitude can two places be, one of which is at this latitude; round a pole, at any.
    wide = F.when(F.abs(lat) + reach < 90, F.degrees(F.asin(F.sin(F.radians(F.lit(float(reach)))) / F.cos(F.radians(lat)))) + 1e-6).otherwise(360.0)
    first, last = F.floor((lon - wide) / reach), F.floor((lon + wide) / reach)
    slots = F.when(last - first + 1 >= around, F.sequence(F.lit(0).cast("long"), F.lit(around - 1).cast("long"))).otherwise(F.transform(F.sequence(first, last), lambda s: F.pmod(s, F.lit(around))))
    return F.flatten(F.transform(bands, lambda b: F.transform(slots, lambda s: (b * 1000 + s).cast("long"))))


def _kilometres(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of all pairs of two lists of places in radians."""
    h = np.sin((t[None, :, 0] - p[:, None, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(t[None, :, 0]) * np.sin((t[None, :, 1] - p[:, None, 1]) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def nearest(points: DataFrame, places: DataFrame, keys: list[str], at: tuple[str, str], of: tuple[str, str], carry: list[str]) -> DataFrame:
    """keys, carry and distance_km of the place nearest to each point; the first listed wins a tie.

    A point is in one cell of the globe, a place in all those from which it may be the nearest; tiles of both meet and hand
    on one row for each point, so no row for a pair is made.  Points whose nearest place so found is farther away than all
    that was looked at seek on in wider cells.  Of places at one spot the first stands for all.
    """
    lat, lon = (F.col(c).cast("double") for c in of)
    listed = places.select(*carry, lat.alias("__lat"), lon.alias("__lon")).where("__lat is not null and __lon is not null").withColumn("__i", F.monotonically_increasing_id())
    listed = written(listed.groupBy("__lat", "__lon").agg(F.min(F.struct("__i", *carry)).alias("__first")).select("__lat", "__lon", "__first.*"))
    left = points.where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()).select(*keys, F.col(at[0]).cast("double").alias("__a"), F.col(at[1]).cast("double").alias("__o"))
    point_kinds, place_kinds = {k: dict(left.dtypes)[k] for k in [*keys, "__a", "__o"]}, {k: dict(listed.dtypes)[k] for k in ["__i", *carry]}
    k, c = len(point_kinds), len(place_kinds)
    names = [*point_kinds, *place_kinds, "distance_km"]

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for n in range(part.num_rows):
                row = [part.column(i)[n].values for i in range(k + c + 2)]
                p, t = (np.radians(row[i].to_numpy(zero_copy_only=False).reshape(-1, 2)) for i in (k, k + c + 1))
                listing = np.argsort(row[k + 1].to_numpy(zero_copy_only=False), kind="stable")
                km = [_kilometres(p[i : i + AT_ONCE], t[listing]) for i in range(0, len(p), AT_ONCE)]
                best = pa.array(listing[np.concatenate([x.argmin(1) for x in km])])
                yield pa.RecordBatch.from_arrays([*row[:k], *(x.take(best) for x in row[k + 1 : k + 1 + c]), pa.array(np.concatenate([x.min(1) for x in km]))], names)

    def tiles(rows: DataFrame, kinds: dict[str, str], spot: tuple[str, str], values: str) -> DataFrame:
        dealt = rows.withColumn("embedding", F.array(*spot)).repartition("__cell").sortWithinPartitions("__cell")
        return packed(dealt, kinds, TILE, "__cell").drop("sizes").withColumnRenamed("values", values)

    out = None
    for reach in REACH:
        last = reach == REACH[-1]
        asked = left.withColumn("__cell", F.lit(0).cast("long") if last else _cell(F.col("__a"), F.col("__o"), reach))
        near = listed.withColumn("__cell", F.lit(0).cast("long") if last else F.explode(_cells_near(F.col("__lat"), F.col("__lon"), reach)))
        if last:  # a single cell would be a single task
            asked, near = asked.withColumn("__cell", F.pmod(F.xxhash64(*keys), F.lit(SHARES))), near.withColumn("__cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
        met = tiles(asked, point_kinds, ("__a", "__o"), "__spot").join(tiles(near, place_kinds, ("__lat", "__lon"), "__town").hint("merge"), "__cell").select(*point_kinds, "__spot", *place_kinds, "__town")
        found = met.mapInArrow(meet, ", ".join([*(f"`{n}` {t}" for n, t in (point_kinds | place_kinds).items()), "distance_km double"]))
        best = written(found.groupBy(*keys, "__a", "__o").agg(F.min(F.struct("distance_km", "__i", *carry)).alias("__best")))
        sure = best if last else best.where((F.col("__best.distance_km") <= math.radians(reach) * geo.EARTH_KM) & (F.abs("__a") <= 90))
        named = sure.select(*keys, *(F.col(f"__best.{x}").alias(x) for x in carry), "__best.distance_km")
        out = named if out is None else out.unionByName(named)
        left = left.join(sure.select(*keys), keys, "left_anti")
        if left.isEmpty():
            break
    return out


def journey_places(clusters: DataFrame, minimum_photos: int = 2) -> DataFrame:
    """The home (most months, days, photos; then the first) and the destinations of each library, with their radii."""
    order = Window.partitionBy("library_id").orderBy(F.desc("active_months"), F.desc("active_days"), F.desc("photo_count"), "cluster_id")
    ranked = clusters.withColumn("is_home", F.row_number().over(order) == 1)
    return ranked.where(F.col("is_home") | (F.col("photo_count") >= minimum_photos)).select(
        "library_id", "cluster_id", "name", "is_home", F.col("center_latitude").alias("latitude"), F.col("center_longitude").alias("longitude"),
        F.when(F.col("is_home"), F.greatest(F.lit(40.0), F.least(F.lit(100.0), F.col("radius_km") + 20.0))).otherwise(F.col("radius_km")).alias("radius_km"))


def event_places(events: DataFrame, places: DataFrame) -> DataFrame:
    """events (library_id, event_id, centroid_latitude, centroid_longitude, ...) with state and destination.

    state: home within the home's radius, away beyond, unknown without a centre.  destination: the nearest one, if the
    centre lies within its radius.  Places meet events on library_id and are folded to the nearest per event.
    """
    home = places.where("is_home").select("library_id", F.col("latitude").alias("h_lat"), F.col("longitude").alias("h_lon"), F.col("radius_km").alias("h_radius"))
    others = places.where("not is_home").groupBy("library_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "name", "latitude", "longitude", "radius_km"))).alias("__d"))
    here = (F.col("centroid_latitude"), F.col("centroid_longitude"))
    joined = events.join(home, "library_id", "left").join(others, "library_id", "left")
    km = geo.haversine_km(*here, F.col("h_lat"), F.col("h_lon"))
    best = F.array_min(F.transform("__d", lambda p: F.struct(geo.haversine_km(*here, p["latitude"], p["longitude"]).alias("km"), p["cluster_id"].alias("cluster_id"), p["name"].alias("name"), p["radius_km"].alias("radius_km"))))
    known = geo.located(*here)
    return (joined.withColumn("state", F.when(~known | km.isNull(), "unknown").when(km <= F.col("h_radius"), "home").otherwise("away"))
            .withColumn("__best", F.when(known, best)).withColumn("destination", F.when(F.col("__best.km") <= F.col("__best.radius_km"), F.col("__best.name")))
            .drop("h_lat", "h_lon", "h_radius", "__d", "__best"))
