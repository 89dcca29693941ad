"""Events: stretches and groups of photos that belong together.

Inputs have library_id, id, ord, captured_epoch, captured_at_source, latitude, longitude and embedding; every library
is clustered by itself and its events are numbered from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import geo, times, vector
from lumenlake.functions.lineage import written
from lumenlake.operators import blocks

STRATEGIES = ("time_only", "time_clip", "time_clip_gps", "strict_event", "strict_event_people")


@dataclass(frozen=True)
class EventConfig:
    """Fixed defaults of event discovery."""

    time_weight: float = 0.55
    visual_weight: float = 0.30
    geo_weight: float = 0.15
    max_gap_hours: float = 8.0
    threshold: float = 0.48
    in_batch_similarity: float = 0.86
    high_similarity: float = 0.92
    batch_seconds: float = 900.0
    geo_scale_km: float = 50.0


DEFAULTS = EventConfig()


def time_component(a: Column, b: Column, config: EventConfig) -> Column:
    """The gap as a share of the longest one, at most 1; a missing time counts as 1."""
    hours = F.abs(b - a) / 3600.0
    return F.coalesce(F.least(hours / max(config.max_gap_hours, 1e-6), F.lit(1.0)), F.lit(1.0))


def event_distance(a: dict[str, Column], b: dict[str, Column], strategy: str, config: EventConfig) -> Column:
    """The distance of two photos, given as their epoch, embedding, latitude and longitude."""
    gap = time_component(a["epoch"], b["epoch"], config)
    if strategy == "time_only":
        return gap
    out = config.time_weight * gap + config.visual_weight * vector.visual_distance(a["embedding"], b["embedding"])
    if strategy == "time_clip_gps":
        km = geo.haversine_km(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
        out += config.geo_weight * F.least(F.coalesce(km, F.lit(0.0)) / config.geo_scale_km, F.lit(1.0))
    return out


def _fields(prefix: str = "") -> dict[str, Column]:
    return {"epoch": F.col(f"{prefix}captured_epoch"), "embedding": F.col(f"{prefix}embedding"), "latitude": F.col(f"{prefix}latitude"), "longitude": F.col(f"{prefix}longitude")}


def _order() -> tuple[Column, Column]:
    return F.col("captured_epoch").asc_nulls_last(), F.col("ord").asc()


def sequential_events(photos: DataFrame, strategy: str = "time_clip_gps", config: EventConfig = DEFAULTS, segments: int | None = None) -> DataFrame:
    """photos with event_id and pos (place in the event): a photo opens an event if it is too far from the one before.

    One window over each library in time order, photos without a time last: no join, no Python.  Where a library is too
    long for one task, `segments` deals the timeline out instead: see _segmented.
    """
    if segments is not None:
        numbered = _segmented(photos, strategy, config, segments)
    else:
        order = Window.partitionBy("library_id").orderBy(*_order())
        before = {k: F.lag(c).over(order) for k, c in _fields().items()}
        first = F.row_number().over(order) == 1
        marked = photos.withColumn("__split", F.when(first, 0).otherwise((event_distance(before, _fields(), strategy, config) > config.threshold).cast("int")))
        numbered = marked.withColumn("event_id", F.sum("__split").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    inside = Window.partitionBy("library_id", "event_id").orderBy(*_order())
    return numbered.withColumn("pos", (F.row_number().over(inside) - 1).cast("long")).drop("__split")


def sequential_ids(photos: DataFrame, strategies: tuple[str, ...] = STRATEGIES[:3], config: EventConfig = DEFAULTS) -> DataFrame:
    """(library_id, id) with a column for each sequential strategy: the event_id of sequential_events.

    All are told in one pass, so that vectors are dealt out and sorted once.
    """
    order = Window.partitionBy("library_id").orderBy(*_order())
    prior = F.lag(F.struct(*(c.alias(k) for k, c in _fields().items()))).over(order)
    met = photos.select("library_id", "id", "ord", *_fields().values(), prior.alias("__prior"))
    before = {k: F.col("__prior")[k] for k in _fields()}
    split = lambda s: F.when(F.col("__prior").isNull(), 0).otherwise((event_distance(before, _fields(), s, config) > config.threshold).cast("int"))
    marked = met.select("library_id", "id", "captured_epoch", "ord", *(split(s).alias(s) for s in strategies))
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("library_id", "id", *(F.sum(s).over(until).cast("long").alias(s) for s in strategies))


def sequential_centroids(photos: DataFrame, strategy: str = "time_clip_gps", config: EventConfig = DEFAULTS) -> DataFrame:
    """(library_id, event_id, centroid): the direction of the mean vector of every event of sequential_events.

    The window that finds the events has each library in one task, so vectors are added up where they are.
    """
    return vector.mean_vectors(sequential_events(photos, strategy, config), ["library_id", "event_id"], "embedding", together=True)


def _segmented(photos: DataFrame, strategy: str, config: EventConfig, segments: int) -> DataFrame:
    """photos with __split and event_id, by a scan in two steps over ranges of the timeline.

    Ranges of (library, time) are dealt over tasks and written, since where they are cut depends on a sample.  A range is
    marked and counted by itself, but for its first photo of a library.  Its summary is that library's last photo and its
    number of splits; the summaries (one for each library and range) are scanned by a window, which tells every range the
    photo before it and the number of events before it.
    """
    rows = written(photos.repartitionByRange(segments, "library_id", *_order()).withColumn("__segment", F.spark_partition_id()))
    part = Window.partitionBy("library_id", "__segment").orderBy(*_order())
    scan = Window.partitionBy("library_id").orderBy("__segment")
    fields = F.struct(*(c.alias(k) for k, c in _fields().items()))
    key = F.struct(F.col("captured_epoch").isNull().alias("n"), "captured_epoch", "ord")
    last = rows.groupBy("library_id", "__segment").agg(F.max_by(fields, key).alias("last")).withColumn("__before", F.lag("last").over(scan)).select("library_id", "__segment", "__before")
    known = rows.join(last, ["library_id", "__segment"])
    inner = F.lag(fields).over(part)
    met = known.withColumn("__prior", F.when(F.row_number().over(part) == 1, F.col("__before")).otherwise(inner))
    before = {k: F.col("__prior")[k] for k in _fields()}
    marked = met.withColumn("__split", F.when(F.col("__prior").isNull(), 0).otherwise((event_distance(before, _fields(), strategy, config) > config.threshold).cast("int"))).drop("__prior", "__before")
    marked = written(marked)
    counts = marked.groupBy("library_id", "__segment").agg(F.sum("__split").alias("n"))
    offsets = counts.withColumn("__offset", F.sum("n").over(scan.rowsBetween(Window.unboundedPreceding, -1))).select("library_id", "__segment", F.coalesce("__offset", F.lit(0)).alias("__offset"))
    local = F.sum("__split").over(part.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__local", local).join(offsets, ["library_id", "__segment"]).withColumn("event_id", (F.col("__local") + F.col("__offset")).cast("long")).drop("__local", "__offset", "__segment")


def event_summary(members: DataFrame) -> DataFrame:
    """Size, first and last capture and mean place of every event of sequential_events."""
    return members.groupBy("library_id", "event_id").agg(
        F.count("*").alias("photo_count"), F.min_by("captured_wall", "pos").alias("start"), F.max_by("captured_wall", "pos").alias("end"),
        F.avg("latitude").alias("centroid_latitude"), F.avg("longitude").alias("centroid_longitude"))


_SIDE = ("library_id", "id", "ord", "captured_epoch", "captured_at_source", "latitude", "longitude", "embedding")


def _rows(photos: DataFrame) -> DataFrame:
    """What the strict rule needs of photos."""
    known = times.trusted(F.col("captured_at_source"), F.col("captured_epoch"))
    return photos.select(*_SIDE).withColumn("embedding", vector.as_double(F.col("embedding"))).select(
        "library_id", blocks.node().alias("node"), "id", F.col("ord").cast("long").alias("ord"), "captured_epoch", "latitude", "longitude", "embedding",
        known.alias("trusted"), (F.coalesce(F.col("captured_at_source") == "filesystem", F.lit(False))).alias("from_file"))


def strict_rule(config: EventConfig = DEFAULTS) -> blocks.Rule:
    """Two photos with trusted times are near in time, look and place together; a pair with an untrusted one looks much
    alike, the less so if both came in one batch of files."""
    def rule(rows: blocks.Rows, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        seconds, alike = blocks.apart(rows, a, b, "captured_epoch"), blocks.cosine(rows, a, b)
        gap = np.nan_to_num(np.minimum(seconds / 3600.0 / max(config.max_gap_hours, 1e-6), 1.0), nan=1.0)
        far = np.nan_to_num(blocks.kilometres(rows, a, b)) / config.geo_scale_km
        distance = config.time_weight * gap + config.visual_weight * np.nan_to_num(1 - alike) + config.geo_weight * np.minimum(far, 1.0)
        known, file = rows["trusted"], rows["from_file"]
        both = known[a][:, None] & known[b][None, :]
        batch = file[a][:, None] & file[b][None, :] & (seconds <= config.batch_seconds)
        return np.where(both, (gap < 1.0) & (distance <= config.threshold), alike >= np.where(batch, config.in_batch_similarity, config.high_similarity))

    return rule


def _placement(config: EventConfig) -> dict:
    """Trusted photos meet within the longest gap, the others all that may look alike enough."""
    return {"alike": ("embedding", min(config.in_batch_similarity, config.high_similarity)), "loose": ~F.col("trusted"), "at": F.col("captured_epoch"), "width": max(config.max_gap_hours, 1e-6) * 3600}


def strict_pairs(photos: DataFrame, config: EventConfig = DEFAULTS) -> DataFrame:
    """(library_id, left_id, left_ord, right_id, right_ord): pairs that the strict rule puts into one event."""
    return blocks.pairs(_rows(photos), strict_rule(config), **_placement(config))


def group_by_components(rows: DataFrame, found: DataFrame, into: str) -> DataFrame:
    """rows (library_id, id, ord, ...) with the number of their component (id, component), by smallest ord."""
    keyed = rows.withColumn("__node", blocks.node()).join(found.withColumnRenamed("id", "__node"), "__node", "left")
    keyed = keyed.withColumn("__group", F.coalesce("component", "__node"))
    heads = keyed.groupBy("library_id", "__group").agg(F.min("ord").alias("__head"))
    heads = heads.withColumn(into, (F.row_number().over(Window.partitionBy("library_id").orderBy("__head")) - 1).cast("long"))
    return keyed.join(heads, ["library_id", "__group"]).drop("__node", "__group", "component", "__head")


def strict_events(photos: DataFrame, config: EventConfig = DEFAULTS) -> DataFrame:
    """photos with event_id: components of the strict pairs, numbered by their first photo."""
    return group_by_components(photos, blocks.linked(_rows(photos), strict_rule(config), **_placement(config)), "event_id")


def strict_summary(members: DataFrame) -> DataFrame:
    """Size, trusted span, mean place and evidence of every event of strict_events."""
    known = times.trusted(F.col("captured_at_source"), F.col("captured_epoch"))
    return members.groupBy("library_id", "event_id").agg(
        F.count("*").alias("photo_count"), F.min(F.when(known, F.col("captured_wall"))).alias("start"), F.max(F.when(known, F.col("captured_wall"))).alias("end"),
        F.avg("latitude").alias("centroid_latitude"), F.avg("longitude").alias("centroid_longitude"),
        ((F.max(F.when(known, F.col("captured_epoch"))) - F.min(F.when(known, F.col("captured_epoch")))) / 60).alias("duration_minutes"),
        F.when(F.bool_or(~known), "strict_clip_fallback").otherwise("strict_exif_time_clip_gps").alias("evidence"))


def find_events(photos: DataFrame, strategy: str = "time_clip_gps", config: EventConfig = DEFAULTS, segments: int | None = None, **people: DataFrame) -> DataFrame:
    """Members of events under any strategy; strict_event_people takes faces, person_faces and person_photos, and the
    sequential ones how many segments a long timeline is dealt into."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown event strategy: {strategy}")
    if strategy == "strict_event":
        return strict_events(photos, config)
    if strategy == "strict_event_people":
        from lumenlake.operators.event_people import merge_by_people

        return merge_by_people(photos, config=config, **people)
    return sequential_events(photos, strategy, config, segments)
