"""Journeys: stretches of events away from home, their stops and the timeless events that belong to them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import geo
from lumenlake.functions.lineage import written
from lumenlake.operators.components import connected_components

#: Fixed defaults: days between events of a journey, km between stops, least score and lead of an attachment.
MAX_GAP_DAYS, STOP_RADIUS_KM, ATTACH_SCORE, ATTACH_MARGIN = 5.0, 150.0, 0.84, 0.08


def journeys_without_unknown(events: DataFrame, max_gap_days: float = MAX_GAP_DAYS) -> DataFrame:
    """Away events with journey_id, for events (library_id, event_id, state, start_epoch) whose state is known.

    A home event between two away events, or a gap above the limit, opens a journey: one window, no Python.
    """
    order = Window.partitionBy("library_id").orderBy("start_epoch", "event_id")
    timed = events.where("start_epoch is not null and state <> 'unknown'")
    gap = F.abs(F.col("start_epoch") - F.lag("start_epoch").over(order)) / 86400.0
    opens = (F.col("state") == "away") & ((F.coalesce(F.lag("state").over(order), F.lit("home")) == "home") | (gap > max_gap_days))
    numbered = timed.withColumn("__opens", opens.cast("int")).withColumn("journey_id", (F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    return numbered.where("state = 'away'").drop("__opens")


def journeys(events: DataFrame, max_gap_days: float = MAX_GAP_DAYS) -> DataFrame:
    """Events with journey_id under all states.

    An event without a centre joins the open journey if the gap is within the limit, and only then counts as the last
    one.  So it joins if the last event of a known state is away and no gap since then is above the limit; and an away
    event goes on with the journey under the same condition.  Windows in one order of time tell both.
    """
    order = Window.partitionBy("library_id").orderBy("start_epoch", "event_id")
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.abs(F.col("start_epoch") - F.lag("start_epoch").over(order)) / 86400.0
    timed = events.where("start_epoch is not null").withColumn("__wide", F.sum(F.coalesce(gap > max_gap_days, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.struct(F.col("state"), F.col("__wide").alias("wide"))
    timed = timed.withColumn("__known", F.last(F.when(F.col("state").isin("home", "away"), known), ignorenulls=True).over(before))
    on = F.coalesce((F.col("__known.state") == "away") & (F.col("__known.wide") == F.col("__wide")), F.lit(False))
    away = F.col("state") == "away"
    marked = timed.withColumn("__joins", away | (on & (F.col("state") != "home"))).withColumn("__opens", (away & ~on).cast("int"))
    numbered = marked.withColumn("journey_id", (F.sum("__opens").over(until) - 1).cast("long"))
    return numbered.where("__joins").drop("__wide", "__known", "__joins", "__opens")


#: What looks and shared persons weigh when an event is attached; events of a library that are attached as one group.
LOOKS, PERSONS, TOGETHER = 0.65, 0.35, 20_000


def attachment_cells(rows: DataFrame, together: int = TOGETHER) -> DataFrame:
    """rows (library_id, event_id, journey_id, person_ids) with cell: what may be attached, and what it may be attached to.

    An event that shares no person with a journey scores LOOKS at most, which is too little to be attached and too little
    to stand in another journey's way.  So only journeys and events in one component of their persons concern each
    other.  Libraries of up to `together` rows are one cell.
    """
    counts = rows.groupBy("library_id").agg(F.count("*").alias("many"))
    sized = rows.join(counts.select("library_id", (F.col("many") > together).alias("large")), "library_id")
    lib = F.col("library_id").cast("string")
    node = F.when(F.col("journey_id").isNotNull(), F.xxhash64(F.lit("j"), lib, "journey_id")).otherwise(F.xxhash64(F.lit("e"), lib, "event_id"))
    if counts.where(F.col("many") > together).isEmpty():
        return sized.drop("large").withColumn("cell", F.lit(0).cast("long"))
    keyed = written(sized.withColumn("node", node))
    edges = keyed.where("large").select(F.col("node").alias("u"), F.explode("person_ids").alias("person"), lib.alias("lib")).select("u", F.xxhash64(F.lit("p"), "lib", F.col("person").cast("long")).alias("v"))
    found = connected_components(edges).select(F.col("id").alias("node"), "component")
    cell = F.when(~F.col("large"), F.lit(0).cast("long")).otherwise(F.coalesce("component", "node"))
    return keyed.join(found, "node", "left").withColumn("cell", cell).drop("large", "node", "component")


def attach_timeless(members: DataFrame, events: DataFrame, score: float = ATTACH_SCORE, margin: float = ATTACH_MARGIN, together: int = TOGETHER) -> DataFrame:
    """(library_id, event_id, journey_id) with the timeless events that resemble one journey clearly.

    events have centroid (unit vector or null), person_ids and start_epoch; candidates are tried by event_id, and a
    later one sees those attached before.  Cell by cell (attachment_cells); only events' vectors and persons are gathered,
    no photos, and timed events outside of journeys take no part.
    """
    rows = events.select("library_id", "event_id", "start_epoch", "centroid", "person_ids").join(members.select("library_id", "event_id", "journey_id"), ["library_id", "event_id"], "left")
    rows = rows.where("journey_id IS NOT NULL OR start_epoch IS NULL")
    # With a lower score or a wider margin, journeys that share no person would count as well.
    rows = attachment_cells(rows, together) if score - margin > LOOKS else rows.withColumn("cell", F.lit(0).cast("long"))
    kind = dict(events.dtypes)["library_id"]

    def attach(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors: dict[int, list[np.ndarray]] = {}
        people: dict[int, set[int]] = {}
        out = []
        rest = []
        for r in pdf.sort_values("event_id").itertuples():
            v = None if r.centroid is None else np.asarray(r.centroid, float)
            p = set() if r.person_ids is None else {int(x) for x in r.person_ids}
            if not pd.isna(r.journey_id):
                j = int(r.journey_id)
                vectors.setdefault(j, [])
                people.setdefault(j, set()).update(p)
                if v is not None:
                    vectors[j].append(v)
                out.append((r.library_id, r.event_id, j))
            elif pd.isna(r.start_epoch):
                rest.append((r.library_id, r.event_id, v, p))
        for lib, event, v, p in rest:
            rated = sorted(((LOOKS * (max((float(v @ m) for m in vectors[j]), default=0.0) if v is not None else 0.0) + PERSONS * (len(p & people[j]) / max(1, len(p)) if p else 0.0), j) for j in vectors), reverse=True)
            if rated and rated[0][0] >= score and rated[0][0] - (rated[1][0] if len(rated) > 1 else 0.0) >= margin:
                j = rated[0][1]
                people[j] |= p
                if v is not None:
                    vectors[j].append(v)
                out.append((lib, event, j))
        return pd.DataFrame(out, columns=["library_id", "event_id", "journey_id"])

    return rows.groupBy("library_id", "cell").applyInPandas(attach, f"library_id {kind}, event_id long, journey_id long")


def stops(members: DataFrame, radius_km: float = STOP_RADIUS_KM) -> DataFrame:
    """Members (library_id, journey_id, event_id, start_epoch, centroid_*, destination) with stop_id.

    An event opens a stop if it is farther than radius_km from the running mean of the stop's centres, unless both
    have the same named destination; events without a centre stay.  Journeys are read event by event in order of time,
    with the sums of one stop as the only state.
    """
    keys = ["library_id", "journey_id"]
    kinds = dict(members.dtypes)
    rows = members.select(*keys, F.col("start_epoch").isNull().alias("late"), F.col("start_epoch").alias("at"), F.col("event_id").cast("long").alias("event_id"),
                          F.col("centroid_latitude").cast("double").alias("lat"), F.col("centroid_longitude").cast("double").alias("lon"), F.col("destination").cast("string").alias("destination"))
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "late", "at", "event_id").select(*keys, "event_id", "lat", "lon", "destination")

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stop, lat, lon, n, name = None, 0, 0.0, 0.0, 0, None
        for part in parts:
            out = []
            for library, journey, la, lo, place in zip(*(part.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
                here = la is not None and lo is not None
                new = here and n > 0 and not (place is not None and place == name) and kilometres(la, lo, lat / n, lon / n) > radius_km
                if now != (library, journey):
                    now, stop, lat, lon, n, name = (library, journey), 0, 0.0, 0.0, 0, None
                elif new:
                    stop, lat, lon, n, name = stop + 1, 0.0, 0.0, 0, None
                if here:
                    lat, lon, n = lat + la, lon + lo, n + 1
                name = place if name is None else name
                out.append(stop)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(out, pa.int64())], ["library_id", "journey_id", "event_id", "stop_id"])

    numbered = ordered.mapInArrow(number, f"library_id {kinds['library_id']}, journey_id {kinds['journey_id']}, event_id long, stop_id long")
    return members.join(numbered, [*keys, "event_id"])


def kilometres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The great-circle distance of two points."""
    p, q, r, s = map(math.radians, (lat1, lon1, lat2, lon2))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(h, 1.0)))


def stop_summary(stopped: DataFrame) -> DataFrame:
    """Name (first known, or by number), span, centre and events of every stop."""
    order = F.struct(F.col("start_epoch").isNull(), "start_epoch", "event_id")
    return stopped.groupBy("library_id", "journey_id", "stop_id").agg(
        F.coalesce(F.min_by(F.col("destination"), F.when(F.col("destination").isNotNull(), order)), F.concat(F.lit("Stop "), F.col("stop_id") + 1)).alias("name"),
        F.min("start_epoch").alias("start_epoch"), F.max("start_epoch").alias("end_epoch"), F.avg("centroid_latitude").alias("centroid_latitude"), F.avg("centroid_longitude").alias("centroid_longitude"),
        F.count("*").alias("event_count"))


def journey_summary(members: DataFrame, photos_per_event: DataFrame) -> DataFrame:
    """Span, confidence, destinations in order of first visit, events of several photos and loose photos of journeys.

    photos_per_event: library_id, event_id, photo_count, first_photo.
    """
    rows = members.join(photos_per_event, ["library_id", "event_id"])
    place = F.struct(F.col("start_epoch").isNull().alias("late"), F.col("start_epoch").alias("at"), F.col("event_id").alias("e"), F.col("destination").alias("d"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("destination").isNotNull(), place)))
    return rows.groupBy("library_id", "journey_id").agg(
        F.min("start_epoch").alias("start_epoch"), F.max("start_epoch").alias("end_epoch"), F.avg((F.col("state") == "away").cast("int")).alias("confidence"),
        F.array_distinct(F.transform(ordered, lambda x: x["d"])).alias("destination_names"),
        F.array_sort(F.collect_list(F.when(F.col("photo_count") > 1, F.col("event_id")))).alias("event_ids"), F.array_sort(F.collect_list(F.when(F.col("photo_count") == 1, F.col("first_photo")))).alias("loose_photo_ids"))
