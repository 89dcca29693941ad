"""One object per photo library: the operations of a service, each a DataFrame or a plain value."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import imaging, text, vector
from lumenlake.operators import density, event_people, events, journeys, metrics, narrative, people, places, search, similar, sync
from lumenlake.operators.events import STRATEGIES
from lumenlake.plans.search_plan import Box, plan_search
from lumenlake.sources import files, images


#: Photos beyond which a timeline is dealt over tasks.
LONG = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Where things are; defaults come from the environment."""

    index: str = field(default_factory=lambda: os.environ.get("LUMENLAKE_INDEX", "photos.parquet"))
    encoder: str = field(default_factory=lambda: os.environ.get("LUMENLAKE_ENCODER", "hash"))


def _held(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")


def _checked_box(south: float, west: float, north: float, east: float) -> None:
    for name, value, most in (("latitude", south, 90), ("latitude", north, 90), ("longitude", west, 180), ("longitude", east, 180)):
        _held(name, value, -most, most)
    if south > north or west > east:
        raise ValueError("bbox is south, west, north, east")


@dataclass(frozen=True)
class Library:
    """Photos of one or more libraries, with the tables of persons if there are any."""

    photos: DataFrame
    people: dict[str, DataFrame] | None = None
    faces: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    @classmethod
    def open(cls, spark: SparkSession, settings: Settings | None = None) -> "Library":
        settings = settings or Settings()
        return cls(files.read_photos(spark, settings.index), settings=settings)

    def save(self, path: str) -> None:
        files.write_photos(self.photos, path)

    @staticmethod
    def index(spark: SparkSession, directory: str, library_id: str, path: str, existing: DataFrame | None = None) -> "Library":
        """Indexes a directory, replaces the stored index and opens it."""
        files.write_photos(images.index_directory(spark, directory, library_id, existing), path)
        return Library(files.read_photos(spark, path))

    def health(self) -> DataFrame:
        return search.health(self.photos)

    def search(self, query: str, top_k: int = 20, strategy: str = "query_enhancement", min_score: float | None = None, start: datetime | date | str | None = None, end: datetime | date | str | None = None,
               bbox: list[float] | None = None, today: date | str | None = None, fallback: bool = True, encode=None) -> tuple[DataFrame, DataFrame]:
        """(decorated results, counts) of a text query; bbox is south, west, north, east."""
        _held("top_k", top_k, 1, 200)
        if strategy not in text.QUERY_STRATEGIES:
            raise ValueError(f"unknown query strategy: {strategy}")
        if bbox is not None and len(bbox) != 4:
            raise ValueError("bbox needs four numbers")
        if bbox is not None:
            _checked_box(*bbox)
        encode = encode or imaging.create_encoder(self.settings.encoder).encode_text
        plan = plan_search(query, start, end, Box(*bbox) if bbox else None, today)
        one = self.photos.sparkSession.range(1).select(text.query_texts(F.lit(plan.semantic), strategy).alias("t")).first()
        found, counts = search.search_details(self.photos, plan, text.encode_query(list(one.t), encode), top_k, min_score, fallback)
        return search.decorated(found), counts

    def events(self, strategy: str = "time_clip_gps", config: events.EventConfig = events.DEFAULTS) -> DataFrame:
        tables = {}
        if strategy == "strict_event_people" and self.people is not None:
            tables = {"faces": self.faces, "person_faces": self.people["person_faces"], "person_photos": self.people["person_photos"]}
        many = self.photos.count()  # of a Parquet table, from its footers
        segments = None if many <= LONG else max(8, many // (LONG // 2))
        return events.find_events(self.photos, strategy, config, segments, **tables)

    def similar_groups(self, **gate) -> DataFrame:
        return similar.similar_groups(self._scored(), **gate)

    def best_shots(self, limit: int = 20) -> DataFrame:
        return similar.best_shots(self._scored(), limit)

    def quality(self, photo_id: str) -> DataFrame:
        return search.lookup(self.photos, photo_id).select("id", "quality")

    def places(self, radius_km: float = 40.0, minimum_photos: int = 2, gazetteer: DataFrame | None = None) -> DataFrame:
        """Home and destinations of each library; a library without coordinates has none."""
        if radius_km <= 0 or minimum_photos < 1:
            raise ValueError("radius_km must be above 0 and minimum_photos at least 1")
        return places.journey_places(places.gps_clusters(self.photos, radius_km, gazetteer), minimum_photos)

    def journeys(self, found_places: DataFrame | None = None, max_gap_days: float = journeys.MAX_GAP_DAYS, stop_radius_km: float = journeys.STOP_RADIUS_KM) -> dict[str, DataFrame]:
        """Members, stops and summaries of journeys, over strict events that shared people have merged."""
        members = self.events("strict_event_people")
        known = (F.col("captured_at_source") == "exif") & F.col("captured_epoch").isNotNull()
        summary = members.groupBy("library_id", "event_id").agg(
            F.min(F.when(known, F.col("captured_epoch"))).alias("start_epoch"), F.avg("latitude").alias("centroid_latitude"), F.avg("longitude").alias("centroid_longitude"), F.count("*").alias("photo_count"), F.min_by("id", "ord").alias("first_photo"))
        placed = places.event_places(summary, self.places() if found_places is None else found_places)
        full = placed.join(vector.mean_vectors(members, ["library_id", "event_id"], "embedding"), ["library_id", "event_id"], "left")
        if self.people is not None:
            full = full.join(event_people.event_people(members, self.people["person_photos"]), ["library_id", "event_id"], "left")
        else:
            full = full.withColumn("person_ids", F.lit(None).cast("array<long>"))
        attached = journeys.attach_timeless(journeys.journeys(placed, max_gap_days), full)
        rows = placed.join(attached, ["library_id", "event_id"])
        stopped = journeys.stops(rows, stop_radius_km)
        shots = placed.select("library_id", "event_id", "photo_count", "first_photo")
        return {"events": stopped, "stops": journeys.stop_summary(stopped), "journeys": journeys.journey_summary(rows.drop("photo_count", "first_photo"), shots)}

    def event_texts(self, members: DataFrame, names: DataFrame | None = None, tags: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
        """Names and summaries of events, from templates."""
        summary = events.strict_summary(members).withColumn("place", F.lit(None).cast("string"))
        found = event_people.event_people(members, self.people["person_photos"]) if self.people is not None else None
        return narrative.event_texts(narrative.event_facts(summary, found, names, tags, objects))

    def journey_texts(self, found: dict[str, DataFrame], events_told: DataFrame, names: DataFrame | None = None) -> DataFrame:
        """Names and notes of journeys, from templates; found is what journeys() gives, events_told what event_texts() does."""
        start = F.date_format(F.timestamp_seconds("start_epoch"), "yyyy-MM-dd'T'HH:mm:ss")
        who = event_people.event_people(self.events("strict_event_people"), self.people["person_photos"]) if self.people is not None else None
        members = found["events"].select("library_id", "journey_id", "event_id", start.alias("start"), "destination", "photo_count")
        return narrative.journey_texts(narrative.journey_facts(members, events_told, who, names))

    def evaluate_events(self, expected: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
        """How each strategy's events agree with labels (library_id, id, label)."""
        return metrics.evaluate_event_strategies(self.photos, expected, self.events, strategies)

    def evaluate_journeys(self, found: dict[str, DataFrame], parents: DataFrame, stops: DataFrame) -> DataFrame:
        """How journeys and their stops agree with labels (library_id, id, label); found is what journeys() gives."""
        return metrics.evaluate_journey_hierarchy(self.photos, self.events("strict_event_people"), found["events"].select("library_id", "event_id", "journey_id", "stop_id"), parents, stops)

    def evaluate_queries(self, cases: DataFrame, encode: Callable[[DataFrame], DataFrame] = text.hash_encode) -> DataFrame:
        """Recall of the query strategies on cases (query, relevant_ids)."""
        return metrics.evaluate_query_strategies(cases, self.photos.select(F.col("id").cast("string").alias("id"), "ord", "embedding"), encode, text.QUERY_STRATEGIES)

    def cluster_people(self, faces: DataFrame, eps: float = 0.35, min_samples: int = 2) -> "Library":
        if eps <= 0 or min_samples < 2:
            raise ValueError("eps must be above 0 and min_samples at least 2")
        return replace(self, people=density.cluster_people(faces, eps, min_samples), faces=faces)

    def correct_people(self, library_id, merges: list[list[int]] = (), removals: list[tuple[int, str]] = ()) -> "Library":
        return replace(self, people=people.apply_feedback(self.people, self.faces, library_id, merges, removals))

    def name_person(self, library_id, person_id: int, name: str | None) -> "Library":
        return replace(self, people=self.people | {"persons": people.set_name(self.people["persons"], library_id, person_id, name)})

    def synchronize(self, remote: DataFrame, fetched: DataFrame, force: bool = False, prune: bool = False) -> tuple["Library", DataFrame]:
        """(the library afterwards, counts) of a synchronization with remote assets, of which fetched are new rows."""
        plan = sync.plan_sync(self.photos, remote, force, prune)
        return replace(self, photos=sync.merge_sync(self.photos, fetched, plan)), sync.sync_counts(plan)

    def _scored(self) -> DataFrame:
        from lumenlake.sources.schema import with_phash_words

        p = self.photos if "score" in self.photos.columns else self.photos.withColumn("score", F.col("quality.score"))
        return p if "phash_hi" in p.columns else with_phash_words(p)
