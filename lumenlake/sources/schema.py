"""Schemas of the tables, as DDL, and the columns derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions import times

QUALITY = "struct<sharpness: double, sharpness_score: double, exposure_score: double, face_quality_score: double, composition_score: double, score: double>"

PHOTOS = (
    "library_id string, ord bigint, id string, path string, width int, height int, captured_at string, captured_at_source string, latitude double, longitude double, "
    f"gps_source string, camera string, embedding array<float>, phash string, quality {QUALITY}, source string, source_updated_at string, original_filename string")
FACES = ("library_id string, ord bigint, id string, photo_id string, bbox array<double>, embedding array<float>, det_score double, appearance_embedding array<float>")
PERSONS = ("library_id string, id int, face_ids array<string>, photo_ids array<string>, prototype array<double>, removed_photo_ids array<string>, name string")
LABELS = ("photo_id string, event_id string, event_family_id string, journey_id string, journey_parent_id string, journey_stop_id string, label_confidence string")
CASES = ("query string, relevant_ids array<string>")
PROJECTS = ("id string, name string, created_at string, updated_at string, photo_count int, analyzed_count int, status string, encoder string, embedding_dimension int")
ANNOTATIONS = ("library_id string, kind string, item_id string, name string, note string, name_source string")
ASSETS = (
    "id string, updatedAt string, fileCreatedAt string, localDateTime string, originalFileName string, width int, height int, "
    "exifInfo struct<latitude: string, longitude: string, make: string, model: string, exifImageWidth: int, exifImageHeight: int>")


def parsed(ddl: str) -> T.StructType:
    """The schema as a type; parsing needs a session."""
    return T.StructType.fromDDL(ddl)


def with_times(photos: DataFrame) -> DataFrame:
    """photos with captured_wall and captured_epoch."""
    at = F.col("captured_at").cast("string")
    return photos.withColumn("captured_wall", times.wall_clock(at)).withColumn("captured_epoch", times.epoch_seconds(at))


def with_phash_words(photos: DataFrame) -> DataFrame:
    """photos with the 64-character hash as two numbers of 32 bits."""
    half = lambda at: F.when(F.length("phash") == 64, F.conv(F.substring("phash", at, 32), 2, 10).cast("long"))
    return photos.withColumn("phash_hi", half(1)).withColumn("phash_lo", half(33))
