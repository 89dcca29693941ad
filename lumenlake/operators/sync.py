"""Incremental synchronization with a remote photo manager."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import vector

#: Fixed value: the source of synchronized photos.
REMOTE = "immich"


def record_from_asset(assets: DataFrame, cache_dir: str = "") -> DataFrame:
    """Remote assets as photos without vector, hash or quality; sizes and coordinates fall back or become null."""
    exif = F.col("exifInfo")
    camera = F.concat_ws(" ", *(F.nullif(F.trim(exif[c]), F.lit("")) for c in ("make", "model")))
    size = lambda c, e: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.nullif(exif[e], F.lit(0)), F.lit(0))
    blank_as_null = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.when(F.col("id").rlike("^[A-Za-z0-9_-]+$"), F.col("id")).otherwise(F.url_encode("id"))
    return assets.where("id is not null").select(
        "id", F.concat(F.lit(cache_dir.rstrip("/") + "/"), name, F.lit(".jpg")).alias("path"), size("width", "exifImageWidth").alias("width"), size("height", "exifImageHeight").alias("height"),
        F.coalesce(blank_as_null("fileCreatedAt"), blank_as_null("localDateTime")).alias("captured_at"), F.lit(REMOTE).alias("captured_at_source"),
        exif["latitude"].try_cast("double").alias("latitude"), exif["longitude"].try_cast("double").alias("longitude"), F.when(exif["latitude"].isNotNull(), REMOTE).alias("gps_source"),
        F.nullif(camera, F.lit("")).alias("camera"), F.lit(REMOTE).alias("source"), F.col("updatedAt").alias("source_updated_at"), F.col("originalFileName").alias("original_filename"))


def plan_sync(existing: DataFrame, remote: DataFrame, force: bool = False, prune: bool = False) -> DataFrame:
    """(id, action) of all photos and assets, by one full outer join.

    existing: id, source, source_updated_at, embedding; remote: id, updated_at, cached, failed (whether fetching it
    failed).  Actions: reuse, index, failed (keeps a previous row), drop (failed without one), local, stale, prune.
    """
    e = existing.select("id", "source", "source_updated_at", vector.present(F.col("embedding")).alias("has_vector"), F.lit(True).alias("is_known"))
    r = remote.select("id", "updated_at", "cached", "failed", F.lit(True).alias("is_remote"))
    same = (F.col("source") == REMOTE) & F.col("source_updated_at").eqNullSafe(F.col("updated_at")) & F.col("has_vector") & F.col("cached") & F.lit(not force)
    action = (F.when(F.col("is_remote") & F.col("is_known") & same, "reuse").when(F.col("is_remote") & ~F.coalesce("failed", F.lit(False)), "index")
              .when(F.col("is_remote") & F.col("is_known"), "failed").when(F.col("is_remote"), "drop")
              .when(F.col("source") == REMOTE, "prune" if prune else "stale").otherwise("local"))
    return e.join(r, "id", "full_outer").select("id", action.alias("action"))


def sync_counts(plan: DataFrame) -> DataFrame:
    """One row of counts by action."""
    n = lambda *actions: F.count_if(F.col("action").isin(*actions))
    return plan.agg(n("reuse", "index", "failed", "drop").alias("remote_count"), n("index").alias("indexed_count"), n("reuse").alias("reused_count"), n("prune").alias("removed_count"), n("failed", "drop").alias("failed_count"))


def merge_sync(existing: DataFrame, fetched: DataFrame, plan: DataFrame) -> DataFrame:
    """The photos after a synchronization: new rows of indexed assets, previous rows of the rest that stays."""
    kept = existing.join(plan.where(F.col("action").isin("reuse", "failed", "local", "stale")), "id", "left_semi")
    new = fetched.join(plan.where("action = 'index'"), "id", "left_semi")
    return kept.unionByName(new, allowMissingColumns=True)


def unknown_ids(wanted: DataFrame, photos: DataFrame) -> DataFrame:
    """Wanted ids that are no synchronized photo: an album must not be made of them."""
    return wanted.select(F.col("id")).distinct().join(photos.where(F.col("source") == REMOTE).select("id"), "id", "left_anti").orderBy("id")
