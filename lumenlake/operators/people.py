"""Persons: corrections by hand, names and covers.

Persons are kept as tables: persons (library_id, id, prototype, name), person_faces (library_id, person_id, face_id),
person_photos (library_id, person_id, photo_id) and removed (library_id, person_id, photo_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import vector


def merge_map(known: set[int], merges: list[list[int]]) -> dict[int, int]:
    """Where each merged person ends up, merges being applied in order; errors for fewer than two or unknown ids."""
    alive, target = set(known), {}
    for ids in merges:
        if len(ids) < 2:
            raise ValueError("a merge needs at least two persons")
        if not set(ids) <= alive:
            raise ValueError(f"unknown person in merge: {ids}")
        keep = min(ids)
        for p in set(ids) - {keep}:
            alive.discard(p)
            target = {a: keep if b == p else b for a, b in target.items()} | {p: keep}
    return target


def apply_feedback(people: dict[str, DataFrame], faces: DataFrame, library_id, merges: list[list[int]] = (), removals: list[tuple[int, str]] = ()) -> dict[str, DataFrame]:
    """people with the operations applied to one library: merges in order, then removals of photos from persons.

    The operations are a list typed by hand; their persons are checked by one lookup of those ids.
    """
    spark = faces.sparkSession
    here = F.col("library_id") == library_id
    named = {p for ids in merges for p in ids} | {p for p, _ in removals}
    known = {r.id for r in people["persons"].where(here & F.col("id").isin(*named)).select("id").collect()} if named else set()
    target = merge_map(known, [list(m) for m in merges])
    for p, _ in removals:
        if p not in known or p in target:
            raise ValueError(f"unknown person: {p}")
    moved = F.create_map(*(F.lit(x).cast("long") for pair in target.items() for x in pair)) if target else None
    new_id = lambda c: F.coalesce(F.when(here, moved[F.col(c).cast("long")]), F.col(c).cast("long")) if target else F.col(c).cast("long")
    person_faces = people["person_faces"].withColumn("person_id", new_id("person_id")).select("library_id", "person_id", "face_id").distinct()
    person_photos = people["person_photos"].withColumn("person_id", new_id("person_id")).distinct()
    removed = people["removed"].withColumn("person_id", new_id("person_id")).distinct() if "removed" in people else None
    if removals:
        kind = dict(faces.dtypes)["library_id"]
        gone = spark.createDataFrame([(library_id, int(p), str(photo)) for p, photo in removals], f"library_id {kind}, person_id long, photo_id string").distinct()
        person_photos = person_photos.join(gone, ["library_id", "person_id", "photo_id"], "left_anti")
        owned = person_faces.join(faces.select("library_id", F.col("id").alias("face_id"), F.col("photo_id").cast("string").alias("photo_id")), ["library_id", "face_id"], "left")
        person_faces = owned.join(gone, ["library_id", "person_id", "photo_id"], "left_anti").select("library_id", "person_id", "face_id")
        removed = gone if removed is None else removed.unionByName(gone).distinct()
    weighted = person_faces.join(faces.select("library_id", F.col("id").alias("face_id"), "embedding", "det_score"), ["library_id", "face_id"])
    fresh = vector.mean_vectors(weighted, ["library_id", "person_id"], "embedding", "prototype", "det_score").withColumnRenamed("person_id", "id")
    kept = people["persons"].where(~(here & F.col("id").isin(*target)) if target else F.lit(True)).select("library_id", F.col("id").cast("long").alias("id"), "name")
    out = {"persons": kept.join(fresh, ["library_id", "id"], "left"), "person_faces": person_faces, "person_photos": person_photos}
    return out | ({"removed": removed} if removed is not None else {}) | {k: v for k, v in people.items() if k not in ("persons", "person_faces", "person_photos", "removed")}


def set_name(persons: DataFrame, library_id, person_id: int, name: str | None) -> DataFrame:
    """persons with one renamed; a blank name clears it; an unknown person is an error."""
    this = (F.col("library_id") == library_id) & (F.col("id") == person_id)
    if persons.where(this).limit(1).count() == 0:
        raise ValueError(f"unknown person: {person_id}")
    return persons.withColumn("name", F.when(this, F.lit((name or "").strip() or None)).otherwise(F.col("name")))


def covers(person_faces: DataFrame, faces: DataFrame, photos: DataFrame) -> DataFrame:
    """(library_id, person_id, photo_id, face_id, alone): the photo and face that show a person best.

    Photos with only that person's face come first, then better photos, then earlier ones; of a photo's faces of the
    person, the surest.
    """
    all_faces = faces.select("library_id", F.col("id").alias("face_id"), "photo_id", "det_score", F.col("ord").alias("face_ord"))
    counted = all_faces.withColumn("on_photo", F.count("*").over(Window.partitionBy("library_id", "photo_id")))
    rows = person_faces.select("library_id", "person_id", "face_id").join(counted, ["library_id", "face_id"]).join(photos.select("library_id", F.col("id").alias("photo_id"), "ord", "score"), ["library_id", "photo_id"])
    order = Window.partitionBy("library_id", "person_id").orderBy(F.when(F.col("on_photo") == 1, 0).otherwise(1), F.coalesce("score", F.lit(0.0)).desc(), "ord", F.coalesce("det_score", F.lit(0.0)).desc(), "face_ord")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("library_id", "person_id", "photo_id", "face_id", (F.col("on_photo") == 1).alias("alone"))


def seen_span(person_photos: DataFrame, photos: DataFrame) -> DataFrame:
    """(library_id, person_id, first_seen, last_seen) by the capture time as written."""
    rows = person_photos.join(photos.select("library_id", F.col("id").alias("photo_id"), "captured_at"), ["library_id", "photo_id"])
    return rows.groupBy("library_id", "person_id").agg(F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))
