"""Density clustering of vectors by cosine distance, and persons made of clustered faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import vector
from lumenlake.functions.lineage import durable
from lumenlake.operators import blocks


def _near(eps: float) -> blocks.Rule:
    return lambda rows, a, b: 1 - blocks.cosine(rows, a, b) <= eps


def _both_core(eps: float) -> blocks.Rule:
    return lambda rows, a, b: _near(eps)(rows, a, b) & rows["core"][a][:, None] & rows["core"][b][None, :]


def dbscan(rows: DataFrame, eps: float = 0.35, min_samples: int = 2) -> DataFrame:
    """rows with label: clusters of each library by their first core row, -1 for noise and for rows without a vector.

    A core row has min_samples rows within eps, itself among them; cores within eps share a cluster; a border row
    takes the cluster with the smallest label among its cores.  Neighbours are counted, linked and labelled block by
    block, of a large library only in blocks whose directions come near enough; no table of pairs is made.
    """
    seen = rows.where(vector.present(F.col("embedding"))).select("library_id", blocks.node().alias("node"), F.col("ord").cast("long").alias("ord"), vector.as_double(F.col("embedding")).alias("embedding"))
    alike = ("embedding", 1 - eps)
    counts = blocks.counted(seen, _near(eps), alike)
    marked = durable(seen.join(counts, "node", "left").withColumn("core", F.coalesce("n", F.lit(0)) + 1 >= min_samples).drop("n"))
    found = blocks.linked(marked.where("core"), _both_core(eps), alike=alike)
    cores = marked.where("core").select("library_id", "ord", "node").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = cores.groupBy("library_id", "component").agg(F.min("ord").alias("head"))
    heads = heads.withColumn("label", (F.row_number().over(Window.partitionBy("library_id").orderBy("head")) - 1).cast("long"))
    labelled = durable(cores.join(heads, ["library_id", "component"]).select("node", "label"))
    border = blocks.least(marked.select("library_id", "node", "embedding").join(labelled, "node", "left"), _near(eps), "label", alike)
    label = labelled.unionByName(border).withColumnRenamed("node", "__node").withColumnRenamed("label", "__label")
    return rows.withColumn("__node", blocks.node()).join(label, "__node", "left").withColumn("label", F.coalesce("__label", F.lit(-1).cast("long"))).drop("__node", "__label")


def extract_faces(detections: DataFrame) -> DataFrame:
    """Faces of detections (library_id, photo_ord, photo_id, position, bbox, embedding, det_score, ...).

    Vectors get unit length; a zero vector is skipped, though its place in the photo still counts for the ids.
    """
    v = vector.as_double(F.col("embedding"))
    kept = detections.where(vector.present(F.col("embedding")) & (vector.norm(v) > vector.EPSILON))
    order = Window.partitionBy("library_id").orderBy("photo_ord", "position")
    return kept.select("library_id", F.concat("photo_id", F.lit(":face-"), F.col("position")).alias("id"), "photo_id", "bbox", vector.unit(v).alias("embedding"), "det_score", (F.row_number().over(order) - 1).cast("long").alias("ord"))


def prototypes(labelled: DataFrame, weight: str | None = "det_score") -> DataFrame:
    """(library_id, label, prototype): the quality-weighted mean of each cluster's vectors; noise has none."""
    return vector.mean_vectors(labelled.where("label >= 0"), ["library_id", "label"], "embedding", "prototype", weight)


def cluster_people(faces: DataFrame, eps: float = 0.35, min_samples: int = 2) -> dict[str, DataFrame]:
    """Persons of faces: persons (with prototype), person_faces, person_photos and the noise faces."""
    labelled = durable(dbscan(faces, eps, min_samples))
    grouped = labelled.where("label >= 0")
    return {
        "persons": prototypes(labelled).select("library_id", F.col("label").alias("id"), "prototype", F.lit(None).cast("string").alias("name")),
        "person_faces": grouped.select("library_id", F.col("label").alias("person_id"), F.col("id").alias("face_id"), "ord"),
        "person_photos": grouped.select("library_id", F.col("label").alias("person_id"), "photo_id").distinct(),
        "noise": labelled.where("label < 0").select("library_id", F.col("id").alias("face_id"), "ord"),
    }
