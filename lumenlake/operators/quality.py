"""Photo quality: face scores and the weighted total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of sharpness, exposure, faces and composition; sharpness that counts as half.
WEIGHTS, HALF_SHARP = (0.35, 0.20, 0.20, 0.25), 100.0


def one_face(score: Column, box: Column, image_area: Column) -> Column:
    """A face's score, held to 0..1 and lowered if the face fills less than an eighth of the image."""
    area = F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])
    share = F.when((image_area > 0) & (F.coalesce(F.size(box), F.lit(0)) >= 4), F.least(F.lit(1.0), 8.0 * area / image_area)).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)) * share))


def face_quality(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """(library_id, id, face_quality_score) of every photo: the mean of its faces, 0.5 without any."""
    rows = faces.select("library_id", F.col("photo_id").alias("id"), "bbox", "det_score").join(photos.select("library_id", "id", "width", "height"), ["library_id", "id"])
    means = rows.groupBy("library_id", "id").agg(F.avg(one_face(F.col("det_score"), F.col("bbox"), (F.col("width") * F.col("height")).cast("double"))).alias("s"))
    return photos.select("library_id", "id").join(means, ["library_id", "id"], "left").select("library_id", "id", F.coalesce("s", F.lit(0.5)).alias("face_quality_score"))


def total(sharpness: Column, exposure: Column, faces: Column, composition: Column) -> Column:
    """The quality struct of a photo."""
    sharp = sharpness / (sharpness + HALF_SHARP)
    score = WEIGHTS[0] * sharp + WEIGHTS[1] * exposure + WEIGHTS[2] * faces + WEIGHTS[3] * composition
    return F.struct(sharpness.alias("sharpness"), sharp.alias("sharpness_score"), exposure.alias("exposure_score"), faces.alias("face_quality_score"), composition.alias("composition_score"), score.alias("score"))


def with_faces(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """photos with their quality computed anew from the faces on them."""
    found = face_quality(photos, faces)
    q = total(F.col("quality.sharpness"), F.col("quality.exposure_score"), F.col("face_quality_score"), F.col("quality.composition_score"))
    return photos.join(found, ["library_id", "id"]).withColumn("quality", q).drop("face_quality_score")
