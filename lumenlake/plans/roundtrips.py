"""The registered queries of sources and sinks, with their counterparts in DuckDB's SQL.

Each writes files made from the driver's tables, as a whole, into the shared folder and reads them back through the
operator, so its result can be told from the tables alone.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import imaging
from lumenlake.functions.lineage import shared_dir, written
from lumenlake.operators import metrics, narrative, people, quality, search, sync
from lumenlake.plans import search_plan
from lumenlake.plans.testbed import PLACES_SQL, places_and_times, table
from lumenlake.sources import files, images, remote

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def _folder(spark: SparkSession) -> str:
    """A new shared folder, as a URI."""
    name = shared_dir(spark)
    return name if "://" in name else name.replace("file:", "file://", 1) if name.startswith("file:") else f"file://{name}"


def _write(folder: str, name: str, content: bytes) -> str:
    fs, top = FileSystem.from_uri(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/{name}") as out:
        out.write(content)
    return f"{folder}/{name}"


# --- image files ------------------------------------------------------------------------------------------------

def _png(left: int, right: int, width: int, height: int, exif: bytes = b"") -> bytes:
    """A gray image of two halves."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    row = b"\0" + bytes([left]) * 3 * (width // 2) + bytes([right]) * 3 * (width // 2)
    return (b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + (part(b"eXIf", exif) if exif else b"")
            + part(b"IDAT", zlib.compress(row * height)) + part(b"IEND", b""))


def _exif(taken: str, make: str, model: str, lat: int, south: bool, lon: int) -> bytes:
    """A TIFF block with a time, a camera and a place of whole degrees."""
    texts = [make.encode() + b"\0", model.encode() + b"\0", taken.encode() + b"\0"]
    gps = 8 + 2 + 4 * 12 + 4
    data = gps + 2 + 4 * 12 + 4
    places, at = [], data
    for t in texts:
        places.append(at)
        at += len(t)
    three = lambda v: struct.pack("<IIIIII", v, 1, 30, 1, 0, 1)
    out = b"II*\0" + struct.pack("<IH", 8, 4) + b"".join(struct.pack("<HHII", tag, 2, len(t), p) for tag, t, p in zip((271, 272, 306), texts, places, strict=True)) + struct.pack("<HHII", 34853, 4, 1, gps) + b"\0\0\0\0"
    out += struct.pack("<H", 4) + struct.pack("<HHI", 1, 2, 2) + (b"S" if south else b"N") + b"\0\0\0" + struct.pack("<HHII", 2, 5, 3, at) + struct.pack("<HHI", 3, 2, 2) + b"E\0\0\0" + struct.pack("<HHII", 4, 5, 3, at + 24) + b"\0\0\0\0"
    return out + b"".join(texts) + three(lat) + three(lon)


def _image_file(k: int) -> tuple[str, bytes]:
    """Name and content of the file of supplier k; _FILES_SQL says the same."""
    exif = _exif(f"2023{':' if k % 3 else '/'}{k % 12 + 1:02d}:{k % 28 + 1:02d} 08:09:10", f"Maker{k % 3}", f" M{k} ", k % 80, k % 2 == 1, k % 170)
    w, h = 8 + k % 5 * 2, 10 + k % 3
    if k % 4 == 0:
        left = k * 7 % 256
        return f"a/photo-{k}.png", _png(left, left if k % 12 == 0 else k * 13 % 256, w, h, exif if k % 8 == 0 else b"")
    if k % 4 == 1:
        block = b"Exif\0\0" + exif
        return f"b/Shot-{k}.JPG", b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00\xff\xd9"
    if k % 4 == 2:
        return f"c/web-{k}.webp", b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<II", 10, 8) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little") + b"EXIF" + struct.pack("<I", len(exif)) + exif
    return f"notes-{k}.txt", b"no image"


_FILES_SQL = """f AS (SELECT s_suppkey AS k, s_suppkey % 12 AS kind, 8 + s_suppkey % 5 * 2 AS w, 10 + s_suppkey % 3 AS h, s_suppkey * 7 % 256 AS lft, CASE WHEN s_suppkey % 12 = 0 THEN s_suppkey * 7 % 256 ELSE s_suppkey * 13 % 256 END AS rgt,
  CASE s_suppkey % 4 WHEN 0 THEN 'a/photo-' || s_suppkey || '.png' WHEN 1 THEN 'b/Shot-' || s_suppkey || '.JPG' WHEN 2 THEN 'c/web-' || s_suppkey || '.webp' END AS file, s_suppkey % 4 <> 0 OR s_suppkey % 8 = 0 AS has_exif
  FROM supplier WHERE s_suppkey % 4 <> 3)"""


def _image_folder(spark: SparkSession, sf_dir: str) -> str:
    """Writes a file for every supplier, each by the task that has the row."""
    folder = _folder(spark)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)
        for part in parts:
            for k in part.column(0).to_pylist():
                name, content = _image_file(k)
                fs.create_dir(f"{top}/{name.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
                    out.write(content)
            yield part

    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k")).mapInArrow(write, "k long").write.format("noop").mode("overwrite").save()
    return folder


def _relative(folder: str) -> Column:
    return F.element_at(F.split("path", folder.rstrip("/").rpartition("/")[2] + "/"), -1).alias("file")


@_query("image_files", f"WITH {_FILES_SQL} SELECT file, true AS is_id, row_number() OVER (ORDER BY file) AS n FROM f")
def image_files(spark, sf_dir):
    folder = _image_folder(spark, sf_dir)
    found = images.list_images(spark, folder, content=False)
    own = F.substring(F.sha1(F.regexp_replace("path", "^file:/+", "/")), 1, 16)
    return images.numbered(found, [F.col("path")]).select(_relative(folder), (F.col("id") == own).alias("is_id"), F.col("n").cast("long").alias("n"))


_TAKEN_SQL = "'2023-' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') || 'T08:09:10'"


@_query("image_metadata", f"""WITH {_FILES_SQL} SELECT file, w::INTEGER AS width, h::INTEGER AS height, CASE WHEN has_exif THEN {_TAKEN_SQL} END AS captured_at, CASE WHEN has_exif THEN 'exif' ELSE 'filesystem' END AS captured_at_source,
  CASE WHEN has_exif THEN 'Maker' || (k % 3) || ' M' || k END AS camera, CASE WHEN has_exif THEN (CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END) * (k % 80 + 0.5::DOUBLE) END AS latitude, CASE WHEN has_exif THEN k % 170 + 0.5::DOUBLE END AS longitude,
  CASE WHEN has_exif THEN 'exif' END AS gps_source FROM f""")
def image_metadata(spark, sf_dir):
    folder = _image_folder(spark, sf_dir)
    found = images.with_metadata(images.list_images(spark, folder))
    return found.select(_relative(folder), "width", "height", F.when(F.col("captured_at_source") == "exif", F.col("captured_at")).alias("captured_at"), "captured_at_source", "camera", "latitude", "longitude", "gps_source")


@_query("image_index", f"""WITH {_FILES_SQL} SELECT 'mine' AS library_id, row_number() OVER (ORDER BY file) - 1 AS ord, file, w::INTEGER AS width, h::INTEGER AS height, CASE WHEN k % 4 = 0 THEN 256 ELSE 0 END::INTEGER AS dims, CASE WHEN k % 4 = 0 THEN 64 END::INTEGER AS bits,
  CASE WHEN k % 4 = 0 THEN 1.0::DOUBLE END AS length, CASE WHEN k % 10 = 0 THEN 'immich' ELSE 'local' END AS source, CASE WHEN k % 10 = 0 THEN 'was ' || k END AS original_filename FROM f""")
def image_index(spark, sf_dir):
    folder = _image_folder(spark, sf_dir)
    listed = images.list_images(spark, folder, content=False)
    k = F.regexp_extract("path", r"-(\d+)\.", 1).cast("long")
    known = listed.where(k % 10 == 0).select("id", F.lit("immich").alias("source"), F.lit("v1").alias("source_updated_at"), F.concat(F.lit("was "), k).alias("original_filename"))
    stored = f"{_folder(spark)}/index"
    files.write_photos(images.index_directory(spark, folder, "mine", known), stored)
    length = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return files.read_photos(spark, stored).select("library_id", "ord", _relative(folder), "width", "height", F.size("embedding").alias("dims"), F.length("phash").alias("bits"), F.round(F.when(F.size("embedding") > 0, length), 4).alias("length"), "source", "original_filename")


@_query("image_measures", f"""WITH {_FILES_SQL} SELECT file, round(2.0::DOUBLE * (rgt - lft) * (rgt - lft) / w, 4) AS sharpness, round(1 - 0.5::DOUBLE * (0.5::DOUBLE * ((lft / 255.0::DOUBLE < 0.05)::INTEGER + (rgt / 255.0::DOUBLE < 0.05)::INTEGER) + 0.5::DOUBLE * ((lft / 255.0::DOUBLE > 0.95)::INTEGER + (rgt / 255.0::DOUBLE > 0.95)::INTEGER)), 6) AS exposure,
  CASE WHEN lft = rgt THEN round(0.75::DOUBLE * (1 - sqrt(2.0::DOUBLE) / 6 / 0.48::DOUBLE), 4) END AS flat_composition, 64 AS bits FROM f WHERE k % 4 = 0""")
def image_measures(spark, sf_dir):
    folder = _image_folder(spark, sf_dir)
    f = _decoded(spark, folder)
    measured = imaging.image_features(f).where("path like '%.png'")
    return measured.select(_relative(folder), F.round("features.sharpness", 4).alias("sharpness"), F.round("features.exposure_score", 6).alias("exposure"),
                           F.when(F.round("features.sharpness", 6) == 0, F.round("features.composition_score", 4)).alias("flat_composition"), F.length("features.phash").alias("bits"))


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and decoded image of a folder's files."""
    key = F.regexp_replace("path", "^file:/+", "/")
    pixels = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select(F.col("image.origin").alias("path"), "image").withColumn("path", key)
    return images.list_images(spark, folder).withColumn("path", key).join(pixels, "path")


class _Detector:
    """Two marks on every image: one of the left half's brightness, one that is no vector."""

    def detect(self, image: np.ndarray) -> list[tuple[list[float], list[float], float]]:
        return [([1.0, 1.0, 3.0, 3.0], [float(image[0, 0, 0]) + 1, 0.0], 0.75), ([0.0, 0.0, 1.0, 1.0], [0.0, 0.0], 0.5)]


@_query("faces_detected", f"""WITH {_FILES_SQL} SELECT file, file || ':face-0' AS id, 1.0::DOUBLE AS x, 0.75::DOUBLE AS det_score, lft // 32 AS first_bin, 3 AS bins, round(1 / sqrt(3.0::DOUBLE), 6) AS height, 0 AS cover_left, 0 AS cover_top, 5 AS cover_right, 5 AS cover_bottom
  FROM f WHERE k % 4 = 0""")
def faces_detected(spark, sf_dir):
    from lumenlake.operators import density

    folder = _image_folder(spark, sf_dir)
    seen = imaging.detect_faces(_decoded(spark, folder).select(_relative(folder), "image", "content"), _Detector)
    kept = density.extract_faces(seen.select(F.lit("mine").alias("library_id"), F.col("file").alias("photo_ord"), F.col("file").alias("photo_id"), "position", "bbox", "embedding", "det_score"))
    looks = seen.select(F.col("file").alias("photo_id"), "position", "appearance_embedding").where("position = 0")
    box = imaging.cover_box(*(F.col("bbox")[i] for i in range(4)), F.lit(8), F.lit(10))
    return kept.join(looks, "photo_id").select(
        F.col("photo_id").alias("file"), "id", F.round(F.col("embedding")[0], 6).alias("x"), "det_score", (F.array_position(F.transform("appearance_embedding", lambda v: v > 0), True) - 1).alias("first_bin"),
        F.size(F.filter("appearance_embedding", lambda v: v > 0)).alias("bins"), F.round(F.array_max("appearance_embedding"), 6).alias("height"), *(box[s].alias(f"cover_{s}") for s in ("left", "top", "right", "bottom")))


class _Mean:
    """An encoder for tests: the brightness of the two halves."""

    def encode_image(self, image: np.ndarray, content: bytes) -> list[float]:
        return [float(image[0, 0, 0]), float(image[0, -1, 0]), float(len(content) > 0)]


@_query("images_encoded", f"WITH {_FILES_SQL} SELECT file, [lft, rgt, 1]::VARCHAR AS v, true AS by_name FROM f WHERE k % 4 = 0")
def images_encoded(spark, sf_dir):
    folder = _image_folder(spark, sf_dir)
    shown = imaging.encode_images(_decoded(spark, folder), _Mean).where("path like '%.png'")
    kinds = isinstance(imaging.create_encoder("hash"), imaging.HashEncoder)
    return shown.select(_relative(folder), F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<int>").cast("array<string>"), ", "), F.lit("]")).alias("v"), F.lit(kinds).alias("by_name"))


@_query("prepared_files", f"""WITH {_FILES_SQL} SELECT file AS source_file, lpad((row_number() OVER (ORDER BY lower(file), file))::VARCHAR, 6, '0') || '.jpg' AS output_file, upper(split_part(file, '.', 2)) AS source_format, true AS same_bytes, has_exif AS has_place, true AS metadata_preserved FROM f""")
def prepared_files(spark, sf_dir):
    folder = _image_folder(spark, sf_dir)
    found = images.with_metadata(images.list_images(spark, folder)).withColumn("path", F.concat(F.lit("/top/"), _relative(folder)))
    out = images.prepare_manifest(found, "/top")
    kept = images.metadata_preserved(out, out.withColumn("latitude", F.col("latitude") + 1e-9))
    return out.join(kept, "output_file").select("source_file", "output_file", "source_format", (F.col("source_sha256") == F.col("output_sha256")).alias("same_bytes"), F.col("gps_source").isNotNull().alias("has_place"), "metadata_preserved")


@_query("upload_checks", """
WITH u AS (SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'a/' || c_name || '.jpg' WHEN 1 THEN '../' || c_name || '.png' WHEN 2 THEN '/abs/' || c_name || '.png' WHEN 3 THEN '' WHEN 4 THEN c_name || '.txt' WHEN 5 THEN 'C:\\' || c_name || '.png' WHEN 6 THEN 'a/../' || c_name || '.png' ELSE c_name || '.TIFF' END AS path,
  CASE WHEN c_custkey % 3 = 0 THEN 200000000 ELSE 5 END AS length FROM customer)
SELECT k, path, CASE WHEN k % 8 IN (1, 2, 3, 5, 6) THEN 'unsafe path' WHEN k % 8 = 4 THEN 'unsupported type' WHEN length > 104857600 THEN 'too large' END AS rejected FROM u""")
def upload_checks(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    parts = {0: ("a/", ".jpg"), 1: ("../", ".png"), 2: ("/abs/", ".png"), 4: ("", ".txt"), 5: ("C:\\", ".png"), 6: ("a/../", ".png"), 7: ("", ".TIFF")}
    path = F.lit("")
    for r, (before, after) in parts.items():
        path = F.when(k % 8 == r, F.concat(F.lit(before), name, F.lit(after))).otherwise(path)
    up = table(spark, sf_dir, "customer").select(k.alias("k"), path.alias("path"), F.when(k % 3 == 0, 200000000).otherwise(5).alias("length"))
    return images.sort_uploads(up).select("k", "path", "rejected")


# --- tables as files --------------------------------------------------------------------------------------------

def _supplier_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of photos without vectors, one for each supplier."""
    k = F.col("s_suppkey")
    q = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("sharpness", "sharpness_score", "exposure_score", "face_quality_score", "composition_score")), F.when(k % 5 != 0, k % 7 / 8).alias("score"))
    return table(spark, sf_dir, "supplier").select(
        F.lit("mine").alias("library_id"), k.cast("long").alias("ord"), F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit("/photos/dir"), k % 4, F.lit("/"), "s_name", F.lit(".jpg")).alias("path"),
        F.when(k % 3 != 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("captured_at"), F.when(k % 4 != 1, k % 90 + 0.5).alias("latitude"), F.when(k % 4 != 1, k % 180 + 0.25).alias("longitude"),
        F.when(k % 6 == 0, F.concat(F.lit("own name "), k, F.lit(".jpg"))).alias("original_filename"), F.when(k % 2 == 0, "immich").otherwise("local").alias("source"), q.alias("quality"), F.when(k % 5 != 0, k % 7 / 8).alias("score"))


_SUPPLIER_SQL = """p AS (SELECT s_suppkey AS k, 'p' || s_suppkey AS id, '/photos/dir' || (s_suppkey % 4) || '/' || s_name || '.jpg' AS path, CASE WHEN s_suppkey % 3 <> 0 THEN '2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') END AS captured_at,
  CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey % 90 + 0.5::DOUBLE END AS latitude, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey % 180 + 0.25::DOUBLE END AS longitude, CASE WHEN s_suppkey % 6 = 0 THEN 'own name ' || s_suppkey || '.jpg' END AS original_filename,
  CASE WHEN s_suppkey % 2 = 0 THEN 'immich' ELSE 'local' END AS source, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 7) / 8.0::DOUBLE END AS score, coalesce(CASE WHEN s_suppkey % 6 = 0 THEN 'own name ' || s_suppkey || '.jpg' END, s_name || '.jpg') AS filename FROM supplier)"""


@_query("photo_index_json", f"WITH {_SUPPLIER_SQL} SELECT 'other' AS library_id, row_number() OVER (ORDER BY id) - 1 AS ord, id, path, captured_at, latitude, coalesce(source, 'local') AS source, score, CASE WHEN captured_at IS NOT NULL THEN captured_at || ' 00:00:00' END AS wall FROM p")
def photo_index_json(spark, sf_dir):
    rows = _supplier_photos(spark, sf_dir).drop("library_id", "ord", "score")
    folder = _folder(spark)
    rows.write.json(f"{folder}/index")
    found = files.read_json_index(spark, f"{folder}/index", "other", lines=True)
    return found.select("library_id", "ord", "id", "path", "captured_at", "latitude", "source", F.col("quality.score").alias("score"), F.col("captured_wall").cast("string").alias("wall"))


@_query("label_sheets", """
WITH l AS (SELECT doc_id, 'x' || doc_id AS photo_id, 'E' || quality || toxic AS event_id, 'J' || (doc_id % 5) AS journey_id, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS label_confidence FROM labels)
SELECT 'csv' AS kind, photo_id, event_id, journey_id, label_confidence FROM l UNION ALL SELECT 'list', photo_id, event_id, journey_id, label_confidence FROM l
UNION ALL SELECT 'map', photo_id, any_value(event_id), NULL, 'high' FROM l GROUP BY photo_id""")
def label_sheets(spark, sf_dir):
    d = F.col("doc_id")
    sheet = table(spark, sf_dir, "labels").select(F.concat(F.lit("x"), d).alias("photo_id"), F.concat(F.lit("E"), "quality", "toxic").alias("event_id"), F.concat(F.lit("J"), d % 5).alias("journey_id"), F.when(d % 3 == 0, "low").when(d % 3 == 1, "high").alias("label_confidence"))
    folder = _folder(spark)
    sheet.withColumnRenamed("photo_id", "\ufeffphoto_id").write.option("header", "true").csv(f"{folder}/sheet.csv")
    sheet.write.json(f"{folder}/rows")
    # One object for each photo here; a file of a single large object is read by the same column expression.
    sheet.select(F.to_json(F.create_map("photo_id", "event_id")).alias("value")).distinct().write.text(f"{folder}/maps")
    found = [("csv", f"{folder}/sheet.csv", None), ("list", f"{folder}/rows", "rows"), ("map", f"{folder}/maps", "maps")]
    out = None
    for kind, path, lines in found:
        rows = files.read_label_sheet(spark, path, lines).select(F.lit(kind).alias("kind"), "photo_id", "event_id", "journey_id", "label_confidence")
        out = rows if out is None else out.unionByName(rows)
    return out


@_query("people_file", """
WITH f AS (SELECT label AS person_id, 'f' || vec_id AS face_id, 'p' || (vec_id // 3) AS photo_id FROM embeddings WHERE vec_id % 7 <> 0)
SELECT f.person_id::BIGINT AS person_id, CASE WHEN f.person_id % 2 = 0 THEN 'Person ' || f.person_id END AS name, count(*) AS faces, count(DISTINCT photo_id) AS photos, min(face_id) AS first_face, (SELECT count(*) FROM embeddings) AS all_faces, (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS noise FROM f GROUP BY f.person_id""")
def people_file(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    faces = e.select(F.lit("mine").alias("library_id"), F.col("vec_id").alias("ord"), F.concat(F.lit("f"), "vec_id").alias("id"), F.concat(F.lit("p"), F.floor(F.col("vec_id") / 3)).alias("photo_id"), F.array(F.lit(0.0)).alias("bbox"), "embedding", F.lit(0.5).alias("det_score"), "label")
    own = faces.where("ord % 7 <> 0").withColumn("person_id", F.col("label").cast("long"))
    index = {"persons": own.select("person_id").distinct().select(F.col("person_id").alias("id"), F.array(F.lit(1.0)).alias("prototype"), F.when(F.col("person_id") % 2 == 0, F.concat(F.lit("Person "), "person_id")).alias("name")),
             "person_faces": own.select("person_id", F.col("id").alias("face_id")), "person_photos": own.select("person_id", "photo_id").distinct(), "noise": faces.where("ord % 7 = 0").select(F.col("id").alias("face_id"))}
    path = f"{_folder(spark)}/people"
    files.write_people(index, faces, path)
    got = files.read_people(spark, path, "mine")
    by = got["person_faces"].groupBy("person_id").agg(F.count("*").alias("faces"), F.min("face_id").alias("first_face")).join(got["person_photos"].groupBy("person_id").agg(F.count("*").alias("photos")), "person_id")
    counts = got["faces"].agg(F.count("*").alias("all_faces")).crossJoin(got["noise"].agg(F.count("*").alias("noise")))
    return by.join(got["persons"].select(F.col("id").alias("person_id"), "name"), "person_id").crossJoin(counts).select("person_id", "name", "faces", "photos", "first_face", "all_faces", "noise")


@_query("remote_assets", """
SELECT 'a' || s_suppkey AS id, '/cache/a' || s_suppkey || '.jpg' AS path, CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE s_suppkey % 3 END::INTEGER AS width, CASE WHEN s_suppkey % 2 = 0 THEN '2024-05-01' ELSE '2024-06-01' END AS captured_at,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / 100.0 END AS latitude, CASE WHEN s_suppkey % 4 <> 0 THEN 'immich' END AS gps_source, CASE WHEN s_suppkey % 5 <> 0 THEN 'Make ' || s_suppkey END AS camera, 'v' || (s_suppkey % 9) AS source_updated_at FROM supplier""")
def remote_assets(spark, sf_dir):
    """A listing of 40 assets a page, landed page by page as the manager sends it, read by the data source: pages are partitions."""
    k, folder, size = F.col("s_suppkey"), _folder(spark), 40
    rows = table(spark, sf_dir, "supplier")
    total = rows.agg(F.max(k) + 1).first()[0] or 0  # ids run through, from 0 or 1
    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1], recursive=True)

    def land(page: pd.DataFrame) -> pd.DataFrame:
        number = int(page.page.iloc[0])
        items = [{"id": f"a{r.s_suppkey}", "updatedAt": f"v{r.s_suppkey % 9}", "fileCreatedAt": "2024-05-01" if r.s_suppkey % 2 == 0 else "", "localDateTime": "2024-06-01", "originalFileName": r.s_name, "width": int(r.s_suppkey % 3),
                  "exifInfo": {"latitude": repr(r.s_acctbal / 100) if r.s_suppkey % 4 else None, "longitude": "x", "make": " Make " if r.s_suppkey % 5 else None, "model": str(r.s_suppkey) if r.s_suppkey % 5 else " ", "exifImageWidth": 7}} for r in page.itertuples()]
        _write(folder, f"{number}.json", json.dumps({"assets": {"total": total, "items": [*items, {}], "nextPage": str(number + 1) if number * size < total else None}}).encode())
        return pd.DataFrame({"page": [number]})

    rows.select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"), F.floor(k / size + 1).cast("int").alias("page")).groupBy("page").applyInPandas(land, "page int").write.format("noop").mode("overwrite").save()
    found = remote.read_remote(spark, remote.PageFolder(folder), size)
    return sync.record_from_asset(found, "/cache").select("id", "path", "width", "captured_at", "latitude", "gps_source", "camera", "source_updated_at")


@_query("remote_manager", f"""WITH {_SUPPLIER_SQL} SELECT id AS asset, 'Best' AS album, count(*) OVER () AS album_size FROM p WHERE source = 'immich'""")
def remote_manager(spark, sf_dir):
    """An album of all synchronized photos: requests go out from the tasks, and what they have sent is read where it arrived."""
    photos, folder = _supplier_photos(spark, sf_dir), _folder(spark)
    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1], recursive=True)

    def inbox(path: str, body: dict) -> dict:
        _write(folder, f"{hashlib.md5(json.dumps([path, body]).encode()).hexdigest()}.json", json.dumps({"path": path, **body}).encode())
        return {"id": "Best", **body}

    sent = written(files.create_album(inbox, " Best ", photos.where("source = 'immich'"), photos, 50))
    total = sent.agg(F.sum("sent").alias("album_size"))
    arrived = spark.read.schema("path string, ids array<string>").json(folder)
    return arrived.where("ids IS NOT NULL").select(F.explode("ids").alias("id"), F.element_at(F.split("path", "/"), 3).alias("album")).crossJoin(total).withColumnRenamed("id", "asset")


@_query("project_files", """
SELECT substr(md5(s_name), 1, 12) AS id, 'The ' || s_name AS name, CASE WHEN s_suppkey % 50 = 0 THEN 3 ELSE 0 END::INTEGER AS photo_count, '2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') AS created_at, true AS valid FROM supplier""")
def project_files(spark, sf_dir):
    root, k = _folder(spark), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.substring(F.md5("s_name"), 1, 12).alias("id"), F.concat(F.lit(" The   "), "s_name", F.lit(" ")).alias("name"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("now"), (k % 50 == 0).alias("known"))
    files.create_projects(rows, root).write.format("noop").mode("overwrite").save()
    _write(f"{root}/broken", "project.json", b"{no json")
    found = files.read_projects(spark, root).join(rows.select("id", "known"), "id")
    return found.select("id", "name", F.when(F.col("known"), 3).otherwise(F.col("photo_count")).alias("photo_count"), "created_at", search.project_id_is_valid(F.col("id")).alias("valid"))


@_query("csv_export", f"WITH {_SUPPLIER_SQL} SELECT id AS photo_id, filename, coalesce(captured_at, '') AS captured_at, latitude, longitude, score AS quality_score, true AS marked FROM p")
def csv_export(spark, sf_dir):
    path = f"{_folder(spark)}/photos.csv"
    files.write_csv(_supplier_photos(spark, sf_dir), path)
    begins = spark.read.format("binaryFile").load(path).select(F.hex(F.substring("content", 1, 3)).alias("mark"))
    heads = begins.where("mark <> 'EFBBBF'").isEmpty()
    rows = spark.read.csv(path, header=True, nullValue="\x00")
    rows = rows.withColumnsRenamed({c: c.lstrip("\ufeff") for c in rows.columns})
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return rows.select("photo_id", "filename", F.coalesce("captured_at", F.lit("")).alias("captured_at"), number("latitude"), number("longitude"), number("quality_score"), F.lit(heads).alias("marked"))


@_query("manifest_counts", f"""WITH {_SUPPLIER_SQL} SELECT (SELECT count(*) FROM p) AS photos, (SELECT count(*) FROM nation) AS events, (SELECT count(*) FROM region) AS similar_groups, 'P' AS project""")
def manifest_counts(spark, sf_dir):
    path = f"{_folder(spark)}/manifest"
    files.manifest({"name": "P"}, _supplier_photos(spark, sf_dir), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), path)
    project = spark.read.text(f"{path}/project").select(F.get_json_object("value", "$.name").alias("project"))
    return spark.read.json(f"{path}/counts").crossJoin(project).select("photos", "events", "similar_groups", "project")


@_query("best_shot_names", f"""WITH {_SUPPLIER_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY coalesce(score, 0) DESC, k) AS rank FROM p)
SELECT rank::INTEGER AS rank, id, 'rank' || lpad(rank::VARCHAR, 2, '0') || '-' || id || '-' || regexp_replace(filename, '[^A-Za-z0-9_.\\-]+', '_', 'g') AS archive_name FROM r WHERE rank <= 50""")
def best_shot_names(spark, sf_dir):
    return files.best_shot_names(_supplier_photos(spark, sf_dir), 99)


@_query("narrative_lines", f"""WITH {_SUPPLIER_SQL}, m AS (SELECT k % 6 AS event_id, k, filename FROM p),
j AS (SELECT 'event' AS kind, event_id AS number, string_agg(filename, '|' ORDER BY k) AS photos, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'template' END AS name_source FROM m GROUP BY event_id
  UNION ALL SELECT 'journey', event_id % 2, string_agg(filename, '|' ORDER BY event_id, k), 'template' FROM m GROUP BY event_id % 2)
SELECT j.*, 'mixed' AS generation_mode, (SELECT count(DISTINCT event_id) FROM m) AS events FROM j""")
def narrative_lines(spark, sf_dir):
    photos = _supplier_photos(spark, sf_dir)
    members = photos.select("library_id", (F.col("ord") % 6).alias("event_id"), "id", F.col("ord").alias("pos"))
    named = members.select("library_id", "event_id").distinct().select("*", F.concat(F.lit("Event "), "event_id").alias("name"), F.when(F.col("event_id") % 2 == 0, "llm").otherwise("template").alias("name_source"))
    trips = members.select("library_id", "event_id").distinct().groupBy("library_id", (F.col("event_id") % 2).alias("journey_id")).agg(F.array_sort(F.collect_set("event_id")).alias("event_ids")).withColumn("name", F.lit("Trip")).withColumn("name_source", F.lit("template"))
    path = f"{_folder(spark)}/narratives"
    files.narrative_dump(named, members, photos, trips).write.text(path)
    line = lambda key: F.get_json_object("value", f"$.{key}")
    rows = spark.read.text(path).select(line("kind").alias("kind"), F.coalesce(line("journey_id"), line("event_id")).cast("long").alias("number"), F.array_join(F.from_json(line("photos"), "array<string>"), "|").alias("photos"), line("name_source").alias("name_source"))
    mode = files.generation_mode(files.counts(named, trips)).select("generation_mode", "events")
    return rows.crossJoin(mode)


_FACE_SQL = """WITH x AS (SELECT vec_id, abs(embedding[1])::DOUBLE * 500 AS s, abs(embedding[20])::DOUBLE AS e, abs(embedding[64])::DOUBLE AS c FROM embeddings),
g AS (SELECT vec_id // 3 AS id, avg(greatest(0, least(1, (vec_id % 10 + 1) / 11.0::DOUBLE * least(1, 8 * 12.0 / 1000)))) AS q FROM embeddings WHERE vec_id % 4 <> 0 GROUP BY 1)"""


@_query("quality_with_faces", f"{_FACE_SQL} SELECT vec_id AS id, round(coalesce(q, 0.5), 6) AS face_quality_score, round(0.35 * (s / (s + 100.0)) + 0.20 * e + 0.20 * coalesce(q, 0.5) + 0.25 * c, 6) AS score FROM x LEFT JOIN g ON g.id = x.vec_id")
def quality_with_faces(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = lambda i: F.abs(F.col("embedding")[i]).cast("double")
    shots = e.select(F.lit("mine").alias("library_id"), F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"), F.lit(50).alias("width"), F.lit(20).alias("height"), quality.total(x(0) * 500, x(19), F.lit(0.1), x(63)).alias("quality"))
    faces = e.where("vec_id % 4 <> 0").select(F.lit("mine").alias("library_id"), F.floor(F.col("vec_id") / 3).cast("long").alias("photo_id"), F.array(*(F.lit(v) for v in (1.0, 1.0, 4.0, 5.0))).alias("bbox"), ((F.col("vec_id") % 10 + 1) / 11).alias("det_score"))
    path = f"{_folder(spark)}/enriched"
    files.write_photos(quality.with_faces(shots, faces), path)
    return spark.read.parquet(path).select("id", F.round("quality.face_quality_score", 6).alias("face_quality_score"), F.round("quality.score", 6).alias("score"))


# --- listings, labels, persons and annotations ------------------------------------------------------------------

@_query("photo_listing", f"""WITH {_SUPPLIER_SQL} SELECT id, CASE WHEN k % 3 = 1 THEN split_part(path, '/', 4) ELSE filename END AS filename, path[9:] AS relative_path, CASE WHEN k % 3 <> 1 THEN captured_at END AS captured_at, CASE WHEN k % 3 <> 1 THEN score END AS quality_score FROM p""")
def photo_listing(spark, sf_dir):
    photos = _supplier_photos(spark, sf_dir)
    return search.listing(photos.where("ord % 3 <> 1"), "/photos", photos.select("id", "path"))


@_query("results_decorated", f"""WITH {_SUPPLIER_SQL} SELECT id, CASE WHEN source = 'immich' THEN id END AS immich_asset_id, CASE WHEN source = 'immich' THEN '/immich/assets/' || id || '/thumbnail' END AS thumbnail_url, (SELECT coalesce(max(id), 'none') FROM p WHERE id = 'p7') AS found FROM p""")
def results_decorated(spark, sf_dir):
    photos = _supplier_photos(spark, sf_dir)
    one = search.lookup(photos, "p7").agg(F.coalesce(F.max("id"), F.lit("none")).alias("found"))
    return search.decorated(photos).crossJoin(one).select("id", "immich_asset_id", "thumbnail_url", "found")


@_query("labels_resolved", f"""WITH {_SUPPLIER_SQL}, l AS (SELECT *, CASE k % 3 WHEN 0 THEN id WHEN 1 THEN filename ELSE regexp_replace(filename, '\\.[^.]*$', '') END AS photo_id, 'L' || (k % 4) AS label FROM p) SELECT id, label FROM l""")
def labels_resolved(spark, sf_dir):
    photos = _supplier_photos(spark, sf_dir)
    name = F.coalesce("original_filename", F.element_at(F.split("path", "/"), -1))
    key = F.when(F.col("ord") % 3 == 0, F.col("id")).when(F.col("ord") % 3 == 1, name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return metrics.resolve_labels(photos.select(key.alias("photo_id"), F.concat(F.lit("L"), F.col("ord") % 4).alias("label")), photos)


@_query("photo_labels", """
WITH l AS (SELECT e.vec_id AS id, max(e.label) FILTER (e.vec_id % 3 = 0) AS label FROM embeddings e GROUP BY 1) SELECT id, coalesce(label::VARCHAR, '-1') AS label, label IS NOT NULL AS valid FROM l""")
def photo_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit("mine").alias("library_id"), F.col("vec_id").alias("id"), "label")
    given = e.where("id % 3 = 0").select("*", F.lit(2).alias("ord")).unionByName(e.where("id % 6 = 0").withColumn("label", F.lit(77)).withColumn("ord", F.lit(1)))
    return metrics.with_labels(e.select("library_id", "id"), given, "label").select("id", "label", metrics.valid_label(F.col("label")).alias("valid"))


_PERSONS_SQL = """WITH f AS (SELECT vec_id, CASE label WHEN 3 THEN 1 WHEN 7 THEN 1 ELSE label END AS person_id, vec_id // 2 AS photo_id, embedding FROM embeddings),
k AS (SELECT * FROM f WHERE NOT (person_id = 1 AND photo_id IN (SELECT min(photo_id) FROM f WHERE person_id = 1)))"""


@_query("persons_corrected", f"""{_PERSONS_SQL} SELECT person_id::BIGINT AS id, CASE WHEN person_id = 2 THEN 'Ann' ELSE 'Person ' || person_id END AS name, count(*) AS faces, count(DISTINCT photo_id) AS photos,
  list_transform(range(2), lambda i: 0)::VARCHAR AS zeros, 1.0::DOUBLE AS prototype_length, (SELECT min(photo_id)::VARCHAR FROM f WHERE person_id = 1) AS removed_photo FROM k GROUP BY person_id""")
def persons_corrected(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    faces = e.select(F.lit("mine").alias("library_id"), F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("id"), F.floor(F.col("vec_id") / 2).cast("string").alias("photo_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0.5).alias("det_score"), F.col("label").cast("long").alias("person_id"))
    index = {"persons": faces.select("library_id", F.col("person_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("Person "), "id")),
             "person_faces": faces.select("library_id", "person_id", F.col("id").alias("face_id")), "person_photos": faces.select("library_id", "person_id", "photo_id").distinct()}
    first = str(e.where("label in (1, 3, 7)").agg(F.min(F.floor(F.col("vec_id") / 2))).first()[0])
    out = people.apply_feedback(index, faces, "mine", merges=[[3, 1], [7, 1]], removals=[(1, first)])
    named = people.set_name(out["persons"], "mine", 2, " Ann ")
    n = lambda df, name: df.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias(name))
    length = F.sqrt(F.aggregate("prototype", F.lit(0.0), lambda s, x: s + x * x))
    removed = out["removed"].agg(F.max("photo_id").alias("removed_photo"))
    return named.join(n(out["person_faces"], "faces"), "id").join(n(out["person_photos"], "photos"), "id").crossJoin(removed).select("id", "name", "faces", "photos", F.lit("[0, 0]").alias("zeros"), F.round(length, 6).alias("prototype_length"), "removed_photo")


@_query("persons_seen", """
WITH m AS (SELECT s_nationkey::BIGINT AS person_id, CASE WHEN s_suppkey % 3 <> 0 THEN '2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') END AS taken FROM supplier)
SELECT person_id, min(taken) AS first_seen, max(taken) AS last_seen FROM m GROUP BY 1""")
def persons_seen(spark, sf_dir):
    on = table(spark, sf_dir, "supplier").select(F.lit("mine").alias("library_id"), F.col("s_nationkey").cast("long").alias("person_id"), F.concat(F.lit("p"), "s_suppkey").alias("photo_id"))
    return people.seen_span(on, _supplier_photos(spark, sf_dir)).select("person_id", "first_seen", "last_seen")


@_query("annotations_kept", """
WITH o AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 3 <> 0), n AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0),
a AS (SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL AND n.k % 4 = 0 THEN 'new ' || n.k ELSE CASE WHEN o.k IS NOT NULL THEN 'old ' || o.k END END AS name, CASE WHEN n.k IS NOT NULL THEN 'note ' || n.k END AS note FROM o FULL JOIN n ON o.k = n.k)
SELECT n_nationkey::BIGINT AS event_id, coalesce(a.name, n_name) AS name, a.note FROM nation LEFT JOIN a ON a.k = n_nationkey""")
def annotations_kept(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.lit("mine").alias("library_id"), F.lit("events").alias("kind"), k.cast("string").alias("item_id"), k, "n_name")
    keys = ["library_id", "kind", "item_id"]
    old = rows.where(k % 3 != 0).select(*keys, F.concat(F.lit("old "), k).alias("name"), F.lit(None).cast("string").alias("note"), F.lit("user").alias("name_source"))
    new = rows.where(k % 2 == 0).select(*keys, F.when(k % 4 == 0, F.concat(F.lit("new "), k)).otherwise(" ").alias("name"), F.concat(F.lit("note "), k).alias("note"), F.lit("llm").alias("name_source"), k.alias("ord"))
    path = f"{_folder(spark)}/annotations"
    files.write_annotations(narrative.upsert_annotations(old, new), path)
    items = rows.select("library_id", k.cast("long").alias("event_id"), F.col("n_name").alias("name"))
    return narrative.overlay(items, files.read_annotations(spark, path), "events", "event_id").select("event_id", "name", "note")


@_query("annotations_generated", """
SELECT 'events' AS kind, n_nationkey::VARCHAR AS item_id, n_name AS name, 'about ' || n_name AS note, 'template' AS name_source FROM nation
UNION ALL SELECT 'journeys', r_regionkey::VARCHAR, r_name, 'note', 'template' FROM region
UNION ALL SELECT 'people', s_suppkey::VARCHAR, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Person ' || (s_suppkey + 1) END, '2024-01-01 – 2024-02-02', CASE WHEN s_suppkey % 2 = 0 THEN 'user' ELSE 'auto' END FROM supplier""")
def annotations_generated(spark, sf_dir):
    lib, template = F.lit("mine").alias("library_id"), F.lit("template").alias("name_source")
    events = table(spark, sf_dir, "nation").select(lib, F.col("n_nationkey").alias("event_id"), F.col("n_name").alias("name"), F.concat(F.lit("about "), "n_name").alias("summary"), template)
    journeys = table(spark, sf_dir, "region").select(lib, F.col("r_regionkey").alias("journey_id"), F.col("r_name").alias("name"), F.lit("note").alias("note"), template)
    persons = table(spark, sf_dir, "supplier").select(lib, F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" ").alias("name"), F.lit("2024-01-01T10").alias("first_seen"), F.lit("2024-02-02T10").alias("last_seen"))
    return narrative.generated_annotations(events, journeys, persons).select("kind", "item_id", "name", "note", "name_source")


class _Echo:
    """An endpoint that tells what it was asked, until a fact says that it is down."""

    def __call__(self, request, timeout: float):
        import io

        asked = json.loads(request.data)
        facts = json.loads(asked["messages"][1]["content"])["facts"]
        told = {"name": facts["n_name"], "summary": f"{asked['model']} {asked['temperature']} {asked['response_format']['type']} {request.get_method()} {request.headers['Authorization']}"}
        if facts["n_regionkey"] == 2:
            del told["summary"]
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": json.dumps(told)}}]}).encode())


@_query("chat_answers", """SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'template' ELSE n_name END AS name, CASE WHEN n_regionkey = 2 THEN 'template' ELSE 'm 0.2 json_object POST Bearer k' END AS summary, CASE WHEN n_regionkey = 2 THEN 'template' ELSE 'llm' END AS name_source FROM nation""")
def chat_answers(spark, sf_dir):
    told = F.lit("template")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", told.alias("name"), told.alias("summary"), told.alias("name_source"))

    def backend():
        # A new breaker for each question: one that has failed would not ask for the others of its task.
        return lambda task, facts: narrative.chat_backend("http://host", "m", "k", opener=_Echo())(task, facts)

    return narrative.with_backend(rows, backend, "event_name_and_summary", ("name", "summary"), ["n_name", "n_regionkey"]).drop("n_name", "n_regionkey")


# --- query texts, indexes and a gazetteer -----------------------------------------------------------------------

@_query("query_prompts", """
WITH q AS (SELECT DISTINCT p_name AS q FROM part), s AS (SELECT q, 'raw_clip' AS strategy, [q] AS t FROM q
  UNION ALL SELECT q, 'prompt_ensemble', ['a photo of ' || q, 'a photograph of ' || q, 'an image showing ' || q, 'a picture of ' || q, 'a photo depicting ' || q] FROM q)
SELECT q, strategy, unnest(t) AS text FROM s""")
def query_prompts(spark, sf_dir):
    from lumenlake.functions import text

    asked = table(spark, sf_dir, "part").select(F.col("p_name").alias("q")).distinct()
    one = lambda s: asked.select("q", F.lit(s).alias("strategy"), F.explode(text.query_texts(F.col("q"), s)).alias("text"))
    return one("raw_clip").unionByName(one("prompt_ensemble"))


#: A stop word between what is no part of a word in any script; words that follow each other need a second pass.
_STOP = r"(?i)(^|[^\p{L}\p{N}_])(?:photos?|pictures?|images?|taken|captured|from|in)([^\p{L}\p{N}_]|$)"


@_query("semantic_texts", f"""
WITH q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Photos taken last  year in ' || text WHEN 1 THEN '2024 年拍摄的照片，' || text ELSE 'Photo from, ' END AS q, CASE doc_id % 3 WHEN 0 THEN 'last  year' WHEN 1 THEN '2024 年' END AS e FROM documents),
a AS (SELECT doc_id, q, CASE WHEN e IS NULL THEN q ELSE replace(q, e, ' ') END AS t FROM q),
b AS (SELECT doc_id, q, regexp_replace(regexp_replace(regexp_replace(t, '拍摄的|拍的|拍摄|照片|图片|相片|在', ' ', 'g'), '{_STOP}', '\\1 \\2', 'g'), '{_STOP}', '\\1 \\2', 'g') AS t FROM a),
c AS (SELECT doc_id, q, trim(regexp_replace(t, '\\s+', ' ', 'g'), ' ，,。.') AS t FROM b)
SELECT doc_id, CASE WHEN t = '' THEN trim(q) ELSE t END AS semantic FROM c""")
def semantic_texts(spark, sf_dir):
    which = F.col("doc_id") % 3
    q = F.when(which == 0, F.concat(F.lit("Photos taken last  year in "), "text")).when(which == 1, F.concat(F.lit("2024 年拍摄的照片，"), "text")).otherwise("Photo from, ")
    e = F.when(which == 0, "last  year").when(which == 1, "2024 年")
    return table(spark, sf_dir, "documents").select("doc_id", search_plan.semantic_column(q, e).alias("semantic"))


@_query("index_memory", """SELECT kind, (SELECT sum(len(embedding) * 4 + extra) FROM embeddings)::BIGINT AS memory_bytes FROM (VALUES ('exact', 0), ('faiss_flat', 0), ('hnsw', 64), ('qdrant', 64)) k(kind, extra)""")
def index_memory(spark, sf_dir):
    from lumenlake.operators.ann import Index

    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding")
    out = None
    for kind in ("exact", "faiss_flat", "hnsw", "qdrant"):
        row = Index(corpus, kind).memory_bytes().select(F.lit(kind).alias("kind"), "memory_bytes")
        out = row if out is None else out.unionByName(row)
    return out


_TOWN = "s_suppkey * 37 % 170 - 85 + 0.5::DOUBLE AS lat, s_suppkey * 101 % 360 - 180 + 0.5::DOUBLE AS lon"


@_query("nearest_towns", f"""
WITH g AS (SELECT s_name, {_TOWN} FROM supplier), p AS (SELECT o_custkey AS k, o_custkey * 53 % 178 - 89::DOUBLE AS latitude, o_custkey * 29 % 360 - 180::DOUBLE AS longitude FROM (SELECT DISTINCT o_custkey FROM orders)),
d AS (SELECT p.k, g.s_name, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(lat)) * pow(sin(radians(lon - longitude) / 2), 2), 1.0))) AS km FROM p, g)
SELECT k, round(min(km), 4) AS distance_km FROM d GROUP BY 1""")
def nearest_towns(spark, sf_dir):
    from lumenlake.operators import places

    k, s = F.col("o_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "orders").select(k.alias("k"), (k * 53 % 178 - 89).cast("double").alias("latitude"), (k * 29 % 360 - 180).cast("double").alias("longitude")).distinct()
    towns = table(spark, sf_dir, "supplier").select("s_name", (s * 37 % 170 - 85 + 0.5).cast("double").alias("lat"), (s * 101 % 360 - 180 + 0.5).cast("double").alias("lon"))
    return places.nearest(points, towns, ["k"], ("latitude", "longitude"), ("lat", "lon"), ["s_name"]).select("k", F.round("distance_km", 4).alias("distance_km"))


@_query("exif_times", f"""{PLACES_SQL} SELECT id, CASE WHEN id % 4 < 2 THEN strftime(captured_wall, '%Y-%m-%d %H:%M:%S') END AS wall FROM photos""")
def exif_times(spark, sf_dir):
    from lumenlake.functions import times

    wall, i = F.col("captured_wall"), F.col("id")
    text = F.when(i % 4 == 0, F.date_format(wall, "yyyy:MM:dd HH:mm:ss")).when(i % 4 == 1, F.date_format(wall, "yyyy/MM/dd HH:mm:ss")).when(i % 4 == 2, "0000:00:00 00:00:00")
    return places_and_times(spark, sf_dir).select("id", F.date_format(times.exif_time(text), "yyyy-MM-dd HH:mm:ss").alias("wall"))
