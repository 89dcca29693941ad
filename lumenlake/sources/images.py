"""Image files: listing, metadata, uploads and preparation of a data set."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.functions import times
from lumenlake.functions.lineage import durable
from lumenlake.functions.imaging import image_features
from lumenlake.operators.quality import total

#: Suffixes of images, for indexing and for preparation; most bytes of an upload.
SUFFIXES, PREPARED_SUFFIXES, MOST_BYTES = ("jpg", "jpeg", "png", "webp", "tif", "tiff"), ("jpg", "jpeg", "png", "webp", "tif", "tiff", "heic", "heif"), 100 << 20
#: Tags of the Exif directories.
_WIDTH, _HEIGHT, _MAKE, _MODEL, _DATETIME, _EXIF, _GPS, _ORIGINAL = 256, 257, 271, 272, 306, 34665, 34853, 36867
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def has_suffix(path: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(suffixes)})$")


def photo_id(path: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the path, without its scheme."""
    return F.substring(F.sha1(F.regexp_replace(path, "^file:/+", "/")), 1, 16)


def list_images(spark: SparkSession, directory: str, content: bool = True) -> DataFrame:
    """path, id, modificationTime, length (and content) of the images below a directory."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).where(has_suffix(F.col("path")))
    return found.withColumn("id", photo_id(F.col("path"))) if content else found.select("path", "modificationTime", "length", photo_id(F.col("path")).alias("id"))


def _tiff_block(content: bytes) -> bytes:
    """The TIFF directories in which a file's Exif data are: a TIFF file itself, or a block of a JPEG, PNG or WebP file."""
    if content[:4] in (b"II*\x00", b"MM\x00*"):
        return content
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size, kind = struct.unpack_from(">I4s", content, at)
            if kind == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
        return b""
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(content):
            kind, size = struct.unpack_from("<4sI", content, at)
            if kind == b"EXIF":
                return content[at + 8 : at + 8 + size].removeprefix(b"Exif\x00\x00")
            at += 8 + size + size % 2
        return b""
    at = content.find(b"Exif\x00\x00", 0, 1 << 16)
    return content[at + 6 :] if at >= 0 else b""


def _directory(tiff: bytes, offset: int) -> dict[int, object]:
    order, out = "<" if tiff[:2] == b"II" else ">", {}
    for k in range(struct.unpack_from(f"{order}H", tiff, offset)[0]):
        tag, kind, n = struct.unpack_from(f"{order}HHI", tiff, offset + 2 + 12 * k)
        start = offset + 10 + 12 * k
        if _SIZES.get(kind, 0) * n > 4:
            start = struct.unpack_from(f"{order}I", tiff, start)[0]
        if kind == 2:
            out[tag] = tiff[start : start + n].split(b"\x00")[0].decode("utf-8", "replace")
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", tiff, start)[0] if n else 0
        elif kind in (5, 10):
            parts = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", tiff, start)
            out[tag] = [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return out


def image_size(content: bytes) -> tuple[int, int]:
    """(width, height) as the header of a JPEG, PNG, WebP or TIFF file states them; (0, 0) if it cannot be read."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", content, 16)
        if content[:4] in (b"II*\x00", b"MM\x00*"):
            top = _directory(content, struct.unpack_from("<I" if content[:2] == b"II" else ">I", content, 4)[0])
            return int(top.get(_WIDTH, 0)), int(top.get(_HEIGHT, 0))
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            kind = content[12:16]
            if kind == b"VP8X":
                return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
            if kind == b"VP8L":
                bits = int.from_bytes(content[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            return struct.unpack_from("<H", content, 26)[0] & 0x3FFF, struct.unpack_from("<H", content, 28)[0] & 0x3FFF
        at = 2 if content[:2] == b"\xff\xd8" else len(content)
        while at + 9 <= len(content):
            marker, size = struct.unpack_from(">xBH", content, at)
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", content, at + 5)
                return width, height
            at += 2 + size
    except (struct.error, IndexError, TypeError, ValueError):
        pass
    return 0, 0


def read_exif(content: bytes) -> dict:
    """Capture time, make, model and coordinates (as written) of an image file's Exif data; empty if there are none."""
    try:
        if not (tiff := _tiff_block(content)):
            return {}
        top = _directory(tiff, struct.unpack_from("<I" if tiff[:2] == b"II" else ">I", tiff, 4)[0])
        inner, gps = (_directory(tiff, top[t]) if t in top else {} for t in (_EXIF, _GPS))
        return {"taken": inner.get(_ORIGINAL) or top.get(_ORIGINAL) or top.get(_DATETIME), "make": top.get(_MAKE), "model": top.get(_MODEL),
                "lat": gps.get(2), "lat_ref": gps.get(1), "lon": gps.get(4), "lon_ref": gps.get(3)}
    except (struct.error, IndexError, KeyError, TypeError):
        return {}


def coordinate(parts: Column, ref: Column) -> Column:
    """Degrees of (degrees, minutes, seconds); south and west are negative; null unless there are three parts."""
    value = parts[0] + parts[1] / 60.0 + parts[2] / 3600.0
    return F.when(F.size(parts) == 3, F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value))


def with_metadata(images: DataFrame) -> DataFrame:
    """images (content, modificationTime) with width, height, captured_at, its source, camera and place."""
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            rows = [read_exif(bytes(c)) if c is not None else {} for c in contents]
            sizes = [image_size(bytes(c)) if c is not None else (0, 0) for c in contents]
            yield pd.DataFrame({k: [r.get(k) for r in rows] for k in ("taken", "make", "model", "lat", "lat_ref", "lon", "lon_ref")} | {"width": [w for w, _ in sizes], "height": [h for _, h in sizes]}, dtype=object)

    exif = F.pandas_udf(parse, "taken string, make string, model string, lat array<double>, lat_ref string, lon array<double>, lon_ref string, width int, height int")
    rows = images.withColumn("__x", exif("content")).withColumn("width", F.col("__x.width")).withColumn("height", F.col("__x.height"))
    taken = F.date_format(times.exif_time(F.col("__x.taken")), "yyyy-MM-dd'T'HH:mm:ss")
    rows = rows.withColumn("captured_at", F.coalesce(taken, F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss"))).withColumn("captured_at_source", F.when(taken.isNotNull(), "exif").otherwise("filesystem"))
    rows = rows.withColumn("camera", F.nullif(F.trim(F.concat_ws(" ", F.trim("__x.make"), F.trim("__x.model"))), F.lit("")))
    rows = rows.withColumn("latitude", coordinate(F.col("__x.lat"), F.col("__x.lat_ref"))).withColumn("longitude", coordinate(F.col("__x.lon"), F.col("__x.lon_ref")))
    return rows.withColumn("gps_source", F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "exif")).drop("__x")


def index_directory(spark: SparkSession, directory: str, library_id: str, existing: DataFrame | None = None) -> DataFrame:
    """Photos of a directory's images, all computed anew; of existing ones only source fields and names are kept.

    Images are decoded by Spark's image source and measured in Arrow batches next to it; of files that it cannot decode
    (WebP, some TIFF) sizes and metadata come from their headers, and they have no vector.
    """
    files = with_metadata(list_images(spark, directory))
    decoded = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(directory).select(F.col("image.origin").alias("path"), "image").where(has_suffix(F.col("path")))
    # The two sources spell a local path with one or three slashes.
    key = F.regexp_replace("path", "^file:/+", "/")
    rows = image_features(files.withColumn("path", key).join(decoded.withColumn("path", key), "path", "left"))
    q = total(F.col("features.sharpness"), F.col("features.exposure_score"), F.lit(0.5), F.col("features.composition_score"))
    out = rows.select(
        F.lit(library_id).alias("library_id"), "id", "path", "width", "height",
        "captured_at", "captured_at_source", "latitude", "longitude", "gps_source", "camera", F.col("features.embedding").cast("array<float>").alias("embedding"), F.col("features.phash").alias("phash"), q.alias("quality"))
    out = out.withColumn("ord", (F.row_number().over(Window.partitionBy("library_id").orderBy("path")) - 1).cast("long"))
    if existing is None:
        return out.withColumn("source", F.lit("local")).withColumn("source_updated_at", F.lit(None).cast("string")).withColumn("original_filename", F.lit(None).cast("string"))
    return out.join(existing.select("id", "source", "source_updated_at", "original_filename"), "id", "left").withColumn("source", F.coalesce("source", F.lit("local")))


def safe_path(path: Column) -> Column:
    """Whether an upload's path stays below its folder: relative, not empty, without parent steps."""
    clean = F.regexp_replace(F.trim(path), r"\\", "/")
    parts = F.split(clean, "/")
    return F.coalesce((clean != "") & ~clean.rlike("^(/|[A-Za-z]:)") & ~F.array_contains(parts, "..") & (F.size(F.filter(parts, lambda p: ~p.isin("", "."))) > 0), F.lit(False))


def sort_uploads(uploads: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """uploads (path, length) with the reason why one is rejected, null for those that are accepted."""
    return uploads.withColumn("rejected", F.when(~safe_path(F.col("path")), "unsafe path").when(~has_suffix(F.col("path")), "unsupported type").when(F.col("length") > most_bytes, "too large"))


def numbered(rows: DataFrame, order: list[Column], into: str = "n") -> DataFrame:
    """rows with their number, from 1, in an order of all of them: ranges are numbered apart and shifted by their sizes."""
    ranged = durable(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))  # a row per partition
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__range").withColumn(into, F.col("__before") + F.col("__within")).drop("__range", "__before", "__within")


def prepare_manifest(images: DataFrame, root: str, reencode=None) -> DataFrame:
    """Numbered output names, digests and metadata of a source folder's images, in order of their folded paths.

    reencode, if given, is a column function from content to the bytes of the output file.
    """
    prefix = root.rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(prefix)), F.substring("path", len(prefix) + 1, 1 << 30)).otherwise(F.col("path"))
    rows = images.where(has_suffix(F.col("path"), PREPARED_SUFFIXES)).withColumn("source_file", relative)
    out = F.col("content") if reencode is None else reencode(F.col("content"))
    return numbered(rows, [F.lower("source_file"), F.col("source_file")]).select("source_file", F.format_string("%06d.jpg", F.col("n")).alias("output_file"), F.upper(F.element_at(F.split("path", r"\."), -1)).alias("source_format"),
                                               F.sha2("content", 256).alias("source_sha256"), F.sha2(out, 256).alias("output_sha256"), "captured_at", "captured_at_source", "latitude", "longitude", "gps_source")


def metadata_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(output_file, metadata_preserved): capture times equal and coordinates within a millionth of a degree."""
    close = lambda c: F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) | (F.abs(F.col(f"b.{c}") - F.col(f"a.{c}")) <= 1e-6)
    same = F.col("b.captured_at").eqNullSafe(F.col("a.captured_at")) & F.coalesce(close("latitude"), F.lit(False)) & F.coalesce(close("longitude"), F.lit(False))
    return before.alias("b").join(after.alias("a"), "output_file").select("output_file", same.alias("metadata_preserved"))
