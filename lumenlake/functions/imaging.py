"""Measures of decoded images: arrays of height x width x channels in BGR order, as Spark's image source gives them.

All are numpy functions of one image; `image_features` runs them over a column in Arrow batches.  Images are reduced
by block means, which is this library's own choice of resampling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 256


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an image, 0 to 255."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2]).astype(np.float64)
    return image[:, :, 2] * 0.299 + image[:, :, 1] * 0.587 + image[:, :, 0] * 0.114


def shrink(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over a grid of height x width areas, fractions of pixels included."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        low, high = np.arange(n), np.arange(n) + 1
        w = np.clip(np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low), 0, None)
        return w / w.sum(1, keepdims=True)

    rows = np.tensordot(weights(values.shape[0], height), values, axes=(1, 0))
    return np.moveaxis(np.tensordot(weights(values.shape[1], width), rows, axes=(1, 1)), 0, 1)


def phash(image: np.ndarray, size: int = 8) -> str:
    """Bits of the low frequencies that reach their median, row by row."""
    n = 4 * size
    pixels = shrink(gray(image), n, n)
    wave = np.cos(np.pi * np.outer(np.arange(n) + 0.5, np.arange(n)) / n)
    low = wave[:size] @ pixels @ wave[:size].T
    return "".join("01"[int(b)] for b in (low >= np.median(low[1:, 1:])).ravel())


def sharpness(image: np.ndarray) -> float:
    """Variance of the Laplacian, with mirrored borders; 0 for an image that cannot be read."""
    if image.size == 0:
        return 0.0
    g = np.pad(gray(image), 1, mode="reflect" if min(image.shape[:2]) > 1 else "edge")
    edges = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(edges.var())


def exposure(image: np.ndarray) -> float:
    """1 less half the share of pixels that are nearly black or nearly white."""
    g = gray(image) / 255.0
    return max(0.0, 1.0 - 0.5 * (float((g < 0.05).mean()) + float((g > 0.95).mean())))


def composition(image: np.ndarray) -> float:
    """How near the centre of edge energy is to a point of the rule of thirds, and how much of the image has edges."""
    g = np.round(shrink(gray(image), 128, 128) / 255.0, 9)  # or the noise of rounding would count as edges
    energy = np.abs(np.diff(g, axis=1, prepend=g[:, :1])) + np.abs(np.diff(g, axis=0, prepend=g[:1])) + 1e-6
    places = np.arange(128) / 127.0
    x, y = (energy.sum(0) @ places) / energy.sum(), (energy.sum(1) @ places) / energy.sum()
    distance = min(np.hypot(x - a, y - b) for a in (1 / 3, 2 / 3) for b in (1 / 3, 2 / 3))
    spread = min(1.0, 4.0 * float((energy > np.quantile(energy, 0.75)).mean()))
    return float(0.75 * max(0.0, 1.0 - distance / 0.48) + 0.25 * spread)


def hash_vector(image: np.ndarray, content: bytes) -> np.ndarray:
    """Colour means and deviations, overall and in 4 x 4 blocks, tiled to DIM, plus noise from the file's SHA-256."""
    rgb = shrink(image[:, :, ::-1] if image.ndim == 3 and image.shape[2] >= 3 else np.repeat(gray(image)[:, :, None], 3, 2), 32, 32)[:, :, :3] / 255.0
    blocks = [b.mean((0, 1)) for row in np.array_split(rgb, 4, 0) for b in np.array_split(row, 4, 1)]
    out = np.resize(np.concatenate([rgb.mean((0, 1)), rgb.std((0, 1)), *blocks]), DIM)
    for i, byte in enumerate(hashlib.sha256(content).digest()):
        out[17 * i % DIM] += (byte - 127.5) / 127.5
    n = np.linalg.norm(out)
    return out / n if n > 0 else out


def upper_body(image: np.ndarray, box: list[float]) -> list[float]:
    """A colour histogram of 8 bins per channel of what is below a face, at unit length; empty if that is nothing."""
    if len(box) < 4:
        return []
    x1, y1, x2, y2 = box[:4]
    w, h = max(x2 - x1, 1.0), max(y2 - y1, 1.0)
    crop = image[max(0, int(y2)) : min(image.shape[0], int(y2 + 3 * h)), max(0, int(x1 - 0.6 * w)) : min(image.shape[1], int(x2 + 0.6 * w))]
    if crop.size == 0:
        return []
    out = np.concatenate([np.histogram(crop[:, :, c], bins=8, range=(0, 256))[0] for c in range(min(crop.shape[2], 3))]).astype(float)
    n = np.linalg.norm(out)
    return (out / n).tolist() if n > 1e-12 else []


def cover_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The square around a face, 2.2 times its longer side, held inside the image: left, top, right, bottom."""
    side = 2.2 * F.greatest(x2 - x1, y2 - y1)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    return F.struct(F.greatest(F.lit(0), F.floor(cx - side / 2)).cast("int").alias("left"), F.greatest(F.lit(0), F.floor(cy - side / 2)).cast("int").alias("top"),
                    F.least(width, F.ceil(cx + side / 2)).cast("int").alias("right"), F.least(height, F.ceil(cy + side / 2)).cast("int").alias("bottom"))


def image_features(images: DataFrame) -> DataFrame:
    """images (Spark's image column `image`, and `content`, the file's bytes) with phash, embedding and raw measures."""

    def measure(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for decoded, contents in batches:
            rows = []
            for r, content in zip(decoded.itertuples(), contents, strict=True):
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels) if r.height and r.height > 0 else np.zeros((0, 0, 3), np.uint8)
                if image.size == 0:
                    rows.append((None, [], 0.0, 0.0, 0.0))
                else:
                    rows.append((phash(image), hash_vector(image, bytes(content or b"")).tolist(), sharpness(image), exposure(image), composition(image)))
            yield pd.DataFrame(rows, columns=["phash", "embedding", "sharpness", "exposure_score", "composition_score"])

    udf = F.pandas_udf(measure, "phash string, embedding array<double>, sharpness double, exposure_score double, composition_score double")
    return images.withColumn("features", udf(F.struct("image.height", "image.width", "image.nChannels", "image.data"), F.col("content")))


def _pixels(row) -> np.ndarray:
    """The pixels of a row of Spark's image column; none if it could not be decoded."""
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels) if row.height and row.height > 0 else np.zeros((0, 0, 3), np.uint8)


class HashEncoder:
    """Vectors from colours and digests, for libraries without a model."""

    def encode_image(self, image: np.ndarray, content: bytes) -> list[float]:
        return hash_vector(image, content).tolist()

    def encode_text(self, text: str) -> list[float]:
        from lumenlake.functions.text import hash_vector as of_text

        return of_text(text)


#: Kinds of encoders and how to make one; a model is registered here under a name of its own.
ENCODERS: dict[str, Callable[[], object]] = {"hash": HashEncoder}


def create_encoder(kind: str = "hash"):
    """An encoder with encode_image(pixels, bytes) and encode_text(text)."""
    if kind not in ENCODERS:
        raise ValueError(f"unknown encoder: {kind}")
    return ENCODERS[kind]()


def encode_images(images: DataFrame, make_encoder: Callable[[], object] = HashEncoder, into: str = "embedding") -> DataFrame:
    """images (image, content) with the vectors of an encoder, which is made once for each task; none if not decoded."""

    def encode(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for decoded, contents in batches:
            out = []
            for r, content in zip(decoded.itertuples(), contents, strict=True):
                pixels = _pixels(r)
                out.append([float(x) for x in encoder.encode_image(pixels, bytes(content or b""))] if pixels.size else [])
            yield pd.Series(out, dtype=object)

    udf = F.pandas_udf(encode, "array<double>")
    return images.withColumn(into, udf(F.struct("image.height", "image.width", "image.nChannels", "image.data"), F.col("content")))


def detect_faces(images: DataFrame, make_detector: Callable[[], object]) -> DataFrame:
    """(the other columns of images, position, bbox, embedding, det_score, appearance_embedding) of every face.

    make_detector gives an object whose detect(pixels) returns (box, vector, score) for each face; it is made once for
    each task.  The appearance is what the image shows below the face.
    """
    kind = "array<struct<bbox: array<double>, embedding: array<double>, det_score: double, appearance_embedding: array<double>>>"

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        detector = make_detector()
        for decoded in batches:
            out = []
            for r in decoded.itertuples():
                pixels = _pixels(r)
                found = detector.detect(pixels) if pixels.size else []
                out.append([{"bbox": [float(x) for x in box], "embedding": [float(x) for x in v], "det_score": float(score), "appearance_embedding": upper_body(pixels, list(box))} for box, v, score in found])
            yield pd.Series(out, dtype=object)

    rest = [c for c in images.columns if c not in ("image", "content")]
    udf = F.pandas_udf(detect, kind)
    faces = images.select(*rest, F.posexplode(udf(F.struct("image.height", "image.width", "image.nChannels", "image.data"))).alias("position", "face"))
    return faces.select(*rest, "position", "face.*")
