"""Near-identical shots: pairs by hash or vector within a time gate, their groups and the best shot of each."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import vector
from lumenlake.operators import blocks
from lumenlake.operators.components import connected_components
from lumenlake.operators.events import group_by_components


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def hamming_text(a: Column, b: Column) -> Column:
    """Differing places of two bit strings, plus the difference of their lengths."""
    n = F.least(F.length(a), F.length(b))
    chars = lambda s: F.slice(F.split(s, ""), 1, n)
    differing = F.size(F.filter(F.arrays_zip(chars(a).alias("x"), chars(b).alias("y")), lambda p: p["x"] != p["y"]))
    return differing + F.abs(F.length(a) - F.length(b))


_COLUMNS = ("library_id", "id", "ord", "captured_epoch", "phash_hi", "phash_lo", "embedding")


def _rows(photos: DataFrame) -> DataFrame:
    return photos.select(*_COLUMNS).select("library_id", blocks.node().alias("node"), "id", F.col("ord").cast("long").alias("ord"), "captured_epoch", "phash_hi", "phash_lo", vector.as_double(F.col("embedding")).alias("embedding"))


def alike_rule(phash_distance: int, similarity: float, window_seconds: float, require_time: bool) -> blocks.Rule:
    """Two photos that look alike, by hash or vector, and pass the time gate: within the window, or a time is missing."""
    def rule(rows: blocks.Rows, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (blocks.bits_apart(rows, a, b, ("phash_hi", "phash_lo")) <= phash_distance) | (blocks.cosine(rows, a, b) >= similarity)
        return out & ~(blocks.apart(rows, a, b, "captured_epoch") > window_seconds) if require_time else out

    return rule


def _placement(window_seconds: float, require_time: bool) -> dict:
    """Photos with a time meet within the window, the others (and all, without a gate) meet all."""
    return {"loose": F.col("captured_epoch").isNull(), "at": F.col("captured_epoch"), "width": max(window_seconds, 1e-6)} if require_time else {}


#: Bands of a hash, bits of one, and the most bits in which a band may differ for hashes to be sought by their bands.
BANDS, BAND_BITS, MOST_PROBED = 4, 16, 2


def _bands(hi: Column, lo: Column) -> list[Column]:
    low = (1 << BAND_BITS) - 1
    return [F.shiftright(hi, BAND_BITS), hi.bitwiseAND(F.lit(low)), F.shiftright(lo, BAND_BITS), lo.bitwiseAND(F.lit(low))]


def near_hashes(hashes: DataFrame, distance: int) -> DataFrame:
    """(library_id, a_hi, a_lo, b_hi, b_lo): every two different hashes of a library within a distance, once, a before b.

    Of two hashes within d bits, one of the bands differs in at most a quarter of d.  So each hash is kept at the values
    of its bands and seeks at all values within that many bits of them; two that meet at several bands count at the first.
    """
    radius = distance // BANDS
    masks = [sum(1 << k for k in bits) for n in range(radius + 1) for bits in combinations(range(BAND_BITS), n)]
    named = hashes.select("library_id", F.col("phash_hi").alias("hi"), F.col("phash_lo").alias("lo")).distinct()
    kept = named.select("library_id", F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), F.posexplode(F.array(*_bands(F.col("hi"), F.col("lo")))).alias("band", "value"))
    sought = named.select("library_id", F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.posexplode(F.array(*_bands(F.col("hi"), F.col("lo")))).alias("band", "own"))
    sought = sought.select("library_id", "a_hi", "a_lo", "band", F.explode(F.lit(masks)).alias("mask"), "own").withColumn("value", F.col("own").bitwiseXOR(F.col("mask").cast("long"))).drop("mask", "own")
    met = sought.join(kept, ["library_id", "band", "value"])
    a, b = F.struct("a_hi", "a_lo"), F.struct("b_hi", "b_lo")
    earlier = F.lit(True)
    for k, (x, y) in enumerate(zip(_bands(F.col("a_hi"), F.col("a_lo")), _bands(F.col("b_hi"), F.col("b_lo")), strict=True)):
        earlier &= (F.col("band") <= k) | (F.bit_count(x.bitwiseXOR(y)) > radius)
    return met.where((a < b) & (hamming(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo")) <= distance) & earlier).select("library_id", "a_hi", "a_lo", "b_hi", "b_lo")


def _by_bands(rows: DataFrame, phash_distance: int, require_time: bool) -> bool:
    """Whether hashes are sought by their bands: without a time gate, where a library is larger than a tile."""
    return not require_time and 0 <= phash_distance // BANDS <= MOST_PROBED and blocks.has_large(rows)


def _likeness(similarity: float) -> blocks.Rule:
    return lambda rows, a, b: blocks.cosine(rows, a, b) >= similarity


def similar_pairs(photos: DataFrame, phash_distance: int = 10, similarity: float = 0.90, window_seconds: float = 30.0, require_time: bool = True) -> DataFrame:
    """(library_id, left_id, left_ord, right_id, right_ord) of photos that look alike and pass the time gate."""
    rows = _rows(photos)
    if not _by_bands(rows, phash_distance, require_time):
        return blocks.pairs(rows, alike_rule(phash_distance, similarity, window_seconds, require_time), **_placement(window_seconds, require_time))
    seen = blocks.pairs(rows, _likeness(similarity), alike=("embedding", similarity))
    hashed = rows.where("phash_hi IS NOT NULL AND phash_lo IS NOT NULL").select("library_id", "id", "ord", "phash_hi", "phash_lo")
    side = lambda x, h: hashed.select("library_id", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "ord")), F.col("phash_hi").alias(f"{h}_hi"), F.col("phash_lo").alias(f"{h}_lo"))
    other = near_hashes(hashed, phash_distance).join(side("x", "a"), ["library_id", "a_hi", "a_lo"]).join(side("y", "b"), ["library_id", "b_hi", "b_lo"])
    same = side("x", "a").join(side("y", "a"), ["library_id", "a_hi", "a_lo"]).where("x_ord < y_ord")
    ends = ["library_id", "x_id", "x_ord", "y_id", "y_ord"]
    both, first = other.select(*ends).unionByName(same.select(*ends)), F.col("x_ord") < F.col("y_ord")
    turned = both.select("library_id", *(F.when(first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"left_{c}") for c in ("id", "ord")), *(F.when(first, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(f"right_{c}") for c in ("id", "ord")))
    return seen.unionByName(turned.select(*seen.columns)).distinct()


def _components(rows: DataFrame, phash_distance: int, similarity: float, window_seconds: float, require_time: bool) -> DataFrame:
    """(id, component) of photos that look alike; photos of one hash are linked to the first of them, not to each other."""
    if not _by_bands(rows, phash_distance, require_time):
        return blocks.linked(rows, alike_rule(phash_distance, similarity, window_seconds, require_time), **_placement(window_seconds, require_time))
    seen = blocks.linked(rows, _likeness(similarity), alike=("embedding", similarity)).select(F.col("id").alias("u"), F.col("component").alias("v"))
    hashed = rows.where("phash_hi IS NOT NULL AND phash_lo IS NOT NULL")
    heads = hashed.groupBy("library_id", "phash_hi", "phash_lo").agg(F.min("node").alias("head"))
    stars = hashed.select("library_id", "phash_hi", "phash_lo", F.col("node").alias("u")).join(heads, ["library_id", "phash_hi", "phash_lo"]).select("u", F.col("head").alias("v"))
    head = lambda h, x: heads.select("library_id", F.col("phash_hi").alias(f"{h}_hi"), F.col("phash_lo").alias(f"{h}_lo"), F.col("head").alias(x))
    near = near_hashes(hashed, phash_distance).join(head("a", "u"), ["library_id", "a_hi", "a_lo"]).join(head("b", "v"), ["library_id", "b_hi", "b_lo"]).select("u", "v")
    return connected_components(seen.unionByName(stars).unionByName(near))


def similar_groups(photos: DataFrame, phash_distance: int = 10, similarity: float = 0.90, window_seconds: float = 30.0, require_time: bool = True) -> DataFrame:
    """Members of groups of two or more: photos with group_id, numbered by the first member, and representative_id."""
    found = _components(_rows(photos), phash_distance, similarity, window_seconds, require_time)
    grouped = photos.withColumn("__node", blocks.node()).join(found.select(F.col("id").alias("__node")), "__node", "left_semi").drop("__node")
    return with_best_shot(group_by_components(grouped, found, "group_id"))


def with_best_shot(members: DataFrame) -> DataFrame:
    """members with the id of the group's best score; a missing score is 0, the first of equals wins."""
    order = Window.partitionBy("library_id", "group_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord")
    return members.withColumn("representative_id", F.first("id").over(order))


def best_shots(photos: DataFrame, limit: int = 20) -> DataFrame:
    """The best photos of all; limit is held to 1..200."""
    return photos.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord").limit(max(1, min(200, limit)))


def best_shot_by_group(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """Of groups (library_id, group_id, photo_id) the best photo; members that are not photos are passed over."""
    members = groups.join(photos.select("library_id", F.col("id").alias("photo_id"), "ord", "score"), ["library_id", "photo_id"])
    order = Window.partitionBy("library_id", "group_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord")
    return members.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
