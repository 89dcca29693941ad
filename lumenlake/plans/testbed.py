"""The photo library that the registered queries see: a fixed view over the driver's events and embeddings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How much of a photo's vector is its own; the rest is what its library's photos have in common.
OWN = 0.5


#: Tables whose rows cost much to work on.
_HEAVY = ("events", "documents", "embeddings", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; of a single small file Spark would make one task, so its rows are dealt out first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.sparkContext.defaultParallelism
    return rows.repartition(wanted) if name in _HEAVY and rows.rdd.getNumPartitions() < wanted else rows


def sign_words(embedding="embedding") -> tuple:
    """The signs of a vector's 64 components as two numbers of 32 bits."""
    bits = F.transform(embedding, lambda x: F.when(x > 0, "1").otherwise("0"))
    half = lambda at: F.conv(F.array_join(F.slice(bits, at, 32), ""), 2, 10).cast("long")
    return half(1).alias("phash_hi"), half(33).alias("phash_lo")


def places_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo per event row, without its vector."""
    e = table(spark, sf_dir, "events")
    away = F.dayofmonth("ts") % 7 >= 5
    no_gps = F.col("event_id") % 11 == 0
    third, seventh = F.col("user_id") % 3 * 10, F.col("event_id") % 7 * F.lit(0.01)
    return e.select(
        F.col("user_id").alias("library_id"), F.col("event_id").alias("ord"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("captured_wall"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("captured_epoch"),
        F.when(F.col("event_id") % 5 == 0, "filesystem").otherwise("exif").alias("captured_at_source"), F.when(F.col("event_id") % 4 == 0, "manual").otherwise("exif").alias("gps_source"),
        F.when(~no_gps, F.when(away, F.lit(22.3) + third).otherwise(F.lit(30.6)) + seventh).alias("latitude"), F.when(~no_gps, F.when(away, F.lit(114.2) + third).otherwise(F.lit(104.0)) + seventh).alias("longitude"),
        (F.col("value") / (F.col("value") + 20)).alias("score"), F.col("event_type"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo per event row: events are the timeline.

    Vectors are sums of two of the whole embeddings table, one that the library's photos share and OWN of one picked by
    the event; ids go round the table.  Their signs are the hash.
    """
    rows = places_and_times(spark, sf_dir)
    m = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    many = F.broadcast(m.agg(F.count("*").alias("many")))  # one row
    mine, own = (m.select(F.col("vec_id").alias(f"{k}_id"), F.col("embedding").alias(k)) for k in ("shared", "own"))
    # A library's vector meets its photos where they are dealt by library, as most rules want them; so of a vector only the
    # photo's own half is sent there, and it is added up behind the shuffle.
    libraries = rows.select("library_id").distinct().crossJoin(many).withColumn("shared_id", F.col("library_id") % F.col("many")).join(mine, "shared_id").select("library_id", "shared")
    joined = rows.crossJoin(many).withColumn("own_id", F.col("id") % F.col("many")).drop("many").join(own, "own_id", "left").join(libraries.hint("shuffle_hash"), "library_id", "left")
    v = F.zip_with("shared", "own", lambda a, b: a.cast("double") + OWN * b.cast("double"))
    made = joined.withColumn("embedding", v).drop("own_id", "shared", "own")
    return made.select("*", *sign_words())


_PLAIN = """SELECT e.user_id AS library_id, e.event_id AS ord, e.event_id AS id, e.ts::TIMESTAMP AS captured_wall, epoch_us(e.ts) / 1e6 AS captured_epoch,
    CASE WHEN e.event_id % 5 = 0 THEN 'filesystem' ELSE 'exif' END AS captured_at_source, CASE WHEN e.event_id % 4 = 0 THEN 'manual' ELSE 'exif' END AS gps_source,
    CASE WHEN e.event_id % 11 <> 0 THEN (CASE WHEN day(e.ts) % 7 >= 5 THEN 22.3::DOUBLE + (e.user_id % 3) * 10 ELSE 30.6::DOUBLE END) + (e.event_id % 7) * 0.01::DOUBLE END AS latitude,
    CASE WHEN e.event_id % 11 <> 0 THEN (CASE WHEN day(e.ts) % 7 >= 5 THEN 114.2::DOUBLE + (e.user_id % 3) * 10 ELSE 104.0::DOUBLE END) + (e.event_id % 7) * 0.01::DOUBLE END AS longitude,
    e.value / (e.value + 20) AS score, e.event_type FROM events e"""

#: The same views in DuckDB's SQL, as the first common table expressions of a query.
PLACES_SQL = f"""
WITH photos AS ({_PLAIN})
"""
PHOTOS_SQL = f"""
WITH plain AS ({_PLAIN}),
summed AS (SELECT p.*, list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE + {OWN}::DOUBLE * x[2]::DOUBLE) AS embedding
  FROM plain p CROSS JOIN (SELECT count(*) AS many FROM embeddings) n LEFT JOIN embeddings a ON a.vec_id = p.library_id % n.many LEFT JOIN embeddings b ON b.vec_id = p.id % n.many),
photos AS (SELECT *, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS phash FROM summed)
"""

#: DuckDB macros cannot be assumed, so shared expressions are texts with places for two sides.
COSINE_SQL = "(list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1e-12))"
_HALVES = "pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)"
HAVERSINE_SQL = f"(2 * 6371.0 * asin(sqrt(CASE WHEN {_HALVES} > 1 THEN 1 ELSE {_HALVES} END)))"


def cosine_sql(a: str, b: str) -> str:
    return COSINE_SQL.format(a=a, b=b)


def haversine_sql(a: str, b: str) -> str:
    return HAVERSINE_SQL.format(a=a, b=b)
