"""Small photo libraries for tests."""

from pyspark.sql import functions as F

from lumenlake.sources.schema import with_times

PHOTO = ("library_id string, ord bigint, id string, captured_at string, captured_at_source string, latitude double, longitude double, gps_source string, embedding array<double>, "
         "phash_hi bigint, phash_lo bigint, score double, source string, path string, original_filename string")


def photos(spark, *rows, library="L"):
    """Photos from dicts; ids are letters unless given."""
    names = [c.split()[0] for c in PHOTO.replace("array<double>", "x").split(", ")]
    full = []
    for i, r in enumerate(rows):
        base = {"library_id": library, "ord": i, "id": chr(97 + i), "captured_at_source": "exif", "source": "local"} | r
        full.append(tuple(base.get(n) for n in names))
    return with_times(spark.createDataFrame(full, PHOTO))


def groups(members, key="event_id", ident="id"):
    """The ids of each group, in the groups' order."""
    out = {}
    for r in members.collect():
        out.setdefault(r[key], []).append(r[ident])
    return [sorted(out[k]) for k in sorted(out)]


def col(df, name):
    return [r[name] for r in df.select(F.col(name)).collect()]
