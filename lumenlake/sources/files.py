"""Tables as files: indexes, label sheets, remote assets, projects and exports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenlake.sources import schema


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A Parquet table with at least the given columns (missing ones null); no rows if there is none."""
    kind = schema.parsed(ddl)
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or "") and "UNABLE_TO_INFER_SCHEMA" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], kind)
    return found.select(*(F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields), *(c for c in found.columns if c not in kind.names))


def write_photos(photos: DataFrame, path: str) -> None:
    """Replaces the index; one folder per library, so a library's queries read only its own."""
    photos.write.mode("overwrite").partitionBy("library_id").parquet(path)


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    return schema.with_times(read_table(spark, path, schema.PHOTOS))


def read_json_index(spark: SparkSession, path: str, library_id: str, lines: bool = False) -> DataFrame:
    """A JSON array of photos, or a folder of files with one photo in a line; quality may lack fields, and positions in the
    array are not kept by Spark: ord is by id."""
    kind = StructType([f for f in schema.parsed(schema.PHOTOS).fields if f.name not in ("library_id", "ord")])
    rows = spark.read.schema(kind).json(path, multiLine=not lines).withColumn("library_id", F.lit(library_id)).withColumn("source", F.coalesce("source", F.lit("local")))
    return schema.with_times(rows.withColumn("ord", (F.row_number().over(Window.partitionBy("library_id").orderBy("id")) - 1).cast("long")))


#: The tables of a people folder, as write_people writes them.
_PEOPLE = {"faces": schema.FACES.replace("library_id string, ", ""), "persons": "id bigint, prototype array<double>, name string", "person_faces": "person_id bigint, face_id string",
           "person_photos": "person_id bigint, photo_id string", "removed": "person_id bigint, photo_id string", "noise": "face_id string"}


def write_people(people: dict[str, DataFrame], faces: DataFrame, path: str) -> None:
    """The people of one library as a folder: each table in files of its own, a row in a line; nothing is gathered."""
    tables = {k: v for k, v in people.items() if k in _PEOPLE} | {"faces": faces}
    for name, ddl in _PEOPLE.items():
        if name in tables:
            columns = [f.name for f in schema.parsed(ddl).fields if f.name in tables[name].columns]
            tables[name].select(*columns).write.mode("overwrite").json(f"{path}/{name}")


def read_people(spark: SparkSession, path: str, library_id: str) -> dict[str, DataFrame]:
    """The tables of a people folder, or of a people file (one JSON document)."""
    lib = F.lit(library_id).alias("library_id")
    try:
        spark.read.schema(_PEOPLE["persons"]).json(f"{path}/persons")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return read_people_document(spark, path, library_id)
    out = {}
    for name, ddl in _PEOPLE.items():
        try:
            out[name] = spark.read.schema(ddl).json(f"{path}/{name}").select(lib, "*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
            out[name] = spark.createDataFrame([], schema.parsed(ddl)).select(lib, "*")
    return out


def read_people_document(spark: SparkSession, path: str, library_id: str) -> dict[str, DataFrame]:
    """The tables of a people file (JSON with faces, groups and noise_face_ids)."""
    inner = lambda kind: ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.parsed(kind).fields if f.name not in ("library_id", "ord"))
    file = spark.read.schema(f"faces array<struct<{inner(schema.FACES)}>>, groups array<struct<{inner(schema.PERSONS)}>>, noise_face_ids array<string>").json(path, multiLine=True)
    lib = F.lit(library_id).alias("library_id")
    groups = file.select(F.explode("groups").alias("g"))
    return {
        "faces": file.select(F.posexplode("faces").alias("ord", "f")).select(lib, F.col("ord").cast("long").alias("ord"), "f.*"),
        "persons": groups.select(lib, F.col("g.id").cast("long").alias("id"), "g.prototype", "g.name"),
        "person_faces": groups.select(lib, F.col("g.id").cast("long").alias("person_id"), F.explode("g.face_ids").alias("face_id")),
        "person_photos": groups.select(lib, F.col("g.id").cast("long").alias("person_id"), F.explode("g.photo_ids").alias("photo_id")),
        "removed": groups.select(lib, F.col("g.id").cast("long").alias("person_id"), F.explode("g.removed_photo_ids").alias("photo_id")),
        "noise": file.select(lib, F.explode("noise_face_ids").alias("face_id")),
    }


def write_people_document(people: dict[str, DataFrame], faces: DataFrame, path: str) -> None:
    """The people of one library as one JSON document with faces, groups and noise_face_ids, for tools that want that.

    It is put together by one task, so it is for libraries that fit in one; write_people has no such bound.
    """
    listed = lambda df, key, value: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias(value))
    groups = people["persons"].select("id", "prototype", "name").join(listed(people["person_faces"], "person_id", "face_id").withColumnRenamed("face_id", "face_ids"), "id", "left")
    groups = groups.join(listed(people["person_photos"], "person_id", "photo_id").withColumnRenamed("photo_id", "photo_ids"), "id", "left")
    if "removed" in people:
        groups = groups.join(listed(people["removed"], "person_id", "photo_id").withColumnRenamed("photo_id", "removed_photo_ids"), "id", "left")
    one = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    # Sorted by their first column; ids of faces come after their place.
    kept = [c for c in ("id", "photo_id", "bbox", "embedding", "det_score", "appearance_embedding") if c in faces.columns]
    rows = faces.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*kept).alias("f")))), lambda x: x["f"]).alias("faces"))
    noise = people["noise"].agg(F.array_sort(F.collect_list("face_id")).alias("noise_face_ids"))
    one_row = rows.crossJoin(one(groups, "groups")).crossJoin(noise)
    one_row.coalesce(1).write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Retrieval cases: query and relevant_ids of a JSON list, or of a folder of files with one case in a line."""
    return spark.read.schema(schema.CASES).json(path, multiLine=not lines)


def create_project(root: str, name: str, now: str, project_id: str | None = None) -> dict:
    """Writes the file of a new project below root and returns its fields; a blank name is an error."""
    import uuid

    clean = " ".join(name.split())
    if not clean:
        raise ValueError("a project needs a name")
    project = {"id": project_id or uuid.uuid4().hex[:12], "name": clean, "created_at": now, "updated_at": now, "photo_count": 0, "analyzed_count": 0, "status": "empty", "encoder": None, "embedding_dimension": None}
    fs, top = FileSystem.from_uri(root if "://" in root else f"file://{root}")
    fs.create_dir(f"{top}/{project['id']}", recursive=True)
    with fs.open_output_stream(f"{top}/{project['id']}/project.json") as out:
        out.write(json.dumps(project, ensure_ascii=False, indent=2).encode())
    return project


def create_projects(projects: DataFrame, root: str) -> DataFrame:
    """(id): writes the files of projects(id, name, now) in the tasks that hold them; doing so again changes nothing."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": [create_project(root, r.name_, r.now, r.id)["id"] for r in part.rename(columns={"name": "name_"}).itertuples()]}, dtype=object)

    return projects.select("id", "name", "now").mapInPandas(make, "id string")


def write_annotations(annotations: DataFrame, path: str) -> None:
    """Replaces the annotations; one folder per kind."""
    annotations.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema.ANNOTATIONS)


def read_label_sheet(spark: SparkSession, path: str, lines: str | None = None) -> DataFrame:
    """A label sheet: CSV with a header, a JSON list of rows, or a JSON object from photo to event (all sure).

    Of a folder of JSON files with a row or an object in each line, `lines` tells which: rows or maps.
    """
    names = schema.parsed(schema.LABELS).names
    if lines == "rows":
        rows = spark.read.schema(schema.LABELS).json(path)
    elif lines == "maps":
        rows = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, string>")).alias("photo_id", "event_id")).withColumn("label_confidence", F.lit("high"))
    elif path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True)
        rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})
    elif path.lower().endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        if text.select(F.substring(F.ltrim("value"), 1, 1)).first()[0] == "{":
            rows = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("photo_id", "event_id")).withColumn("label_confidence", F.lit("high"))
        else:
            rows = spark.read.schema(schema.LABELS).json(path, multiLine=True)
    else:
        raise ValueError(f"not a label sheet: {path}")
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names)).withColumn("ord", F.monotonically_increasing_id())


def read_assets(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed JSON of remote assets, one list or one in a line; sources/remote.py reads the manager itself."""
    return spark.read.schema(schema.ASSETS).json(path, multiLine=not lines)


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """The projects of a folder, the last updated first; files that do not parse are passed over."""
    rows = spark.read.schema(schema.PROJECTS).option("mode", "DROPMALFORMED").json(f"{root.rstrip('/')}/*/project.json", multiLine=True)
    return rows.where("id is not null").orderBy(F.desc("updated_at"))


def fetch_assets(opener: Callable[[dict], dict], page_size: int = 250) -> Iterator[dict]:
    """Assets of a paged remote listing, with a guard against pages that repeat; opener sends one request's body."""
    if not 1 <= page_size <= 1000:
        raise ValueError("page_size must be from 1 to 1000")
    page, seen = 1, set()
    while page is not None:
        if page in seen:
            raise ValueError(f"the remote listing repeats page {page}")
        seen.add(page)
        found = opener({"page": page, "size": page_size, "type": "IMAGE", "withExif": True}).get("assets") or {}
        yield from (a for a in found.get("items") or [] if a.get("id"))
        page = int(found["nextPage"]) if found.get("nextPage") else None


def remote_status(opener: Callable[[str], dict]) -> dict:
    """Whether the remote manager answers, and its version; opener reads a path of its API."""
    version = opener("/server/version")
    return {"reachable": (opener("/server/ping") or {}).get("res") == "pong", "version": ".".join(str(version.get(k, 0)) for k in ("major", "minor", "patch"))}


def remote_thumbnail(opener: Callable[[str], bytes], asset_id: str, size: str = "preview") -> bytes:
    """The bytes of an asset's thumbnail; the id must be one segment of a path."""
    if not asset_id or not all(c.isalnum() or c in "-_" for c in asset_id):
        raise ValueError(f"not an asset id: {asset_id!r}")
    return opener(f"/assets/{asset_id}/thumbnail?size={size}")


def create_album(opener: Callable[[str, dict], dict], name: str, wanted: DataFrame, photos: DataFrame, batch: int = 1000) -> DataFrame:
    """(album_id, sent): makes an album of synchronized photos and adds them from the tasks that hold them.

    Ids that are no synchronized photo are an error, which names the first of them; the driver asks for the empty album
    alone.  A row tells of one request; adding a photo again does not change an album.
    """
    from lumenlake.operators.sync import REMOTE, unknown_ids

    if unknown := [r.id for r in unknown_ids(wanted, photos).limit(20).collect()]:
        raise ValueError(f"not synchronized: {unknown}")
    if not name.strip() or wanted.isEmpty():
        raise ValueError("an album needs a name and photos")
    made = opener("/albums", {"albumName": name.strip(), "assetIds": []})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                ids = [i.removeprefix(f"{REMOTE}:") for i in part.id.iloc[at : at + batch]]
                opener(f"/albums/{made['id']}/assets", {"ids": ids})
                yield pd.DataFrame({"album_id": [str(made["id"])], "sent": [len(ids)]})

    return wanted.select(F.col("id").cast("string")).distinct().mapInPandas(add, "album_id string, sent long")


def api_url(base: str) -> str:
    """A remote address as one that ends in /api."""
    clean = base.strip().rstrip("/")
    return clean if clean.endswith("/api") else f"{clean}/api"


def masked_error(message: str, key: str | None, most: int = 500) -> str:
    """An error's text without the key, held to a length."""
    return (message.replace(key, "***") if key else message)[:most]


def csv_export(photos: DataFrame) -> DataFrame:
    """The columns of the CSV export, all text, nulls as empty strings."""
    name = F.coalesce("original_filename", F.element_at(F.split("path", "/"), -1))
    columns = {"photo_id": F.col("id"), "filename": name, "captured_at": F.col("captured_at"), "latitude": F.col("latitude"), "longitude": F.col("longitude"), "quality_score": F.col("quality.score")}
    return photos.orderBy("ord").select(*(F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in columns.items()))


def write_csv(photos: DataFrame, path: str) -> None:
    """The CSV export as files with a header, each of which begins with a byte order mark."""
    rows = csv_export(photos)
    marked = rows.withColumnsRenamed({rows.columns[0]: "\ufeff" + rows.columns[0]})
    marked.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").option("emptyValue", "").csv(path)


def counts(events: DataFrame, journeys: DataFrame | None = None) -> DataFrame:
    """One row: how many events and journeys there are, have a name, and have one from a backend."""
    n = lambda df, name: df.agg(F.count("*").alias(name), F.count_if(F.length(F.trim(F.coalesce("name", F.lit("")))) > 0).alias(f"named_{name}"), F.count_if(F.col("name_source") == "llm").alias(f"llm_{name}"))
    out = n(events, "events")
    return out if journeys is None else out.crossJoin(n(journeys, "journeys"))


def generation_mode(counts: DataFrame) -> DataFrame:
    """counts with the mode of generation: llm, mixed, template or empty."""
    llm, named = F.col("llm_events") + F.col("llm_journeys"), F.col("named_events") + F.col("named_journeys")
    return counts.withColumn("generation_mode", F.when(named == 0, "empty").when(llm == 0, "template").when(llm < named, "mixed").otherwise("llm"))


def manifest(project: dict, photos: DataFrame, events: DataFrame, groups: DataFrame, path: str) -> None:
    """The manifest as one JSON table per relation below path, and the project's own fields."""
    spark = photos.sparkSession
    spark.createDataFrame([(json.dumps(project, ensure_ascii=False),)], "value string").write.mode("overwrite").text(f"{path}/project")
    sizes = spark.range(1).select(*(F.lit(0).alias("one"),))
    for name, rows in (("photos", photos), ("events", events), ("similar_groups", groups)):
        rows.write.mode("overwrite").json(f"{path}/{name}")
        sizes = sizes.crossJoin(spark.read.json(f"{path}/{name}").agg(F.count("*").alias(name)) if rows.columns else spark.range(0).agg(F.count("*").alias(name)))
    sizes.drop("one").write.mode("overwrite").json(f"{path}/counts")


def best_shot_names(photos: DataFrame, limit: int = 20) -> DataFrame:
    """rank, id and archive name of the best photos; limit is held to 1..50."""
    top = photos.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord").limit(max(1, min(50, limit)))
    name = F.coalesce("original_filename", F.element_at(F.split("path", "/"), -1))
    order = Window.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord")  # over 50 rows at most
    ranked = top.withColumn("rank", F.row_number().over(order))
    return ranked.select("rank", "id", F.format_string("rank%02d-%s-%s", "rank", F.col("id").cast("string"), F.regexp_replace(name, r"[^\w.\-]+", "_")).alias("archive_name"))


def write_best_shots_zip(photos: DataFrame, target: str, limit: int = 20) -> int:
    """A ZIP of the best photos' files with a manifest, written by the driver; an error if there is none."""
    import zipfile

    rows = best_shot_names(photos, limit).join(photos.select("id", "path"), "id").orderBy("rank").collect()
    if not rows:
        raise ValueError("there are no photos to export")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for r in rows:
            out.write(r.path.removeprefix("file:"), r.archive_name)
        out.writestr("manifest.json", json.dumps([{"rank": r.rank, "id": r.id, "file": r.archive_name} for r in rows], ensure_ascii=False, indent=1))
    return len(rows)


def touched(projects: DataFrame, project_id: str, now: str, **changes) -> DataFrame:
    """projects with changes to one; unknown fields are an error; updated_at is moved on."""
    unknown = set(changes) - set(schema.parsed(schema.PROJECTS).names)
    if unknown:
        raise ValueError(f"unknown project fields: {sorted(unknown)}")
    this = F.col("id") == project_id
    for k, v in (changes | {"updated_at": now}).items():
        projects = projects.withColumn(k, F.when(this, F.lit(v).cast(schema.parsed(schema.PROJECTS)[k].dataType)).otherwise(F.col(k)))
    return projects


def narrative_dump(events: DataFrame, members: DataFrame, photos: DataFrame, journeys: DataFrame | None = None) -> DataFrame:
    """One JSON line per event and per journey with its texts and the file names of its photos in order.

    journeys: library_id, journey_id, texts and event_ids; its photos are those of its events.
    """
    file = F.coalesce("original_filename", F.element_at(F.split("path", "/"), -1)).alias("file")
    named = members.select("library_id", "event_id", "id", "pos").join(photos.select("library_id", "id", file), ["library_id", "id"])
    listed = lambda keys: named_by(keys).agg(F.array_sort(F.collect_list(F.struct(*order[keys], "file"))).alias("f"))
    order = {("library_id", "event_id"): ("pos",), ("library_id", "journey_id"): ("event_id", "pos")}
    named_by = lambda keys: rows[keys].groupBy(*keys)
    rows = {("library_id", "event_id"): named}
    line = lambda df, kind: df.withColumn("photos", F.coalesce(F.col("f.file"), F.array().cast("array<string>"))).drop("f").select(F.to_json(F.struct(F.lit(kind).alias("kind"), "*")).alias("value"))
    out = line(events.join(listed(("library_id", "event_id")), ["library_id", "event_id"], "left"), "event")
    if journeys is None:
        return out
    of = journeys.select("library_id", "journey_id", F.explode("event_ids").alias("event_id"))
    rows["library_id", "journey_id"] = named.join(of, ["library_id", "event_id"])
    return out.unionByName(line(journeys.join(listed(("library_id", "journey_id")), ["library_id", "journey_id"], "left"), "journey"))
