"""The library's operations over HTTP, by the standard library's server; `handle` answers a request without one.

    python -m lumenlake.service /projects --port 8000

Every project is a folder below the root with its index; a library of all, if there is one, is the root's own index.
Answers are JSON, errors are {"detail": ...}; photos are sent as they are, the CSV export as lines.  A list is answered in
full up to MOST_ROWS rows; a longer one is asked for in pages, with offset and limit, and an answer never leaves rows out
without being asked to.
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass
from datetime import datetime, timezone
from email import policy
from email.parser import BytesParser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from inspect import signature
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.api import Library, Settings
from lumenlake.operators import narrative, people, search
from lumenlake.sources import files, images, schema

#: Most rows of an answer, but for those that have a limit of their own.
MOST_ROWS = 10_000
#: The rows that a request has asked for: how many to pass over, and how many to give (None: all).
_PAGE: ContextVar[tuple[int, int | None]] = ContextVar("page", default=(0, None))
#: Content types by suffix.
TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "gif": "image/gif"}


@dataclass(frozen=True)
class Content:
    """An answer that is not JSON: a type and its bytes, all at once or part by part."""

    kind: str
    parts: Iterable[bytes]


class NotFound(LookupError):
    """There is no such route, project, photo or person."""


def rows(df: DataFrame, most: int | None = None) -> list[dict]:
    """The rows of an answer: up to `most`, or the page that was asked for, or all if they are not too many."""
    shown = df.drop(*(c for c in ("embedding", "centroid", "prototype") if c in df.columns))
    skip, wanted = (0, most) if most is not None else _PAGE.get()
    found = [json.loads(r) for r in (shown.offset(skip) if skip else shown).limit(MOST_ROWS + 1 if wanted is None else wanted).toJSON().collect()]
    if wanted is None and len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: ask for them with offset and limit")
    return found


def _grouped(members: DataFrame, key: str) -> DataFrame:
    return members.groupBy("library_id", key).agg(F.array_sort(F.collect_list("id")).alias("photo_ids"), F.min("captured_at").alias("start"), F.max("captured_at").alias("end")).orderBy("library_id", key)


class Service:
    """Projects below a root, each with an index, people and annotations."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.now = now or (lambda: datetime.now(timezone.utc).isoformat())
        self.routes: list[tuple[str, re.Pattern, Callable]] = []
        for method, path, run in (
            ("GET", "/", lambda: {"service": "lumenlake"}), ("GET", "/health", lambda: {"status": "ok"}), ("GET", "/projects", lambda: rows(files.read_projects(self.spark, self.root))), ("POST", "/projects", self.create),
            ("GET", "/projects/{project}/health", lambda project: rows(self.library(project).health())[0]), ("POST", "/projects/{project}/analyze", self.analyze), ("GET", "/projects/{project}/photos", lambda project: rows(search.listing(self.library(project).photos))),
            ("POST", "/projects/{project}/search", self.search), ("GET", "/projects/{project}/events", self.events), ("GET", "/projects/{project}/journeys", self.journeys),
            ("GET", "/projects/{project}/similar-groups", lambda project: rows(_grouped(self.library(project).similar_groups(), "group_id"))), ("GET", "/projects/{project}/best-shots", lambda project, limit="20": rows(self.library(project).best_shots(int(limit)))),
            ("GET", "/projects/{project}/quality/{photo}", self.quality), ("GET", "/projects/{project}/people", lambda project: rows(self.people(project)[0]["persons"])), ("POST", "/projects/{project}/people/cluster", self.cluster),
            ("POST", "/projects/{project}/people/merge", lambda project, ids: self.correct(project, merges=[ids])), ("POST", "/projects/{project}/people/remove-photo", lambda project, id, photo: self.correct(project, removals=[(id, photo)])),
            ("POST", "/projects/{project}/people/name", self.name), ("GET", "/projects/{project}/annotations", lambda project: rows(files.read_annotations(self.spark, self.path(project, "annotations")))), ("PUT", "/projects/{project}/annotations", self.annotate),
            ("GET", "/projects/{project}/export/csv", lambda project: self.csv(self.library(project).photos)), ("GET", "/projects/{project}/export/best-shots", lambda project, limit="20": rows(files.best_shot_names(self.library(project)._scored(), int(limit)))),
            ("POST", "/projects/{project}/uploads", self.upload), ("GET", "/projects/{project}/photos/{photo}/content", self.content), ("GET", "/projects/{project}/people/{person}/cover", self.cover),
            ("GET", "/photos", lambda: rows(search.listing(self.library(None).photos))), ("POST", "/search", lambda **given: self.search(None, **given)), ("GET", "/events", lambda **given: self.events(None, **given)),
            ("POST", "/journeys/discover", lambda **given: self.journeys(None, **given)), ("GET", "/similar-groups", lambda: rows(_grouped(self.library(None).similar_groups(), "group_id"))),
        ):
            self.routes.append((method, re.compile(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path) + "/?"), run))

    def handle(self, method: str, target: str, body: dict | None = None) -> tuple[int, Any]:
        """(status, answer) of a request."""
        url = urlsplit(target)
        given = {k: v[-1] for k, v in parse_qs(url.query).items()} | (body or {})
        try:
            for verb, pattern, run in self.routes:
                if verb == method and (found := pattern.fullmatch(url.path)):
                    if method == "GET" and "offset" in given or "limit" in given and "limit" not in signature(run).parameters:
                        skip, wanted = int(given.pop("offset", 0)), int(given.pop("limit", MOST_ROWS))
                        if skip < 0 or not 0 <= wanted <= MOST_ROWS:
                            raise ValueError(f"offset must be at least 0 and limit from 0 to {MOST_ROWS}")
                        _PAGE.set((skip, wanted))
                    else:
                        _PAGE.set((0, None))
                    return 200, run(**given, **found.groupdict())
            raise NotFound(target)
        except NotFound as e:
            return 404, {"detail": f"not found: {e}"}
        except (ValueError, TypeError) as e:
            return 400, {"detail": str(e)}

    def path(self, project: str | None, name: str) -> str:
        if project is None:
            return f"{self.root}/{name}"
        known = self.spark.createDataFrame([(project,)], "id string").select(search.project_id_is_valid(F.col("id"))).first()[0]
        if not known or files.read_projects(self.spark, self.root).where(F.col("id") == project).isEmpty():
            raise NotFound(project)
        return f"{self.root}/{project}/{name}"

    def upload(self, project: str, files_: dict[str, bytes]) -> dict:
        """Puts photos by their relative paths below the project's uploads; those that may not be there are told with why."""
        folder = self.path(project, "uploads")
        table = self.spark.createDataFrame([(p, len(raw)) for p, raw in files_.items()], "path string, length long")
        found = images.sort_uploads(table).collect()  # the paths of one request
        fs, top = files.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for r in found:
            if r.rejected is None:
                clean = "/".join(p for p in r.path.strip().replace("\\", "/").split("/") if p not in ("", "."))
                fs.create_dir(f"{top}/{clean}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{top}/{clean}") as out:
                    out.write(files_[r.path])
        return {"accepted": [r.path for r in found if r.rejected is None], "rejected": [{"path": r.path, "reason": r.rejected} for r in found if r.rejected is not None], "directory": folder}

    def content(self, project: str, photo: str) -> Content:
        """The bytes of a photo, from where its index says it is."""
        found = search.lookup(self.library(project).photos, photo).select("path").first()
        if found is None:
            raise NotFound(photo)
        one = self.spark.read.format("binaryFile").load(found.path).select("content").first()
        return Content(TYPES.get(found.path.rsplit(".", 1)[-1].lower(), "application/octet-stream"), [bytes(one.content)])

    def cover(self, project: str, person: str) -> dict:
        """The photo and face that stand for a person."""
        found, faces = self.people(project)
        lib = self.library(project)
        best = people.covers(found["person_faces"], faces, lib._scored()).where(F.col("person_id") == int(person)).join(faces.select(F.col("id").alias("face_id"), "bbox"), "face_id", "left")
        if not (got := rows(best, 1)):
            raise NotFound(person)
        return got[0] | {"content": f"/projects/{project}/photos/{got[0]['photo_id']}/content"}

    def csv(self, photos: DataFrame) -> Content:
        """All lines of the export, partition by partition."""

        def lines() -> Iterator[bytes]:
            rows_ = files.csv_export(photos)
            buffer = io.StringIO()
            writer = csv.writer(buffer)
            writer.writerow(rows_.columns)
            yield "\ufeff".encode()
            for r in rows_.toLocalIterator():
                writer.writerow(r)
                if buffer.tell() > 1 << 16:
                    yield buffer.getvalue().encode()
                    buffer.seek(0)
                    buffer.truncate()
            yield buffer.getvalue().encode()

        return Content("text/csv; charset=utf-8", lines())

    def library(self, project: str | None) -> Library:
        return Library.open(self.spark, Settings(index=self.path(project, "index")))

    def create(self, name: str) -> dict:
        return files.create_project(self.root, name, self.now())

    def analyze(self, project: str, directory: str) -> dict:
        path = self.path(project, "index")
        return rows(Library.index(self.spark, directory, project, path).health())[0]

    def search(self, project: str, query: str, top_k: int = 20, **limits) -> dict:
        found, counts = self.library(project).search(query, top_k, **limits)
        return rows(counts)[0] | {"results": rows(found, top_k)}

    def events(self, project: str, strategy: str = "time_clip_gps") -> list[dict]:
        found = _grouped(self.library(project).events(strategy), "event_id")
        return rows(narrative.overlay(found, files.read_annotations(self.spark, self.path(project, "annotations")), "events", "event_id"))

    def journeys(self, project: str, max_gap_days: str = "5", stop_radius_km: str = "150") -> list[dict]:
        return rows(self.library(project).journeys(max_gap_days=float(max_gap_days), stop_radius_km=float(stop_radius_km))["journeys"])

    def quality(self, project: str, photo: str) -> dict:
        found = rows(self.library(project).quality(photo))
        if not found:
            raise NotFound(photo)
        return found[0]

    def people(self, project: str) -> tuple[dict[str, DataFrame], DataFrame]:
        found = files.read_people(self.spark, self.path(project, "people"), project)
        return {k: v for k, v in found.items() if k != "faces"}, found["faces"]

    def _store(self, project: str, found: dict[str, DataFrame], faces: DataFrame) -> list[dict]:
        """Writes the people anew, beside the file that is read meanwhile, and puts it in its place."""
        path = self.path(project, "people")
        files.write_people(found, faces, f"{path}.new")
        fs, top = files.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        if fs.get_file_info(top).type.name != "NotFound":
            fs.delete_dir(top)
        fs.move(f"{top}.new", top)
        return rows(self.people(project)[0]["persons"])

    def cluster(self, project: str, faces: list[dict], eps: float = 0.35, min_samples: int = 2) -> list[dict]:
        kind = schema.parsed(schema.FACES)
        table = self.spark.createDataFrame([(project, i, *(f.get(c) for c in kind.names[2:])) for i, f in enumerate(faces)], kind)
        return self._store(project, self.library(project).cluster_people(table, eps, min_samples).people, table)

    def correct(self, project: str, **changes) -> list[dict]:
        found, faces = self.people(project)
        lib = Library(self.library(project).photos, found, faces).correct_people(project, **changes)
        return self._store(project, lib.people, faces)

    def name(self, project: str, id: int, name: str | None = None) -> list[dict]:  # noqa: A002
        found, faces = self.people(project)
        return self._store(project, Library(self.library(project).photos, found, faces).name_person(project, id, name).people, faces)

    def annotate(self, project: str, annotations: list[dict]) -> list[dict]:
        path = self.path(project, "annotations")
        fields = ("kind", "item_id", "name", "note", "name_source")
        new = self.spark.createDataFrame([(project, *(None if a.get(f) is None else str(a[f]) for f in fields), i) for i, a in enumerate(annotations)], schema.ANNOTATIONS + ", ord long")
        kept = rows(narrative.upsert_annotations(files.read_annotations(self.spark, path), new))  # typed by hand
        files.write_annotations(self.spark.createDataFrame([tuple(r.get(f) for f in ("library_id", *fields)) for r in kept], schema.ANNOTATIONS), path)
        return kept


def uploaded(kind: str, raw: bytes) -> dict[str, bytes]:
    """The files of a multipart body by their names."""
    parsed = BytesParser(policy=policy.HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + raw)
    if not parsed.is_multipart():
        raise ValueError("an upload is a multipart body")
    return {p.get_filename(): p.get_payload(decode=True) or b"" for p in parsed.iter_parts() if p.get_filename()}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for the service; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                kind, raw = self.headers.get("Content-Type") or "", self.rfile.read(size)
                body = {"files_": uploaded(kind, raw)} if kind.startswith("multipart/") else json.loads(raw) if size else None
                status, out = service.handle(self.command, self.path, body)
            except ValueError as e:
                status, out = 400, {"detail": str(e)}
            if isinstance(out, Content):
                self.send_response(status)
                self.send_header("Content-Type", out.kind)
                self.send_header("Connection", "close")
                self.end_headers()
                for part in out.parts:
                    self.wfile.write(part)
                self.close_connection = True
                return
            raw = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = _answer  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    parser = argparse.ArgumentParser(prog="lumenlake.service")
    parser.add_argument("root")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8000)
    args = parser.parse_args()
    serve(Service(SparkSession.builder.appName("lumenlake").getOrCreate(), args.root), args.host, args.port).serve_forever()
