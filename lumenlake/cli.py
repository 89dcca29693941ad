"""The library's operations as commands: `python -m lumenlake.cli <command> ...`; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.api import Library, Settings
from lumenlake.operators import density, events, people
from lumenlake.operators.journeys import MAX_GAP_DAYS, STOP_RADIUS_KM
from lumenlake.sources import files


def _show(rows: DataFrame, drop: tuple[str, ...] = ("embedding", "centroid")) -> None:
    for line in rows.drop(*(c for c in drop if c in rows.columns)).toJSON().toLocalIterator():
        print(line)


def _open(spark: SparkSession, args: argparse.Namespace) -> Library:
    return Library.open(spark, Settings(index=args.index))


def _people(spark: SparkSession, args: argparse.Namespace) -> tuple[Library, DataFrame]:
    """The library with its stored persons, and their faces."""
    found = files.read_people(spark, args.people, args.library)
    return Library(_open(spark, args).photos, {k: v for k, v in found.items() if k != "faces"}, found["faces"]), found["faces"]


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    made = Library.index(spark, args.directory, args.library, args.index)
    _show(made.health())


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    found, counts = _open(spark, args).search(args.query, args.top_k, args.strategy, args.min_score, args.captured_from, args.captured_to, args.bbox)
    _show(counts)
    _show(found)


def events_(spark: SparkSession, args: argparse.Namespace) -> None:
    members = _open(spark, args).events(args.strategy)
    _show(members.groupBy("library_id", "event_id").agg(F.array_sort(F.collect_list("id")).alias("photo_ids"), F.min("captured_at").alias("start"), F.max("captured_at").alias("end")).orderBy("library_id", "event_id"))


def similar(spark: SparkSession, args: argparse.Namespace) -> None:
    members = _open(spark, args).similar_groups(phash_distance=args.phash_distance, similarity=args.similarity, window_seconds=args.window_seconds)
    _show(members.groupBy("library_id", "group_id").agg(F.array_sort(F.collect_list("id")).alias("photo_ids"), F.first("representative_id").alias("representative_id")).orderBy("library_id", "group_id"))


def journeys(spark: SparkSession, args: argparse.Namespace) -> None:
    _show(_open(spark, args).journeys(max_gap_days=args.max_gap_days, stop_radius_km=args.stop_radius_km)["journeys"])


def people_cluster(spark: SparkSession, args: argparse.Namespace) -> None:
    faces = files.read_people(spark, args.faces, args.library)["faces"]
    found = density.cluster_people(faces.withColumn("embedding", F.col("embedding").cast("array<double>")), args.eps, args.min_samples)
    files.write_people(found, faces, args.people)
    _show(found["persons"].groupBy("library_id").agg(F.count("*").alias("persons")))


def _changed(spark: SparkSession, args: argparse.Namespace, change: Callable[[dict, DataFrame], dict]) -> None:
    lib, faces = _people(spark, args)
    files.write_people(change(lib.people, faces), faces, args.output)
    _show(files.read_people(spark, args.output, args.library)["persons"], ("prototype",))


def people_merge(spark: SparkSession, args: argparse.Namespace) -> None:
    _changed(spark, args, lambda p, faces: people.apply_feedback(p, faces, args.library, merges=[args.ids]))


def people_remove(spark: SparkSession, args: argparse.Namespace) -> None:
    _changed(spark, args, lambda p, faces: people.apply_feedback(p, faces, args.library, removals=[(args.id, args.photo)]))


def people_name(spark: SparkSession, args: argparse.Namespace) -> None:
    _changed(spark, args, lambda p, faces: p | {"persons": people.set_name(p["persons"], args.library, args.id, args.name)})


def remote_opener(url: str, key: str) -> Callable:
    """Sends requests to a remote manager: a path alone is read, a path with a body is posted."""
    from urllib.request import Request, urlopen

    base = files.api_url(url)

    def opener(path: str, body: dict | None = None):
        data = json.dumps(body).encode() if body is not None else None
        try:
            with urlopen(Request(f"{base}{path}", data=data, headers={"x-api-key": key, "Content-Type": "application/json", "Accept": "application/json"}), timeout=30) as answer:
                return json.loads(answer.read() or b"null")
        except (OSError, ValueError) as e:
            raise ConnectionError(files.masked_error(str(e), key)) from None

    return opener


def remote_status(spark: SparkSession | None, args: argparse.Namespace) -> None:
    print(json.dumps(files.remote_status(remote_opener(args.url, args.key))))


def remote_sync(spark: SparkSession, args: argparse.Namespace) -> None:
    """Lands the remote listing as a folder and shows what a synchronization would do with each asset."""
    from lumenlake.operators import sync
    from lumenlake.sources import remote

    opener = remote_opener(args.url, args.key)
    remote.read_remote(spark, lambda body: opener("/search/metadata", body), args.page_size).write.mode("overwrite").json(args.landing)
    found = files.read_assets(spark, args.landing, lines=True).select("id", F.col("updatedAt").alias("updated_at"), F.lit(True).alias("cached"), F.lit(False).alias("failed"))
    plan = sync.plan_sync(_open(spark, args).photos, found, args.force, args.prune)
    _show(sync.sync_counts(plan))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenlake", description="Photo-library analytics.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *positional: str, on_index: bool = True) -> argparse.ArgumentParser:
        out = commands.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        out.set_defaults(run=run)
        for p in positional:
            out.add_argument(p)
        if on_index:
            out.add_argument("--index", default=Settings().index)
            out.add_argument("--library", default="default")
        return out

    command("index", index, "directory")
    c = command("search", search, "query")
    c.add_argument("--top-k", type=int, default=20)
    c.add_argument("--strategy", default="query_enhancement")
    c.add_argument("--min-score", type=float)
    c.add_argument("--captured-from")
    c.add_argument("--captured-to")
    c.add_argument("--bbox", type=float, nargs=4, metavar=("SOUTH", "WEST", "NORTH", "EAST"))
    command("events", events_).add_argument("--strategy", default="time_clip_gps", choices=events.STRATEGIES)
    c = command("similar", similar)
    c.add_argument("--phash-distance", type=int, default=10)
    c.add_argument("--similarity", type=float, default=0.90)
    c.add_argument("--window-seconds", type=float, default=30.0)
    c = command("journeys", journeys)
    c.add_argument("--max-gap-days", type=float, default=MAX_GAP_DAYS)
    c.add_argument("--stop-radius-km", type=float, default=STOP_RADIUS_KM)
    c = command("people-cluster", people_cluster, "faces")
    c.add_argument("--people", required=True)
    c.add_argument("--eps", type=float, default=0.35)
    c.add_argument("--min-samples", type=int, default=2)
    for name, run in (("people-merge", people_merge), ("people-remove", people_remove), ("people-name", people_name)):
        c = command(name, run)
        c.add_argument("--people", required=True)
        c.add_argument("--output", required=True)
        if name == "people-merge":
            c.add_argument("ids", type=int, nargs="+")
        else:
            c.add_argument("id", type=int)
            c.add_argument("photo" if name == "people-remove" else "name")
    for name, run in (("remote-status", remote_status), ("remote-sync", remote_sync)):
        c = command(name, run, on_index=name == "remote-sync")
        c.add_argument("--url", required=True)
        c.add_argument("--key", default=os.environ.get("LUMENLAKE_REMOTE_KEY", ""))
        if name == "remote-sync":
            c.add_argument("--landing", required=True)
            c.add_argument("--page-size", type=int, default=250)
            c.add_argument("--force", action="store_true")
            c.add_argument("--prune", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(spark if spark is not None or args.run is remote_status else SparkSession.builder.appName("lumenlake").getOrCreate(), args)
    except (ValueError, OSError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
