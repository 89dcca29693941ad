"""Events: the sequential, strict and people strategies, journeys and stops."""

import copy
import random
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import event_people, events, journeys, metrics, places
from tests.helpers import groups, photos


def at(hours, day="2025-01-01"):
    return (datetime.fromisoformat(day) + timedelta(hours=hours)).isoformat()


def test_a_day_splits_and_ten_minutes_do_not(spark):
    rows = [{"captured_at": at(h), "embedding": [1.0, 0.0]} for h in (0, 1 / 6, 24)]
    for strategy in ("time_only", "time_clip", "time_clip_gps"):
        assert groups(events.sequential_events(photos(spark, *rows), strategy)) == [["a", "b"], ["c"]]
    with pytest.raises(ValueError):
        events.find_events(photos(spark, *rows), "other")


def test_the_gap_that_splits_by_time_alone(spark):
    rows = [{"captured_at": at(h)} for h in (0, 3.84, 3.84 + 3.85)]
    assert groups(events.sequential_events(photos(spark, *rows), "time_only")) == [["a", "b"], ["c"]]


def test_missing_times_come_last_and_libraries_are_apart(spark):
    both = photos(spark, {"captured_at": None}, {"captured_at": at(0)}, {"captured_at": "2025"}).union(photos(spark, {"captured_at": at(0)}, library="M"))
    got = {(r.library_id, r.id): (r.event_id, r.pos) for r in events.sequential_events(both, "time_only").collect()}
    assert got[("L", "b")] == (0, 0) and got[("L", "a")][0] == 1 and got[("L", "c")][0] == 2 and got[("M", "a")] == (0, 0)
    assert events.sequential_events(both.limit(0)).count() == 0


@pytest.mark.parametrize("segments", [1, 5])
def test_a_timeline_dealt_over_tasks_gives_the_same_events(spark, tmp_path, segments):
    rng = random.Random(9)
    rows = [{"id": f"p{i}", "captured_at": at(rng.uniform(0, 900)) if rng.random() > 0.1 else None, "embedding": [rng.random(), rng.random()], "latitude": 30 + rng.random(), "longitude": 104.0} for i in range(300)]
    p = photos(spark, *rows).union(photos(spark, *rows[:40], library="M")).union(photos(spark, rows[0], library="N"))
    for strategy in ("time_only", "time_clip_gps"):
        got, want = ({(r.library_id, r.ord): (r.event_id, r.pos) for r in events.sequential_events(p, strategy, segments=s).collect()} for s in (segments, None))
        assert got == want and len(set(want.values())) > 30
    assert events.sequential_events(p.limit(0), segments=segments).count() == 0
    held = p.repartitionByRange(segments, "library_id", *events._order()).groupBy(F.spark_partition_id().alias("s"), "library_id").count()
    assert held.where("library_id = 'L'").count() >= segments - 1 and held.agg(F.max("count")).first()[0] <= 2.2 * 341 / segments  # no task has a library to itself


def test_summary(spark):
    p = photos(spark, {"captured_at": at(1), "latitude": 2.0}, {"captured_at": at(0), "latitude": 1.0, "longitude": 5.0}, {"captured_at": at(1.5)})
    r = events.event_summary(events.sequential_events(p, "time_only")).first()
    assert (r.photo_count, r.centroid_latitude, r.centroid_longitude, str(r.start), str(r.end)) == (3, 1.5, 5.0, "2025-01-01 00:00:00", "2025-01-01 01:30:00")


def test_file_times_never_join_by_time(spark):
    p = photos(spark, *({"captured_at": at(s / 3600), "captured_at_source": "filesystem", "embedding": v} for s, v in ((0, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 1.0]))))
    found = events.strict_events(p)
    assert groups(found) == [["a", "b"], ["c"]]
    assert {(r.start, r.evidence) for r in events.strict_summary(found).collect()} == {(None, "strict_clip_fallback")}


def strict_by_hand(rows):
    """Components of the strict rule, pair by pair."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        va, vb = (np.array(r["embedding"]) if r.get("embedding") else None for r in (a, b))
        cos = None if va is None or vb is None else float(va @ vb / max(np.linalg.norm(va) * np.linalg.norm(vb), 1e-12))
        ta, tb = (datetime.fromisoformat(r["captured_at"]).timestamp() if r.get("captured_at") else None for r in (a, b))
        if all(r["captured_at_source"] == "exif" and r.get("captured_at") for r in (a, b)):
            gap = abs(ta - tb) / 3600 / 8
            km = 0.0
            if None not in (a.get("latitude"), b.get("latitude")):
                p, q = np.radians([a["latitude"], b["latitude"]]), np.radians([a["longitude"], b["longitude"]])
                km = 2 * 6371 * np.arcsin(np.sqrt(np.sin((p[1] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(p[1]) * np.sin((q[1] - q[0]) / 2) ** 2))
            match = gap < 1 and 0.55 * gap + 0.30 * (0 if cos is None else 1 - cos) + 0.15 * min(km / 50, 1) <= 0.48
        else:
            batch = a["captured_at_source"] == b["captured_at_source"] == "filesystem" and ta is not None and tb is not None and abs(ta - tb) <= 900
            match = cos is not None and cos >= (0.86 if batch else 0.92)
        if match:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return [find(i) for i in range(len(rows))]


def test_strict_events_against_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(90):
        angle = rng.uniform(0, 3)
        r = {"captured_at": at(rng.uniform(0, 120)) if rng.random() > 0.1 else None, "captured_at_source": rng.choice(["exif", "exif", "filesystem", "immich"])}
        if rng.random() > 0.15:
            r["embedding"] = [float(np.cos(angle)), float(np.sin(angle)), rng.uniform(-0.5, 0.5)]
        if rng.random() > 0.3:
            r |= {"latitude": 30 + rng.random(), "longitude": 104 + rng.random()}
        rows.append(r | {"id": f"p{len(rows)}"})
    want = strict_by_hand(rows)
    number = {root: i for i, root in enumerate(dict.fromkeys(want))}
    got = {r.id: r.event_id for r in events.strict_events(photos(spark, *rows)).collect()}
    assert got == {r["id"]: number[w] for r, w in zip(rows, want, strict=True)}


def test_a_shared_person_merges_two_strict_events(spark):
    p = photos(spark, *({"captured_at": at(0), "captured_at_source": "filesystem", "embedding": v} for v in ([1.0, 0.0], [0.8, 0.6])))
    assert groups(events.strict_events(p)) == [["a"], ["b"]]
    who = spark.createDataFrame([("L", 0, "a"), ("L", 0, "b")], "library_id string, person_id long, photo_id string")
    merged = event_people.merge_by_people(p, person_photos=who)
    assert groups(merged) == [["a", "b"]] and event_people.event_people(merged, who).first().person_ids == [0]
    assert groups(event_people.merge_by_people(p)) == [["a"], ["b"]]
    far = photos(spark, {"captured_at": at(0), "embedding": [1.0, 0.0]}, {"captured_at": at(99), "embedding": [1.0, 0.1]})
    assert groups(event_people.merge_by_people(far, person_photos=who)) == [["a"], ["b"]]  # a hard conflict of times


def test_looks_are_gathered_without_writing_vectors(spark, monkeypatch):
    """A person's faces on a photo are averaged, looks decide, and no vector is written on the way."""
    kept, write = [], event_people.written
    monkeypatch.setattr(event_people, "written", lambda df: kept.append(df.columns) or write(df))
    p = photos(spark, *({"captured_at": at(0), "captured_at_source": "filesystem", "embedding": v} for v in ([1.0, 0.0], [0.8, 0.6])))
    who = spark.createDataFrame([("L", 0, "a"), ("L", 0, "b")], "library_id string, person_id long, photo_id string")
    mine = spark.createDataFrame([("L", 0, f) for f in "xyz"], "library_id string, person_id long, face_id string")
    for look, want in (([1.0, 1.0], [["a", "b"]]), ([-1.0, -1.0], [["a"], ["b"]])):
        seen = [("L", "x", "a", [2.0, 0.0]), ("L", "y", "a", [0.0, 2.0]), ("L", "z", "b", look), ("L", "of nobody", "b", [5.0, 5.0]), ("L", "none", "b", None)]
        faces = spark.createDataFrame(seen, "library_id string, id string, photo_id string, appearance_embedding array<double>")
        assert groups(event_people.merge_by_people(p, faces, mine, who)) == want
    assert kept and not {"embedding", "vector", "looks"} & {c for columns in kept for c in columns}


def test_libraries_that_fit_in_a_task_are_merged_there(spark, monkeypatch):
    """Nothing but the result is written, no vector is sent but to its library, and the way by cells merges alike."""
    rng = np.random.default_rng(31)
    p, who, mine, faces = None, [], [], []
    for library, n in (("L", 40), ("M", 25), ("N", 1)):
        rows = []
        for i in range(n):
            r = {"id": f"{library}{i}", "ord": 3 * i % n, "embedding": (np.array([1.0, 0.0, 0.0]) + 0.5 * rng.normal(size=3)).tolist() if i % 9 else None, "captured_at_source": "exif" if i % 4 else "filesystem"}
            r |= {"captured_at": at(float(rng.uniform(0, 600)))} if i % 7 else {}
            r |= {"latitude": 30 + float(rng.random()), "longitude": 104.0} if i % 3 else {}
            rows.append(r)
            for person in {int(x) for x in rng.integers(0, 5, 2)}:
                who.append((library, person, r["id"]))
                mine.append((library, person, f"{r['id']}:{person}"))
                faces += [(library, f"{r['id']}:{person}", r["id"], None if rng.random() < 0.2 else rng.normal(1, 0.7, 3 if rng.random() < 0.9 else 2).tolist())] * int(rng.integers(1, 3))
        one = photos(spark, *rows, library=library)
        p = one if p is None else p.unionByName(one)
    given = {"faces": spark.createDataFrame(faces, "library_id string, id string, photo_id string, appearance_embedding array<double>"), "person_faces": spark.createDataFrame(mine, "library_id string, person_id long, face_id string"),
             "person_photos": spark.createDataFrame(who, "library_id string, person_id long, photo_id string")}
    kept, write = [], event_people.written
    found = lambda **k: {r.id: (r.library_id, r.event_id) for r in event_people.merge_by_people(p, **k).collect()}
    events_of = []
    for tables in (given, {}):
        monkeypatch.setattr(event_people, "written", lambda df: kept.append(df.columns) or write(df))
        got = found(**tables)
        assert kept == [["node", "event_id"]] and len(got) == 66
        kept.clear()
        assert got == found(**tables, together=1)  # all but N by cells
        assert len(kept) > 1 and "embedding" not in kept[-1]
        kept.clear()
        events_of.append(len(set(got.values())))
    assert 6 < events_of[0] < events_of[1] < 60
    lying = p.repartition(4, "library_id")
    looks = lying.select("library_id", F.concat("id", F.lit(":")).alias("id"), F.col("id").alias("photo_id"), F.col("embedding").alias("appearance_embedding"))
    at_once = event_people._merged_at_once(lying, event_people._of_people(lying, looks, given["person_faces"], given["person_photos"]), events.DEFAULTS, {})
    assert "REPARTITION_BY_NUM" in (plan := at_once._jdf.queryExecution().executedPlan().toString()) and plan.count("hashpartitioning") <= 4


def test_greedy_merging_takes_the_best_pair_first():
    def group(i, people, v):
        g = event_people._Group([i])
        g.people, g.vector_sum = set(people), np.array(v, float)
        return g

    rules = {"min_visual": 0.72, "merge": 0.86, "multi": 0.82, "gap_seconds": 1, "geo_km": 80}
    out = event_people._greedy([group(0, [1], [1, 0]), group(1, [1], [0.9, 0.43]), group(2, [1], [1, 0.01]), group(3, [], [1, 0])], rules)
    assert [g.ids for g in out] == [[0, 2, 1], [3]] or [g.ids for g in out] == [[0, 2], [1], [3]]
    assert out[0].ids[:2] == [0, 2]


EVENTS = "library_id string, event_id long, start_epoch double, centroid_latitude double, centroid_longitude double"
PLACES = "library_id string, cluster_id long, name string, is_home boolean, latitude double, longitude double, radius_km double"


def test_two_stops_of_one_trip(spark):
    trip = spark.createDataFrame([("L", 0, 0.0, 30.66, 104.06), ("L", 1, 86400.0, 22.3, 114.2), ("L", 2, 3 * 86400.0, 42.36, -71.09), ("L", 3, 3.5 * 86400.0, None, None), ("L", 4, 4 * 86400.0, 30.6, 104.0)], EVENTS)
    known = spark.createDataFrame([("L", 0, "home", True, 30.66, 104.06, 80.0), ("L", 1, "Hong Kong", False, 22.3, 114.2, 80.0), ("L", 2, "Boston", False, 42.36, -71.09, 80.0)], PLACES)
    placed = places.event_places(trip, known)
    assert {r.event_id: (r.state, r.destination) for r in placed.collect()} == {0: ("home", None), 1: ("away", "Hong Kong"), 2: ("away", "Boston"), 3: ("unknown", None), 4: ("home", None)}
    found = journeys.journeys(placed)
    assert groups(found, "journey_id", "event_id") == [[1, 2, 3]]
    stopped = journeys.stop_summary(journeys.stops(found)).orderBy("stop_id").collect()
    assert [(r.name, r.event_count) for r in stopped] == [("Hong Kong", 1), ("Boston", 2)]
    shots = spark.createDataFrame([("L", 1, 1, "p"), ("L", 2, 4, "q"), ("L", 3, 1, "r")], "library_id string, event_id long, photo_count long, first_photo string")
    r = journeys.journey_summary(found, shots).first()
    assert (r.event_ids, r.loose_photo_ids, r.destination_names) == ([2], ["p", "r"], ["Hong Kong", "Boston"]) and r.confidence == pytest.approx(2 / 3)


def journeys_by_hand(rows, days=5.0):
    out, journey, open_, last = {}, -1, False, None
    for event, start, state in sorted(rows, key=lambda r: (r[1], r[0])):
        gap = abs(start - last) / 86400 if last is not None else 0.0
        if state == "home":
            open_, last = False, start
        elif state == "away":
            if not open_ or gap > days:
                journey += 1
            open_, last = True, start
            out[event] = journey
        elif open_ and gap <= days:
            last = start
            out[event] = journey
    return out


def test_journeys_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 200) * 86400, rng.choice(["home", "away", "away", "unknown"])) for i in range(120)]
    df = spark.createDataFrame([("L", *r) for r in rows], "library_id string, event_id long, start_epoch double, state string")
    assert {r.event_id: r.journey_id for r in journeys.journeys(df).collect()} == journeys_by_hand(rows)
    known = [r for r in rows if r[2] != "unknown"]
    assert {r.event_id: r.journey_id for r in journeys.journeys_without_unknown(df.where("state <> 'unknown'")).collect()} == journeys_by_hand(known)


def test_timeless_events_join_only_with_a_clear_lead(spark):
    rows = [("L", 0, 0.0, [1.0, 0.0], [1]), ("L", 1, 9e6, [0.0, 1.0], [2]), ("L", 2, None, [1.0, 0.0], [1]), ("L", 3, None, [0.7, 0.7], [1, 2]), ("L", 4, None, None, None)]
    e = spark.createDataFrame(rows, "library_id string, event_id long, start_epoch double, centroid array<double>, person_ids array<long>")
    m = spark.createDataFrame([("L", 0, 0), ("L", 1, 1)], "library_id string, event_id long, journey_id long")
    assert {(r.event_id, r.journey_id) for r in journeys.attach_timeless(m, e).collect()} == {(0, 0), (1, 1), (2, 0)}


def test_attachment_against_a_loop(spark):
    rng = random.Random(15)

    def unit():
        v = np.array([1.0, 0.2 * rng.gauss(0, 1), 0.2 * rng.gauss(0, 1)]) if rng.random() < 0.5 else np.array([0.2 * rng.gauss(0, 1), 1.0, 0.3 * rng.gauss(0, 1)])
        return (v / np.linalg.norm(v)).tolist()

    rows = [("L", i, float(i) if i < 12 else None, unit() if rng.random() < 0.9 else None, [rng.randrange(4) for _ in range(rng.randint(0, 2))]) for i in range(60)]
    members = [("L", i, int(rows[i][3] is None or rows[i][3][0] < 0.7)) for i in range(12)]
    vectors, people, want = {0: [], 1: []}, {0: set(), 1: set()}, {}
    for _, i, j in members:
        want[i] = j
        people[j] |= set(rows[i][4])
        vectors[j] += [rows[i][3]] if rows[i][3] else []
    for _, i, _, v, p in rows[12:]:
        score = {j: 0.65 * max([float(np.dot(v, m)) for m in vectors[j]] if v else [0.0], default=0.0) + 0.35 * (len(set(p) & people[j]) / len(set(p)) if p else 0.0) for j in vectors}
        best = max(score, key=lambda j: (score[j], j))
        if score[best] >= 0.84 and score[best] - score[1 - best] >= 0.08:
            want[i] = best
            people[best] |= set(p)
            vectors[best] += [v] if v else []
    e = spark.createDataFrame(rows, "library_id string, event_id long, start_epoch double, centroid array<double>, person_ids array<long>")
    m = spark.createDataFrame(members, "library_id string, event_id long, journey_id long")
    assert {r.event_id: r.journey_id for r in journeys.attach_timeless(m, e).collect()} == want and len(want) > 14
    assert {r.event_id: r.journey_id for r in journeys.attach_timeless(m, e, together=5).collect()} == want


def test_cells_do_not_change_what_is_attached(spark):
    rng = random.Random(17)
    rows, members = [], []
    for i in range(400):
        group = rng.randrange(12)
        v = np.array([1.0, 0.25 * rng.gauss(0, 1), 0.25 * rng.gauss(0, 1)])
        rows.append(("L", i, None if rng.random() < 0.6 else float(i), (v / np.linalg.norm(v)).tolist() if rng.random() < 0.9 else None, [group * 4 + rng.randrange(4) for _ in range(rng.randint(0, 3))] or None))
        if rows[-1][2] is not None and rng.random() < 0.8:
            members.append(("L", i, group * 2 + rng.randrange(2)))
    e = spark.createDataFrame(rows, "library_id string, event_id long, start_epoch double, centroid array<double>, person_ids array<long>")
    m = spark.createDataFrame(members, "library_id string, event_id long, journey_id long")
    whole, apart = ({(r.event_id, r.journey_id) for r in journeys.attach_timeless(m, e, together=t).collect()} for t in (1000, 10))
    assert whole == apart and len(whole) > len(members) + 20
    placed = e.join(m, ["library_id", "event_id"], "left").where("journey_id IS NOT NULL OR start_epoch IS NULL")
    assert journeys.attachment_cells(placed, 10).where("size(person_ids) > 0").select("cell").distinct().count() >= 12


def test_greedy_merging_against_all_pairs():
    rng = random.Random(16)
    rules = {"min_visual": 0.72, "merge": 0.86, "multi": 0.82, "gap_seconds": 3600, "geo_km": 80}

    def group(i):
        g = event_people._Group([i])
        g.people = {rng.randrange(5) for _ in range(rng.randint(0, 3))}
        g.vector_sum = np.array([1.0, rng.gauss(0, 0.5), rng.gauss(0, 0.3)]) * rng.randint(1, 4)
        g.times = np.array(sorted(rng.uniform(0, 9000) for _ in range(rng.randint(0, 2))))
        g.spots = np.array([[30 + rng.random(), 104.0] for _ in range(rng.randint(0, 2))]).reshape(-1, 2)
        g.appearance = {p: np.array([1.0, rng.random()]) for p in g.people if rng.random() < 0.5}
        return g

    for _ in range(12):
        made = [group(i) for i in range(14)]
        copies = [copy.deepcopy(g) for g in made]
        while True:
            rated = [(-s, i, j) for i in range(len(copies)) for j in range(i + 1, len(copies)) if (s := event_people._score(copies[i], copies[j], rules)) is not None]
            if not rated:
                break
            _, i, j = min(rated, key=lambda r: (r[0], copies[r[1]].ids[0], copies[r[2]].ids[0]))
            copies[i].absorb(copies[j])
            del copies[j]
        assert sorted(sorted(g.ids) for g in event_people._greedy(made, rules)) == sorted(sorted(g.ids) for g in copies)


def test_evaluation_of_strategies_and_journeys(spark):
    p = photos(spark, *({"captured_at": at(h), "embedding": [1.0, 0.0]} for h in (0, 1 / 6, 24)))
    expected = spark.createDataFrame([("L", "a", "1"), ("L", "b", "1"), ("L", "c", "2")], "library_id string, id string, label string")
    got = {r.strategy: r.f1 for r in metrics.evaluate_event_strategies(p, expected, lambda s: events.find_events(p, s), events.STRATEGIES).collect()}
    assert got == dict.fromkeys(events.STRATEGIES, 1.0)
    with_one = metrics.evaluate_labels(p, expected, metrics.event_labels(events.sequential_events(p)).where("id <> 'c'")).first()
    assert with_one.f1 == 1 and with_one.coverage == pytest.approx(2 / 3)
    stopped = spark.createDataFrame([("L", 0, 0, 0), ("L", 1, 0, 1)], "library_id string, event_id long, journey_id long, stop_id long")
    levels = metrics.evaluate_journey_hierarchy(p, events.sequential_events(p), stopped, expected.withColumn("label", F.lit("trip")), expected.withColumn("label", F.lit("stop"))).collect()
    assert {r.level: (r.f1, r.coverage) for r in levels} == {"parent_journey": (1.0, 1.0), "journey_stop": (pytest.approx(0.5), 1.0)}


def test_home_is_where_most_months_are(spark):
    rows = [{"captured_at": f"2025-0{m}-03T10:00:00", "latitude": 30.0 + 0.005 * m, "longitude": 104.0} for m in (1, 2, 3)] + [{"captured_at": f"2025-02-1{d}T10:00:00", "latitude": 22.30 + 0.01 * d, "longitude": 114.2} for d in (0, 1)]
    clusters = places.gps_clusters(photos(spark, *rows, {"latitude": 1.0}), 20)
    found = places.journey_places(clusters).orderBy("cluster_id").collect()
    assert [r.is_home for r in found] == [True, False] and found[0].latitude == pytest.approx(30.01) and found[1].name.startswith("GPS 22.305") and found[0].radius_km == 55.0 or found[0].radius_km == 40.0
    towns = spark.createDataFrame([("Near", "County", "XX", 30.0, 104.0), ("Far", None, "YY", 22.0, 114.0)], "name string, admin1 string, cc string, latitude double, longitude double")
    assert [r.name for r in places.gps_clusters(photos(spark, *rows), 20, towns).orderBy("cluster_id").collect()] == ["Near, County", "Far, YY"]


def test_spots_meet_over_the_date_line_and_the_pole(spark):
    rng = random.Random(2)
    spots = [(0.0, 179.9), (0.0, -179.95), (89.9, 0.0), (89.95, 170.0), (-60.0, 10.0), (-60.0, 10.6), (-60.0, 11.9)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(40)] + [(50 + rng.uniform(-1, 1), 8 + rng.uniform(-1, 1)) for _ in range(40)]
    p = photos(spark, *({"latitude": a, "longitude": o, "id": f"p{i}"} for i, (a, o) in enumerate(spots)))

    def km(x, y):
        (a, b), (c, d) = np.radians(x), np.radians(y)
        return 2 * 6371 * np.arcsin(np.sqrt(min(1, np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2)))

    root = list(range(len(spots)))
    for _ in spots:
        for i, j in combinations(range(len(spots)), 2):
            if km(spots[i], spots[j]) <= 40:
                root[i] = root[j] = min(root[i], root[j])
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(f"p{i}")
    assert sorted(groups(places.gps_members(p, 40), "cluster_id")) == sorted(sorted(v) for v in want.values())


def test_streaming_events_follow_the_sequential_rule(spark, tmp_path):
    from lumenlake.streaming.sessions import streaming_events

    rng = random.Random(8)
    rows = [(i % 3, i, i * 3000.0 + rng.uniform(0, 20000), 30.0 + rng.random(), 104.0, [rng.random(), rng.random()]) for i in range(60)]
    schema = "library_id long, id long, captured_epoch double, latitude double, longitude double, embedding array<double>"
    p = spark.createDataFrame(rows, schema)
    p.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = streaming_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {r.id: r.event_id for r in events.sequential_events(p.withColumn("ord", F.col("id"))).collect()}
    assert {r.id: r.event_id for r in spark.table("sessions").collect()} == want


def people_library(rng, n):
    """Events of one library as rows and as the greedy loop's groups; times in stretches, people who keep to them or not."""
    rows, made = [], []
    for i in range(n):
        stretch = rng.randrange(n // 12 + 1)
        loose = stretch % 7 == 0 and rng.random() < 0.4
        people = sorted({stretch % 40 * 3 + rng.randrange(3) for _ in range(rng.randint(1, 3))} | ({500} if not loose and rng.random() < 0.3 else set()))
        times = [] if loose else sorted(stretch * 90000.0 + rng.uniform(0, 30000) for _ in range(rng.randint(1, 3)))
        v = (np.array([1.0, rng.gauss(0, 0.5), rng.gauss(0, 0.3)]) * rng.randint(1, 4)).tolist()
        rows.append(("L", i, people, times, v))
        g = event_people._Group([i])
        g.people, g.times, g.vector_sum = set(people), np.array(times), np.array(v)
        made.append(g)
    return rows, made


def test_cells_do_not_change_what_is_merged(spark):
    rng = random.Random(26)
    rules = {"min_visual": 0.72, "merge": 0.86, "multi": 0.82, "gap_seconds": 8 * 3600, "geo_km": 80}
    rows, made = people_library(rng, 700)
    df = spark.createDataFrame(rows, "library_id string, event_id long, person_ids array<long>, times array<double>, v array<double>")
    cells = {r.event_id: r.cell for r in event_people.merge_cells(df, 8 * 3600, together=10).collect()}
    assert len(cells) == 700 and len(set(cells.values())) > 20
    by_cell = {}
    for g in copy.deepcopy(made):
        by_cell.setdefault(cells[g.ids[0]], []).append(g)
    apart = sorted(sorted(g.ids) for gs in by_cell.values() for g in event_people._greedy(gs, rules))
    assert apart == sorted(sorted(g.ids) for g in event_people._greedy(made, rules)) and any(len(g) > 2 for g in apart)
    assert event_people.merge_cells(df, 8 * 3600).select("cell").distinct().count() == 1


def test_a_library_of_many_events_is_merged_cell_by_cell():
    """1e5 events of one library: cells of twelve or so, each like the loop over all its pairs."""
    rng = random.Random(27)
    rules = {"min_visual": 0.72, "merge": 0.86, "multi": 0.82, "gap_seconds": 8 * 3600, "geo_km": 80}
    _, made = people_library(rng, 100_000)
    cells = {}
    for g in made:  # what merge_cells makes of them: stretches of time are far apart, but for events without a time
        cells.setdefault(int(g.times[0] // 90000) if len(g.times) else -1, []).append(g)
    for gs in list(cells.values())[:300]:
        copies = copy.deepcopy(gs)
        got = sorted(sorted(g.ids) for g in event_people._greedy(gs[:40], rules))
        copies = copies[:40]
        while True:
            rated = [(-s, i, j) for i in range(len(copies)) for j in range(i + 1, len(copies)) if (s := event_people._score(copies[i], copies[j], rules)) is not None]
            if not rated:
                break
            _, i, j = min(rated)
            copies[i].absorb(copies[j])
            del copies[j]
        assert got == sorted(sorted(g.ids) for g in copies)


def test_vectors_are_added_up_before_the_shuffle(spark):
    from lumenlake.functions import vector

    rng = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else f"k{i % 7}", i % 3, None if i % 11 == 0 else [] if i % 13 == 0 else rng.normal(size=3 if i % 5 else 2).tolist(), float(rng.random())) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, n int, v array<float>, w double").repartition(3)
    want, weights, sums = {}, {}, {}
    for r in df.collect():
        if r.v:
            for into, w in ((want, max(r.w, 1e-6)), (sums, 1.0)):
                total = into.setdefault((r.k, r.n), np.zeros(3))
                total[: len(r.v)] += w * np.array(r.v)
            weights.setdefault((r.k, r.n), np.zeros(3))[: len(r.v)] += max(r.w, 1e-6)
    got = {(r.k, r.n): r.m for r in vector.mean_vectors(df, ["k", "n"], "v", "m", "w").collect()}
    for key in want:
        n = np.count_nonzero(weights[key])
        mean, sums[key] = want[key][:n] / weights[key][:n], sums[key][:n]
        assert got[key] == pytest.approx((mean / np.linalg.norm(mean)).tolist())
    added = {(r.k, r.n): r.total for r in vector.sum_vectors(df, ["k", "n"], "v").collect()}
    assert set(added) == set(sums) == set(got) and all(added[k] == pytest.approx(sums[k].tolist()) for k in sums)
    plan = vector.sum_vectors(df, ["k", "n"], "v")._jdf.queryExecution().toString()
    assert "Generate" not in plan
    # One row for each key and task is shuffled, whatever the number of rows.
    many = spark.range(0, 30000, 1, 3).selectExpr("id % 2 AS k", "array(1D, 2D) AS v")
    sums = vector._Sums([pa.field("k", pa.int64())])
    for batch in many.toArrow().to_batches(max_chunksize=1000):
        sums.add(batch.append_column("w", pa.array([[1.0]] * batch.num_rows)))
    assert len(sums.held) == 2
    assert sorted(r.total for r in vector.sum_vectors(many, ["k"], "v").collect()) == [[15000.0, 30000.0]] * 2


def test_all_sequential_strategies_in_one_pass(spark):
    rng = random.Random(12)
    rows = [{"id": f"p{i}", "captured_at": at(rng.uniform(0, 80)) if i % 9 else None, "embedding": [rng.random() - 0.5, rng.random()] if i % 5 else None} | ({"latitude": 30 + rng.random(), "longitude": 104.0} if i % 3 else {}) for i in range(60)]
    p = photos(spark, *rows).union(photos(spark, *rows[:5], library="M"))
    found = {(r.library_id, r.id): r for r in events.sequential_ids(p).collect()}
    assert len(found) == 65
    for s in events.STRATEGIES[:3]:
        assert {k: r[s] for k, r in found.items()} == {(r.library_id, r.id): r.event_id for r in events.sequential_events(p, s).collect()}
    assert events.sequential_ids(p)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_vectors_of_events_are_added_up_where_they_are(spark):
    from lumenlake.functions import vector

    rng = random.Random(13)
    p = photos(spark, *({"id": f"p{i}", "captured_at": at(rng.uniform(0, 200)), "embedding": [rng.random() - 0.5, rng.random()] if i % 4 else None} for i in range(80)))
    members = events.sequential_events(p)
    want = {r.event_id: r.centroid for r in vector.mean_vectors(members, ["library_id", "event_id"], "embedding").collect()}
    got = {r.event_id: r.centroid for r in events.sequential_centroids(p).collect()}
    assert set(got) == set(want) and len(got) > 5 and all(got[k] == pytest.approx(want[k]) for k in want)
    sent = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert sent(events.sequential_centroids(p)) == sent(members.select("event_id")) == 1


def test_streaming_events_with_vectors_missing_or_of_another_size(spark, tmp_path):
    from lumenlake.streaming.sessions import streaming_events

    rng = random.Random(9)
    vectors = [None, [], [1.0], [1.0, -0.5], [-0.2, 1.0]]
    rows = [(i % 2, i, i * 4000.0 + rng.uniform(0, 20000), None if i % 5 == 0 else 30.0 + rng.random(), 104.0, rng.choice(vectors)) for i in range(90)]
    schema = "library_id long, id long, captured_epoch double, latitude double, longitude double, embedding array<double>"
    p = spark.createDataFrame(rows, schema)
    for k, part in enumerate(("captured_epoch < 200000", "captured_epoch >= 200000")):  # the second meets the first one's state
        p.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    want = {r.id: r.event_id for r in events.sequential_events(p.withColumn("ord", F.col("id"))).collect()}
    assert {r.id: r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
