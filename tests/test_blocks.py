"""Rules between rows, block by block: libraries that fit in a tile and those that do not give the same."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import blocks, density, events, places, similar
from tests.helpers import groups, photos
from tests.test_events import at, strict_by_hand
from tests.test_tables import faces, similar_by_hand


@pytest.fixture(params=[1024, 9], ids=["one tile", "many tiles"])
def tile(request, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", request.param)


def mixed(rng, n):
    rows = []
    for i in range(n):
        angle = rng.uniform(0, 3)
        r = {"id": f"p{i}", "captured_at": at(rng.uniform(0, 60)) if rng.random() > 0.1 else None, "captured_at_source": rng.choice(["exif", "exif", "filesystem"]), "phash_hi": rng.getrandbits(3), "phash_lo": rng.getrandbits(4)}
        if rng.random() > 0.15:
            r["embedding"] = [float(np.cos(angle)), float(np.sin(angle)), rng.uniform(-0.5, 0.5)]
        if rng.random() > 0.3:
            r |= {"latitude": 30 + rng.random(), "longitude": 104 + rng.random()}
        rows.append(r)
    return rows


def test_strict_events_and_pairs(spark, tile):
    rows = mixed(random.Random(41), 70)
    both = photos(spark, *rows).union(photos(spark, *rows[:3], library="M"))
    want = strict_by_hand(rows)
    number = {root: i for i, root in enumerate(dict.fromkeys(want))}
    found = events.strict_events(both).where("library_id = 'L'")
    assert {r.id: r.event_id for r in found.collect()} == {r["id"]: number[w] for r, w in zip(rows, want, strict=True)}
    pairs = events.strict_pairs(both).where("library_id = 'L'").collect()
    assert len({(r.left_ord, r.right_ord) for r in pairs}) == len(pairs) and all(r.left_ord < r.right_ord and want[r.left_ord] == want[r.right_ord] for r in pairs)


def test_similar_pairs(spark, tile):
    rng = random.Random(42)
    rows = mixed(rng, 60)
    for r in rows:
        r["captured_at"] = r["captured_at"] and f"2025-01-01T00:{rng.randint(0, 9):02d}:{rng.randint(0, 59):02d}"
    p = photos(spark, *rows)
    for window, gate in ((30, True), (200, True), (None, False)):
        got = similar.similar_pairs(p, 2, 0.95, window or 0, gate).collect()
        assert len(got) == len({(r.left_ord, r.right_ord) for r in got}) and {(r.left_ord, r.right_ord) for r in got} == similar_by_hand(rows, 2, 0.95, window)


def test_hashes_are_sought_by_their_bands(spark, monkeypatch):
    """All pairs within a distance, once; few candidates for each; copies of one hash are not paired to be grouped."""
    rng = random.Random(46)
    base = [rng.getrandbits(64) for _ in range(30)]
    hashes = [h ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for h in base for _ in range(6)] + [base[0]] * 20
    rows = [(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hashes)]
    df = spark.createDataFrame([("L", *r) for r in rows], "library_id string, id long, phash_hi long, phash_lo long")
    for d in (0, 3, 8, 10):
        got = similar.near_hashes(df, d).collect()
        distinct = sorted(set(hashes))
        want = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= d}
        assert len(got) == len(want) and {(r.a_hi << 32 | r.a_lo, r.b_hi << 32 | r.b_lo) for r in got} == want
    monkeypatch.setattr(blocks, "TILE", 16)
    p = photos(spark, *({"id": f"p{i}", "phash_hi": hi, "phash_lo": lo} for i, hi, lo in rows))
    near = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= 10}
    assert {(r.left_ord, r.right_ord) for r in similar.similar_pairs(p, 10, 0.9, require_time=False).collect()} == near
    root = list(range(len(hashes)))
    for _ in root:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(f"p{i}")
    assert sorted(groups(similar.similar_groups(p, 10, 0.9, require_time=False), "group_id")) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    edges = []
    monkeypatch.setattr(similar, "connected_components", lambda e: edges.append(e.count()) or blocks.connected_components(e))
    similar.similar_groups(p, 10, 0.9, require_time=False)
    assert edges[0] < 4 * len(hashes)  # stars and near pairs of different hashes


def test_density(spark, tile):
    rng = random.Random(43)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    u = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = 1 - u @ u.T <= 0.08
    core, label, n = near.sum(1) >= 4, [-1] * 60, 0
    for i in range(60):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    todo += [k for k in range(60) if near[j, k] and core[k] and label[k] < 0]
            n += 1
    for i in range(60):
        if not core[i]:
            label[i] = min((label[j] for j in range(60) if near[i, j] and core[j]), default=-1)
    got = {r.ord: r.label for r in density.dbscan(faces(spark, vectors), 0.08, 4).collect()}
    assert [got[i] for i in range(60)] == label and n > 1 and -1 in label


def test_tiles_far_apart_do_not_meet(spark, monkeypatch):
    """Neighbours are the same as of all pairs, while most pairs of tiles are passed over."""
    monkeypatch.setattr(blocks, "TILE", 20)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(0, 12, 600)] + 0.15 * rng.normal(size=(600, 16))
    rows = [("L", i, i, v.tolist()) for i, v in enumerate(x)] + [("L", 700 + i, 700 + i, v) for i, v in enumerate(([1.0, 2.0], [2.0, 4.0], [0.0] * 16, None, []))] + [("S", 900 + i, 900 + i, x[i].tolist()) for i in range(5)]
    seen = spark.createDataFrame(rows, "library_id string, node long, ord long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93).sum(1) - 1
    rule = lambda r, a, b: blocks.cosine(r, a, b) >= 0.93
    got = {r.node: r.n for r in blocks.counted(seen, rule, ("embedding", 0.93)).collect()}
    assert {i: n for i, n in got.items() if i < 600} == {i: int(n) for i, n in enumerate(near) if n}
    assert got[700] == got[701] == 1 and not {702, 703, 704} & set(got)
    met = blocks._dealt(seen, None, None, 1.0, ("embedding", 0.93)).where("library_id = 'L'").select("part", "x", "y").distinct().count()
    every = blocks._dealt(seen, None, None, 1.0).where("library_id = 'L'").select("part", "x", "y").distinct().count()
    tiles = blocks._dealt(seen, None, None, 1.0, ("embedding", 0.93)).where("library_id = 'L'").select("own").distinct().count()
    assert every == 31 * 32 // 2 and met < 0.35 * tiles * (tiles + 1) / 2
    # Rows that need no likeness among themselves meet the others only.
    bound = {r.node: r.n for r in blocks.over_blocks(seen, lambda r, a, b, same: {"node": r["node"][a], "n": np.ones(len(a), int)}, "node long, n long", loose=F.col("node") < 10, at=F.col("ord"), width=5.0, alike=("embedding", 0.93)).groupBy("node").count().withColumnRenamed("count", "n").collect()}
    assert set(bound) >= set(range(600))


def test_a_larger_table_does_not_send_its_rows_more_often(spark, monkeypatch):
    """Tiles of rows that look alike grow with the table, and a row is sent only to cells that may hold a neighbour of it."""
    monkeypatch.setattr(blocks, "TILE", 20)
    monkeypatch.setattr(blocks, "SAMPLE", 200)  # as many pivots for either
    rng, copies = np.random.default_rng(6), []
    centre = rng.normal(size=(12, 16))
    for n in (500, 2000):
        x = centre[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, 16))
        seen = spark.createDataFrame([("L", i, i, v.tolist()) for i, v in enumerate(x)], "library_id string, node long, ord long, embedding array<double>")
        copies.append(blocks._dealt(seen, None, None, 1.0, ("embedding", 0.93)).count() / n)
    assert copies[1] < 1.2 * copies[0]


def test_places(spark, tile):
    rng = random.Random(44)
    spots = [(0.0, 179.9), (0.0, -179.95), (89.9, 0.0), (89.95, 170.0)] + [(50 + rng.uniform(-1, 1), 8 + rng.uniform(-1, 1)) for _ in range(50)]
    root = list(range(len(spots)))

    def km(x, y):
        (a, b), (c, d) = np.radians(x), np.radians(y)
        return 2 * 6371 * np.arcsin(np.sqrt(min(1, np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2)))

    for _ in spots:
        for i in range(len(spots)):
            for j in range(i):
                if km(spots[i], spots[j]) <= 20:
                    root[i] = root[j] = min(root[i], root[j])
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(f"p{i}")
    p = photos(spark, *({"latitude": a, "longitude": o, "id": f"p{i}"} for i, (a, o) in enumerate(spots)))
    assert sorted(groups(places.gps_members(p, 20), "cluster_id")) == sorted(sorted(v) for v in want.values()) and len(want) > 4


def test_the_nearest_place(spark):
    rng = random.Random(45)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    towns = [(f"t{i}", rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(40)] + [("same", 10.0, 10.0), ("same too", 10.0, 10.0)]
    got = places.nearest(spark.createDataFrame([*points, (90, 10.0, 10.1), (91, None, 1.0)], "k long, a double, o double"), spark.createDataFrame(towns, "name string, la double, lo double").coalesce(1), ["k"], ("a", "o"), ("la", "lo"), ["name"])

    def km(a, b, c, d):
        p, q, r, s = np.radians([a, b, c, d])
        return 2 * 6371 * np.arcsin(np.sqrt(min(1, np.sin((r - p) / 2) ** 2 + np.cos(p) * np.cos(r) * np.sin((s - q) / 2) ** 2)))

    want = {k: min((km(a, o, la, lo), i) for i, (_, la, lo) in enumerate(towns)) for k, a, o in [*points, (90, 10.0, 10.1)]}
    found = {r.k: r for r in got.collect()}
    assert set(found) == set(want) and all(found[k].name == towns[i][0] and found[k].distance_km == pytest.approx(d) for k, (d, i) in want.items())


def test_the_nearest_place_without_a_row_for_each_pair(spark, tmp_path, monkeypatch):
    """Tiles of places that many points seek; across the date line and at the poles; no pair of a point and a place is a row."""
    rng = random.Random(46)
    points = [(i, rng.choice([-89.9, 89.7, 0.2, 51.3]) + rng.uniform(-0.09, 0.09), rng.choice([-179.95, 179.95, 12.0]) + rng.uniform(-0.5, 0.5)) for i in range(300)]
    towns = [(i, rng.choice([-89.5, 89.9, 0.5, 51.0]) + rng.uniform(-0.09, 0.09), rng.choice([-179.5, 179.5, 12.5, 100.0]) + rng.uniform(-0.4, 0.4)) for i in range(200)]
    got = places.nearest(spark.createDataFrame(points, "k long, a double, o double"), spark.createDataFrame(towns, "name long, la double, lo double"), ["k"], ("a", "o"), ("la", "lo"), ["name"])
    p, t = (np.radians([x[1:] for x in rows]) for rows in (points, towns))
    km = places._kilometres(p, t)
    assert {r.k: (r.name, round(r.distance_km, 6)) for r in got.collect()} == {i: (int(km[i].argmin()), round(float(km[i].min()), 6)) for i in range(300)}
    listed = spark.range(1).select(F.posexplode(F.sort_array(places._cells_near(F.lit(89.9), F.lit(5.0), 1))).alias("n", "cell")).collect()
    assert len(listed) == 3 * 360 and len({r.cell for r in listed}) == 3 * 360


def test_rows_dealt_by_library_are_not_sent_again(spark):
    """Where every library is one block, rows that lie by library are grouped where they are."""
    dealt = events._rows(photos(spark, *mixed(random.Random(47), 30)).union(photos(spark, {}, library="M")).repartition("library_id"))
    found = blocks.over_blocks(dealt, lambda block, a, b, same: {"n": np.array([len(a)])} if same and len(a) > 1 else None, "n long")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [r.n for r in found.collect()] == [30]
