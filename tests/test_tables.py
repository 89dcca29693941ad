"""Similar shots, persons, quality, metrics, texts, synchronization and files."""

import io
import json
import random
import struct
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import imaging, vector
from lumenlake.operators import density, metrics, narrative, people, quality, similar, sync
from lumenlake.operators.components import connected_components
from lumenlake.sources import files, images, schema
from tests.helpers import col, groups, photos


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)] + [(7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in want:
        for u, v in edges:
            if u != v:
                want[u] = want[v] = min(want[u], want[v])
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def similar_by_hand(rows, distance, cosine, window):
    out = set()
    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        near = bin(a["phash_hi"] ^ b["phash_hi"]).count("1") + bin(a["phash_lo"] ^ b["phash_lo"]).count("1") <= distance if a.get("phash_hi") is not None and b.get("phash_hi") is not None else False
        va, vb = a.get("embedding"), b.get("embedding")
        close = bool(va and vb) and float(np.dot(va, vb) / max(np.linalg.norm(va) * np.linalg.norm(vb), 1e-12)) >= cosine
        ta, tb = (int(r["captured_at"][17:19]) + 60 * int(r["captured_at"][14:16]) if r.get("captured_at") else None for r in (a, b))
        if (near or close) and (window is None or ta is None or tb is None or abs(ta - tb) <= window):
            out.add((i, j))
    return out


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    bases = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(5)]
    for i in range(70):
        hi, lo = rng.choice(bases)
        for _ in range(rng.randint(0, 9)):
            hi ^= 1 << rng.randrange(32)
            lo ^= 1 << rng.randrange(32)
        r = {"id": f"p{i}", "phash_hi": hi, "phash_lo": lo, "embedding": [rng.gauss(0, 1) for _ in range(3)]}
        if rng.random() < 0.1:
            r |= {"phash_hi": None, "phash_lo": None}
        if rng.random() > 0.3:
            r["captured_at"] = f"2025-01-01T00:{rng.randint(0, 9):02d}:{rng.randint(0, 59):02d}"
        rows.append(r)
    p = photos(spark, *rows)
    pairs = lambda df: {(r.left_ord, r.right_ord) for r in df.collect()}
    assert pairs(similar.similar_pairs(p)) == similar_by_hand(rows, 10, 0.9, 30)
    assert pairs(similar.similar_pairs(p, require_time=False, phash_distance=6, similarity=0.95)) == similar_by_hand(rows, 6, 0.95, None)


def test_best_of_a_group(spark):
    p = photos(spark, {"captured_at": "2025-01-01T00:00:00", "embedding": [1.0, 0.0], "score": 0.2}, {"captured_at": "2025-01-01T00:00:05", "embedding": [1.0, 0.0], "score": 0.9}, {"captured_at": "2025-01-01T00:09:00", "embedding": [1.0, 0.0]})
    found = similar.similar_groups(p)
    assert groups(found, "group_id") == [["a", "b"]] and set(col(found, "representative_id")) == {"b"}
    assert col(similar.best_shots(p, 0), "id") == ["b"] and col(similar.best_shots(p), "id") == ["b", "a", "c"]
    words = spark.createDataFrame([("0101", "0011"), ("01", "0111"), ("", "")], "a string, b string")
    assert [r[0] for r in words.select(similar.hamming_text(F.col("a"), F.col("b"))).collect()] == [2, 2, 0]


def faces(spark, vectors, eps=0.05, library="L"):
    rows = [(library, i, f"f{i}", f"photo-{i}", v, 0.5 + 0.1 * i) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "library_id string, ord long, id string, photo_id string, embedding array<double>, det_score double")


def test_faces_form_persons(spark):
    found = density.cluster_people(faces(spark, [[1.0, 0.0], [0.99, 0.01], [0.0, 1.0], [0.01, 0.99], [-1.0, 0.0]]), 0.05)
    assert groups(found["person_faces"], "person_id", "face_id") == [["f0", "f1"], ["f2", "f3"]] and col(found["noise"], "face_id") == ["f4"]
    assert all(np.linalg.norm(r.prototype) == pytest.approx(1) for r in found["persons"].collect())


def test_dbscan_against_its_definition(spark):
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(80)]
    u = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = 1 - u @ u.T <= 0.06
    core = near.sum(1) >= 4
    label, n = [-1] * 80, 0
    for i in range(80):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    todo += [k for k in range(80) if near[j, k] and core[k] and label[k] < 0]
            n += 1
    for i in range(80):
        if not core[i]:
            label[i] = min((label[j] for j in range(80) if near[i, j] and core[j]), default=-1)
    got = {r.ord: r.label for r in density.dbscan(faces(spark, vectors), 0.06, 4).collect()}
    assert [got[i] for i in range(80)] == label and n > 1


def test_corrections(spark):
    f = faces(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    index = {"persons": spark.createDataFrame([("L", 3, "Ann"), ("L", 7, None)], "library_id string, id long, name string"),
             "person_faces": spark.createDataFrame([("L", 3, "f0"), ("L", 7, "f1")], "library_id string, person_id long, face_id string"),
             "person_photos": spark.createDataFrame([("L", 3, "photo-0"), ("L", 7, "photo-1")], "library_id string, person_id long, photo_id string")}
    out = people.apply_feedback(index, f, "L", merges=[[7, 3]], removals=[(3, "photo-1")])
    assert [(r.id, r.name, [round(x, 6) for x in r.prototype]) for r in out["persons"].collect()] == [(3, "Ann", [1.0, 0.0])]
    assert col(out["person_photos"], "photo_id") == ["photo-0"] and col(out["person_faces"], "face_id") == ["f0"] and col(out["removed"], "photo_id") == ["photo-1"]
    for bad in ({"merges": [[3]]}, {"merges": [[3, 8]]}, {"merges": [[3, 7], [7, 3]]}, {"removals": [(8, "x")]}):
        with pytest.raises(ValueError):
            people.apply_feedback(index, f, "L", **bad)
    assert col(people.set_name(index["persons"], "L", 3, "  "), "name") == [None, None]
    with pytest.raises(ValueError):
        people.set_name(index["persons"], "L", 9, "x")


def test_vector_means(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3.0), (1, [0.0, 1.0], 1.0), (1, None, 9.0), (2, [], 1.0), (3, [0.0, 0.0], 1.0)], "k long, v array<double>, w double")
    assert [(r.k, [round(x, 4) for x in r.centroid]) for r in vector.mean_vectors(df, ["k"], "v").collect()] == [(1, [0.7071, 0.7071])]
    assert [round(x, 4) for x in vector.mean_vectors(df, ["k"], "v", weight="w").first().centroid] == [0.9487, 0.3162]


def test_face_and_total_quality(spark):
    shots = spark.createDataFrame([("L", "a", 10, 10), ("L", "b", 10, 10)], "library_id string, id string, width int, height int")
    seen = spark.createDataFrame([("L", "a", [0.0, 0.0, 1.0, 5.0], 0.8), ("L", "a", [0.0, 0.0, 10.0, 10.0], 1.7), ("L", "a", None, None)], "library_id string, photo_id string, bbox array<double>, det_score double")
    assert {r.id: round(r.face_quality_score, 6) for r in quality.face_quality(shots, seen).collect()} == {"a": round((0.8 * 0.4 + 1 + 0) / 3, 6), "b": 0.5}
    assert spark.range(1).select(quality.total(F.lit(100.0), F.lit(1.0), F.lit(0.5), F.lit(0.2)).score).first()[0] == pytest.approx(0.35 * 0.5 + 0.2 + 0.1 + 0.05)


def test_image_measures():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (50, 70, 3), dtype=np.uint8)
    flat = np.full((40, 40, 3), 128, np.uint8)
    assert imaging.phash(a) == imaging.phash(a.copy()) and len(imaging.phash(a)) == 64
    assert imaging.sharpness(flat) == 0 < imaging.sharpness(a) and imaging.sharpness(np.zeros((0, 0, 3), np.uint8)) == 0
    assert imaging.exposure(flat) == 1 and imaging.exposure(np.zeros((4, 4), np.uint8)) == 0.5 and 0 <= imaging.composition(a) <= 1
    v = imaging.hash_vector(a, b"x")
    assert v.shape == (256,) and np.linalg.norm(v) == pytest.approx(1)
    assert np.linalg.norm(imaging.upper_body(a, [10, 5, 20, 15])) == pytest.approx(1) and imaging.upper_body(a, [10, 45, 20, 50]) == [] and imaging.upper_body(a, [1]) == []
    assert imaging.shrink(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def png(pixels):
    import zlib

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def exif(order="<"):
    """A TIFF block with maker, times and a place south of the equator."""
    p = lambda f, *v: struct.pack(order + f, *v)
    texts, head = io.BytesIO(), 8 + 2 + 5 * 12 + 4
    inner, gps, data = head, head + 2 + 12 + 4, head + 2 + 12 + 4 + 2 + 4 * 12 + 4

    def put(raw):
        at = data + texts.tell()
        texts.write(raw)
        return at

    make, model, changed, taken = (put(x) for x in (b"Maker\0", b" Mod-1 \0", b"2024:01:02 03:04:05\0", b"2023/05/06 07:08:09\0"))
    lat, lon = put(p("IIIIII", 10, 1, 30, 1, 0, 1)), put(p("IIIIII", 20, 1, 0, 1, 36, 1))
    out = (b"II*\0" if order == "<" else b"MM\0*") + p("I", 8) + p("H", 5) + p("HHII", 271, 2, 6, make) + p("HHII", 272, 2, 8, model) + p("HHII", 306, 2, 20, changed) + p("HHII", 34665, 4, 1, inner) + p("HHII", 34853, 4, 1, gps) + p("I", 0)
    out += p("H", 1) + p("HHII", 36867, 2, 20, taken) + p("I", 0)
    out += p("H", 4) + p("HHI", 1, 2, 2) + b"S\0\0\0" + p("HHII", 2, 5, 3, lat) + p("HHI", 3, 2, 2) + b"E\0\0\0" + p("HHII", 4, 5, 3, lon) + p("I", 0)
    return out + texts.getvalue()


def test_exif_and_indexing(spark, tmp_path):
    for order in "<>":
        got = images.read_exif(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + exif(order))
        assert got["taken"] == "2023/05/06 07:08:09" and got["make"] == "Maker" and got["lat"] == [10.0, 30.0, 0.0] and got["lat_ref"] == "S"
    assert images.read_exif(b"nothing") == {} and images.read_exif(b"II*\0\xff\xff\xff\x7f") == {}
    rng = np.random.default_rng(1)
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.png").write_bytes(png(rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)))
    (tmp_path / "sub/a.PNG").write_bytes(png(np.full((8, 8, 3), 90, np.uint8)))
    (tmp_path / "x.jpg").write_bytes(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + exif())
    (tmp_path / "note.txt").write_text("no image")
    got = {r.path.split("/")[-1]: r for r in images.index_directory(spark, str(tmp_path), "L").collect()}
    assert set(got) == {"b.png", "a.PNG", "x.jpg"} and (got["b.png"].width, got["b.png"].height, len(got["b.png"].embedding)) == (30, 20, 256)
    assert got["b.png"].captured_at_source == "filesystem" and got["b.png"].quality.sharpness > got["a.PNG"].quality.sharpness and sorted(r.ord for r in got.values()) == [0, 1, 2]
    x = got["x.jpg"]
    assert (x.captured_at, x.captured_at_source, x.camera, x.latitude, x.longitude, x.gps_source, x.width) == ("2023-05-06T07:08:09", "exif", "Maker Mod-1", -10.5, 20.01, "exif", 0)


def test_headers_of_other_formats():
    block = exif()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc."
    with_exif = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + part(b"eXIf", block) + part(b"IEND", b"")
    webp = lambda kind, body: b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(body)) + body
    extended = webp(b"VP8X", b"\x08\0\0\0" + (11).to_bytes(3, "little") + (12).to_bytes(3, "little")) + b"EXIF" + struct.pack("<I", len(block)) + block
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 256, 4, 1, 30) + struct.pack("<HHII", 257, 3, 1, 20) + b"\0\0\0\0"
    sizes = {with_exif: (7, 9), extended: (12, 13), webp(b"VP8L", b"\x2f" + (5 | 6 << 14).to_bytes(4, "little")): (6, 7), webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 31, 32)): (31, 32), tiff: (30, 20), b"GIF89a": (0, 0), b"": (0, 0),
             b"\xff\xd8\xff\xe0\0\4ab\xff\xc2\0\x0b\x08" + struct.pack(">HH", 5, 6) + b"\3\0\0\0": (6, 5)}
    assert [images.image_size(raw) for raw in sizes] == list(sizes.values())
    for raw in (with_exif, extended):
        assert images.read_exif(raw)["taken"] == "2023/05/06 07:08:09"
    assert images.read_exif(tiff)["taken"] is None and images.read_exif(with_exif[:30]) == {}


def test_upload_paths(spark):
    rows = [("a/b.jpg", 5), ("../outside.jpg", 5), ("/abs.jpg", 5), ("", 5), (None, 5), ("a/notes.txt", 5), ("big.png", 1 << 30), ("C:\\x.png", 1), ("a/../b.png", 1)]
    got = images.sort_uploads(spark.createDataFrame(rows, "path string, length long"))
    assert col(got, "rejected") == [None, "unsafe path", "unsafe path", "unsafe path", "unsafe path", "unsupported type", "too large", "unsafe path", "unsafe path"]


def test_metrics(spark):
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    assert metrics.clustering_f1(frame([(0, 4), (0, 4), (1, 9), (1, 9)], "predicted int, expected int")).first().f1 == 1
    m = metrics.boundary_metrics(frame([("0", "E1", "F"), ("0", "E2", "F"), ("0", "E3", "E3")], "predicted string, strict string, tolerant string")).first()
    assert (m.tolerated_merge_pairs, m.hard_false_positive_pairs) == (1, 2) and m.tolerant_precision == pytest.approx(1 / 3)
    assert metrics.pairwise_metrics(frame([], "predicted string, expected string")).first().f1 == 0
    r = metrics.recall_at_k(frame([("q", 1, "a"), ("q", 2, "c"), ("z", 1, "a")], "query_id string, rank int, id string"), frame([("q", "a"), ("q", "b")], "query_id string, id string"), (1,)).first()
    assert (r.queries, r.mean_recall) == (2, 0.25)
    sheet = frame([("a", "E1", "", "high", 0), ("b", "E1", "FAMILY", " Medium", 1), ("c", "review", "FAMILY", "low", 2), ("b", None, "F2", None, 3)], "photo_id string, event_id string, event_family_id string, label_confidence string, ord long")
    assert {tuple(x) for x in metrics.annotation_labels(sheet, "event_id", "medium").collect()} == {("a", "E1"), ("b", "E1")}
    assert {tuple(x) for x in metrics.annotation_labels(sheet, "event_family_id", fallback="event_id").collect()} == {("a", "E1"), ("b", "F2"), ("c", "FAMILY")}
    assert metrics.latency_summary(frame([("m", 1.0), ("m", 3.0), ("n", None)], "method string, ms double")).where("method = 'n'").first().p95_ms == 0


def test_texts(spark):
    cols = "start string, place string, people array<string>, unnamed long, activities array<string>, objects array<string>"
    rows = [("2025-01-02T03", "Rome", ["Ann"], 0, ["聚餐"], ["蛋糕", "餐桌", "海洋"]), ("2025-01-02", None, ["A", "B", "C"], 0, [], []), (None, None, [], 0, [], []), (None, "Rome", [], 1, [], []), ("2025-01-02", None, [], 0, [], ["蛋糕"])]
    got = narrative.event_texts(spark.createDataFrame(rows, cols)).collect()
    assert [r.name for r in got] == ["Rome聚餐", "2025-01-02·与朋友的时光", "一段未命名的记忆", "Rome记忆", "2025-01-02·蛋糕记录"]
    assert got[0].summary == "2025-01-02，地点为Rome，和Ann，可能记录了聚餐，画面中可能包含蛋糕、餐桌。" and got[2].summary == "这组照片暂时缺少足够的事件信息。" and got[3].summary == "地点为Rome，和一位朋友。"
    cols = "start string, destinations array<string>, activities array<string>, companions array<string>, unnamed long, event_names array<string>, loose long"
    rows = [("2025-01-02", ["X", "Y", "Z"], ["a", "b"], ["Ann"], 0, ["E"], 2), ("2025-01-02", [], [], [], 3, ["E", "F"], 0), (None, [], [], [], 0, [], 0), ("2025-01-02", [], ["a"], [], 0, [], 0)]
    got = narrative.journey_texts(spark.createDataFrame(rows, cols)).collect()
    assert [r.name for r in got] == ["X与Y之旅", "2025-01的旅行", "一段旅行", "2025-01·a之旅"]
    assert got[0].note == "2025-01-02，和Ann一起去了X、Y、Z。旅途中记录了a、b。另外保留了2张旅途中的零散照片。" and got[1].note == "2025-01-02，和朋友们一起去了外地。主要记录包括E、F。" and got[2].note == "去了外地。"


def test_backend_is_asked_once_after_a_failure():
    calls = []

    def opener(request, timeout):
        calls.append(request)
        if len(calls) > 1:
            raise OSError("down")
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": '{"name": "N", "summary": "S"}'}}]}).encode())

    backend = narrative.chat_backend("http://x", "m", "key", opener=opener)
    assert backend("event_name_and_summary", {})["name"] == "N"
    for _ in range(3):
        with pytest.raises(narrative.BackendUnavailable):
            backend("event_name_and_summary", {})
    assert len(calls) == 2


def test_annotations(spark):
    old = spark.createDataFrame([("L", "events", "1", "Old", "note", "user")], schema.ANNOTATIONS)
    new = spark.createDataFrame([("L", "events", "1", " ", "new note", "llm", 0), ("L", "events", "2", "Two", None, None, 1)], schema.ANNOTATIONS + ", ord long")
    kept = narrative.upsert_annotations(old, new)
    assert {(r.item_id, r.name, r.note) for r in kept.collect()} == {("1", "Old", "new note"), ("2", "Two", None)}
    items = spark.createDataFrame([("L", 1, "Auto"), ("L", 3, "Three")], "library_id string, event_id long, name string")
    assert {(r.event_id, r.name, r.note) for r in narrative.overlay(items, kept, "events", "event_id").collect()} == {(1, "Old", "new note"), (3, "Three", None)}


def test_synchronization(spark, tmp_path):
    asset = {"id": "r1", "updatedAt": "v1", "localDateTime": "2025-01-01T00:00:00", "originalFileName": "x.jpg", "exifInfo": {"latitude": "1.5", "longitude": "bad", "make": " Maker ", "model": None, "exifImageWidth": 7}}
    (tmp_path / "assets.json").write_text(json.dumps([asset, {"id": "r/2"}]))
    got = {r.id: r for r in sync.record_from_asset(files.read_assets(spark, f"file://{tmp_path}/assets.json"), "/cache").collect()}
    assert (got["r1"].latitude, got["r1"].longitude, got["r1"].gps_source, got["r1"].camera, got["r1"].width, got["r1"].path) == (1.5, None, "immich", "Maker", 7, "/cache/r1.jpg")
    assert got["r/2"].path == "/cache/r%2F2.jpg" and got["r/2"].camera is None and got["r/2"].captured_at is None
    known = spark.createDataFrame([("l", "local", None, [1.0]), ("r1", "immich", "v1", [1.0]), ("old", "immich", "v0", [1.0]), ("f", "immich", "v0", [1.0])], "id string, source string, source_updated_at string, embedding array<double>")
    remote = spark.createDataFrame([("r1", "v1", True, False), ("new", "v1", False, False), ("f", "v1", True, True), ("g", "v1", True, True)], "id string, updated_at string, cached boolean, failed boolean")
    plan = sync.plan_sync(known, remote)
    assert {tuple(r) for r in plan.collect()} == {("l", "local"), ("r1", "reuse"), ("old", "stale"), ("new", "index"), ("f", "failed"), ("g", "drop")}
    assert tuple(sync.sync_counts(sync.plan_sync(known, remote, prune=True)).first()) == (4, 1, 1, 1, 2)
    fetched = spark.createDataFrame([("new", "immich", "v1")], "id string, source string, source_updated_at string")
    assert sorted(col(sync.merge_sync(known, fetched, plan), "id")) == ["f", "l", "new", "old", "r1"]
    assert col(sync.unknown_ids(spark.createDataFrame([("r1",), ("l",), ("zz",)], "id string"), known), "id") == ["l", "zz"]
    pages = {1: {"assets": {"items": [{"id": 1}, {}], "nextPage": "2"}}, 2: {"assets": {"items": [{"id": 2}], "nextPage": None}}}
    assert [a["id"] for a in files.fetch_assets(lambda body: pages[body["page"]])] == [1, 2]
    with pytest.raises(ValueError):
        list(files.fetch_assets(lambda body: {"assets": {"items": [], "nextPage": 1}}))
    assert files.api_url(" http://h/ ") == files.api_url("http://h/api/") == "http://h/api" and files.masked_error("key=abc", "abc") == "key=***"


def test_files(spark, tmp_path):
    assert files.read_photos(spark, f"file://{tmp_path}/none").count() == 0
    p = spark.createDataFrame([("L", 0, "a", "/r/x y.jpg", 1, 1, "2025-01-01", "exif", 1.0, None, None, None, [1.0], None, (1.0, 1.0, 1.0, 1.0, 1.0, 0.5), "local", None, None), ("M", 0, "b", "/r/z.jpg", *[None] * 11, "local", None, "orig.jpg")], schema.PHOTOS)
    files.write_photos(p, f"file://{tmp_path}/index")
    again = files.read_photos(spark, f"file://{tmp_path}/index").where("library_id = 'L'")
    assert col(again, "captured_epoch") == [1735689600.0] and "PartitionFilters: [isnotnull(library_id" in again._jdf.queryExecution().executedPlan().toString()
    files.write_csv(p.where("library_id = 'M'"), f"file://{tmp_path}/csv")
    assert sorted(x.read_text() for x in (tmp_path / "csv").glob("part*")) == ["\ufeffphoto_id,filename,captured_at,latitude,longitude,quality_score\nb,orig.jpg,,,,\n"]
    best = files.best_shot_names(p.withColumn("score", F.col("quality.score")), 99).collect()
    assert [(r.rank, r.archive_name) for r in best] == [(1, "rank01-a-x_y.jpg"), (2, "rank02-b-orig.jpg")]
    (tmp_path / "l.csv").write_bytes("﻿photo_id,event_id\na,E1\n".encode())
    (tmp_path / "m.json").write_text('{"a": "E2"}')
    (tmp_path / "n.json").write_text('[{"photo_id": "a", "journey_id": "J"}]')
    sheets = [files.read_label_sheet(spark, f"file://{tmp_path}/{n}").first() for n in ("l.csv", "m.json", "n.json")]
    assert [(s.photo_id, s.event_id, s.journey_id, s.label_confidence) for s in sheets] == [("a", "E1", None, None), ("a", "E2", None, "high"), ("a", None, "J", None)]
    with pytest.raises(ValueError):
        files.read_label_sheet(spark, "x.txt")
    for i, text in (("0" * 12, json.dumps({"id": "0" * 12, "updated_at": "2"})), ("1" * 12, json.dumps({"id": "1" * 12, "updated_at": "3"})), ("2" * 12, "not json")):
        (tmp_path / "projects" / i).mkdir(parents=True)
        (tmp_path / "projects" / i / "project.json").write_text(text)
    projects = files.read_projects(spark, f"file://{tmp_path}/projects")
    assert col(projects, "id") == ["1" * 12, "0" * 12]
    assert files.touched(projects, "0" * 12, "9", status="ready").where("status = 'ready'").first().updated_at == "9"
    with pytest.raises(ValueError):
        files.touched(projects, "0" * 12, "9", colour="red")
