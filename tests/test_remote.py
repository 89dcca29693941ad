"""The remote listing as a data source, albums, and people as folders."""

import json

import pytest
from pyspark.sql import functions as F

from lumenlake.sources import files, remote


def pages(folder, assets, size, total=True):
    """A listing landed page by page."""
    count = max(1, -(-len(assets) // size))
    for n in range(1, count + 1):
        page = {"items": assets[(n - 1) * size : n * size] + [{}], "nextPage": str(n + 1) if n < count else None}
        (folder / f"{n}.json").write_text(json.dumps({"assets": page | ({"total": len(assets)} if total else {})}))


@pytest.mark.parametrize("total", [True, False])
def test_pages_are_partitions(spark, tmp_path, total):
    assets = [{"id": f"a{i}", "updatedAt": f"{i:03d}", "width": i, "exifInfo": {"latitude": 1.5, "make": "M"} if i % 2 else None} for i in range(23)]
    pages(tmp_path, assets, 4, total)
    found = remote.read_remote(spark, remote.PageFolder(f"file://{tmp_path}"), 4, 3)
    assert found.rdd.getNumPartitions() == (3 if total else 1)
    got = {r.id: r for r in found.collect()}
    assert sorted(got) == sorted(a["id"] for a in assets) and got["a3"].exifInfo.latitude == "1.5" and got["a2"].exifInfo is None and got["a7"].width == 7
    with pytest.raises(ValueError):
        remote.Listing(None, 0, 1)
    pages(tmp_path, [], 4)
    assert remote.read_remote(spark, remote.PageFolder(f"file://{tmp_path}"), 4).count() == 0


def test_updates_are_a_stream(spark, tmp_path):
    """Each batch asks for what is newer than the last update seen; nothing comes twice."""
    (tmp_path / "in").mkdir()
    assets = [{"id": f"a{i}", "updatedAt": f"2024-01-{i + 1:02d}"} for i in range(5)]
    pages(tmp_path / "in", assets, 2)

    def run():
        q = (remote.stream_remote(spark, remote.PageFolder(f"file://{tmp_path}/in"), 2).select("id", "updatedAt").writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
        q.awaitTermination(120)

    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    pages(tmp_path / "in", [*assets, {"id": "a0", "updatedAt": "2024-02-01"}, {"id": "new", "updatedAt": "2024-02-02"}], 2)
    run()
    got = sorted((r.id, r.updatedAt) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert len(got) == 7 and ("a0", "2024-02-01") in got and ("new", "2024-02-02") in got


def test_albums_are_filled_by_the_tasks(spark, tmp_path):
    photos = spark.createDataFrame([(f"immich:{i}" if i % 2 else f"own{i}", "immich" if i % 2 else "local") for i in range(20)], "id string, source string")
    folder = str(tmp_path)

    def opener(path, body):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump([path, body], f)
        return {"id": "x1"}

    sent = files.create_album(opener, " Best ", photos.where("source = 'immich'"), photos, 3)
    assert sent.agg(F.sum("sent")).first()[0] == 10
    asked = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    assert ["/albums", {"albumName": "Best", "assetIds": []}] in asked
    assert sorted(i for path, body in asked if path == "/albums/x1/assets" for i in body["ids"]) == sorted(str(i) for i in range(1, 20, 2)) and max(len(b.get("ids", [])) for _, b in asked) <= 3
    with pytest.raises(ValueError, match="own0"):
        files.create_album(opener, "All", photos, photos)
    with pytest.raises(ValueError):
        files.create_album(opener, " ", photos.where("source = 'immich'"), photos)


def test_people_as_a_folder_and_as_a_document(spark, tmp_path):
    faces = spark.createDataFrame([("L", i, f"f{i}", f"p{i // 2}", [0.0, 1.0], [0.5, 0.25], 0.5) for i in range(6)], "library_id string, ord long, id string, photo_id string, bbox array<double>, embedding array<float>, det_score double")
    people = {"persons": spark.createDataFrame([(0, [1.0], "Ann"), (1, [0.5], None)], "id long, prototype array<double>, name string"),
              "person_faces": spark.createDataFrame([(0, "f0"), (0, "f1"), (1, "f2")], "person_id long, face_id string"),
              "person_photos": spark.createDataFrame([(0, "p0"), (1, "p1")], "person_id long, photo_id string"), "noise": spark.createDataFrame([("f3",), ("f4",), ("f5",)], "face_id string")}
    files.write_people(people, faces, f"file://{tmp_path}/folder")
    files.write_people_document(people, faces, f"file://{tmp_path}/document")
    for path in ("folder", "document"):
        got = files.read_people(spark, f"file://{tmp_path}/{path}", "L")
        for name, want in {**people, "faces": faces}.items():
            columns = [c for c in want.columns if c != "library_id"]
            assert sorted(map(str, got[name].select(*columns).collect())) == sorted(map(str, want.select(*columns).collect())), (path, name)
        assert got["removed"].count() == 0
