"""The service: requests handled directly, and one over a socket."""

import json
import threading
from urllib.request import Request, urlopen

import numpy as np
import pytest

from lumenlake.service import Service, serve
from tests.test_tables import png


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    return Service(spark, str(tmp_path_factory.mktemp("projects")), now=lambda: "2025-01-01T00:00:00")


def test_a_project_from_files_to_names(service, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    for i in range(3):
        (tmp_path / f"p{i}.png").write_bytes(png(rng.integers(0, 256, (12, 10, 3), dtype=np.uint8)))
    status, made = service.handle("POST", "/projects", {"name": "  My   trip "})
    assert status == 200 and made["name"] == "My trip"
    base = f"/projects/{made['id']}"
    assert [p["id"] for p in service.handle("GET", "/projects")[1]] == [made["id"]]
    assert service.handle("POST", f"{base}/analyze", {"directory": str(tmp_path)})[1]["photos"] == 3
    photos = service.handle("GET", f"{base}/photos")[1]
    assert [p["filename"] for p in photos] == ["p0.png", "p1.png", "p2.png"]
    status, found = service.handle("POST", f"{base}/search", {"query": "a beach", "top_k": 2})
    assert status == 200 and len(found["results"]) == 2 and found["total_count"] == 3
    events = service.handle("GET", f"{base}/events?strategy=time_only")[1]
    assert sum(len(e["photo_ids"]) for e in events) == 3
    service.handle("PUT", f"{base}/annotations", {"annotations": [{"kind": "events", "item_id": events[0]["event_id"], "name": "Start", "note": "n", "name_source": "user"}]})
    assert service.handle("GET", f"{base}/events?strategy=time_only")[1][0]["name"] == "Start" and len(service.handle("GET", f"{base}/annotations")[1]) == 1
    assert set(service.handle("GET", f"{base}/quality/{photos[0]['id']}")[1]) == {"id", "quality"}
    faces = [{"id": f"f{i}", "photo_id": photos[i % 3]["id"], "bbox": [0.0] * 4, "embedding": v, "det_score": 0.5} for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9]])]
    assert [p["id"] for p in service.handle("POST", f"{base}/people/cluster", {"faces": faces, "eps": 0.05})[1]] == [0, 1]
    assert service.handle("POST", f"{base}/people/name", {"id": 1, "name": "Ann"})[1][1]["name"] == "Ann"
    assert [p["id"] for p in service.handle("POST", f"{base}/people/merge", {"ids": [0, 1]})[1]] == [0]
    sheet = b"".join(service.handle("GET", f"{base}/export/csv")[1].parts).decode("utf-8-sig").splitlines()
    assert sheet[0].startswith("photo_id,filename") and [r.split(",")[0] for r in sheet[1:]] == [p["id"] for p in photos]
    assert [p["filename"] for p in service.handle("GET", f"{base}/photos?offset=1&limit=1")[1]] == ["p1.png"] and service.handle("GET", f"{base}/photos?limit=-1")[0] == 400
    content = service.handle("GET", f"{base}/photos/{photos[1]['id']}/content")[1]
    assert content.kind == "image/png" and b"".join(content.parts) == (tmp_path / "p1.png").read_bytes()
    assert service.handle("GET", f"{base}/people/0/cover")[1]["face_id"].startswith("f") and service.handle("GET", f"{base}/people/9/cover")[0] == 404
    monkeypatch.setattr("lumenlake.service.MOST_ROWS", 2)
    assert service.handle("GET", f"{base}/photos")[0] == 400  # not cut without a word
    assert len(service.handle("GET", f"{base}/photos?limit=2")[1]) == 2
    monkeypatch.undo()
    for method, path, body, want in (("GET", "/nothing", None, 404), ("GET", "/projects/000000000000/photos", None, 404), ("GET", "/projects/x/photos", None, 404), ("GET", f"{base}/quality/none", None, 404),
                                     ("POST", f"{base}/search", {"query": "x", "top_k": 0}, 400), ("POST", f"{base}/search", {}, 400), ("POST", "/projects", {"name": " "}, 400), ("POST", f"{base}/people/merge", {"ids": [5, 6]}, 400)):
        assert service.handle(method, path, body)[0] == want


def test_over_a_socket(service):
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_address[1]}"
        with urlopen(f"{address}/health") as answer:
            assert json.loads(answer.read()) == {"status": "ok"}
        with urlopen(Request(f"{address}/projects", data=b'{"name": "Other"}', method="POST")) as answer:
            made = json.loads(answer.read())
            assert made["name"] == "Other"
        photo = png(np.zeros((4, 4, 3), dtype=np.uint8))
        parts = b"".join(b'--XX\r\nContent-Disposition: form-data; name="files"; filename="' + name.encode() + b'"\r\n\r\n' + raw + b"\r\n" for name, raw in (("trip/a.png", photo), ("../b.png", photo), ("c.txt", b"no")))
        upload = Request(f"{address}/projects/{made['id']}/uploads", data=parts + b"--XX--\r\n", method="POST", headers={"Content-Type": "multipart/form-data; boundary=XX"})
        with urlopen(upload) as answer:
            got = json.loads(answer.read())
        assert got["accepted"] == ["trip/a.png"] and {r["path"]: r["reason"] for r in got["rejected"]} == {"../b.png": "unsafe path", "c.txt": "unsupported type"}
        assert service.handle("POST", f"/projects/{made['id']}/analyze", {"directory": got["directory"]})[1]["photos"] == 1
        photos = service.handle("GET", f"/projects/{made['id']}/photos")[1]
        with urlopen(f"{address}/projects/{made['id']}/photos/{photos[0]['id']}/content") as answer:
            assert answer.headers["Content-Type"] == "image/png" and answer.read() == photo
    finally:
        server.shutdown()
        server.server_close()
