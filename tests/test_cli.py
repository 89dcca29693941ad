"""The commands, on a small stored index."""

import json

import pytest

from lumenlake import cli
from lumenlake.sources import files
from tests.helpers import photos


def test_commands(spark, tmp_path, capsys):
    rows = [{"captured_at": f"2025-01-0{d}T10:00:00", "latitude": 30.0, "longitude": 104.0, "embedding": [1.0, 0.1 * d], "phash": None} for d in (1, 2, 3)]
    stored = str(tmp_path / "index")
    files.write_photos(photos(spark, *rows).drop("captured_wall", "captured_epoch", "score", "phash_hi", "phash_lo"), stored)

    def run(*argv, want=0):
        assert cli.main([*argv], spark) == want
        out = capsys.readouterr()
        return [json.loads(line) for line in (out.out if want == 0 else out.err).splitlines() if line.startswith("{")]

    assert [r["photo_ids"] for r in run("events", "--index", stored, "--strategy", "time_only")] == [["a"], ["b"], ["c"]]
    assert run("similar", "--index", stored, "--window-seconds", "1") == []
    assert run("search", "x", "--index", stored, "--bbox", "10", "0", "5", "1", want=2)[0]["error"].startswith("bbox")
    assert run("search", "x", "--index", stored, "--bbox", "-95", "0", "5", "1", want=2)[0]["error"].startswith("latitude")
    faces = [{"id": f"f{i}", "photo_id": f"p{i}", "bbox": [0.0] * 4, "embedding": v, "det_score": 0.5} for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9]])]
    (tmp_path / "faces.json").write_text(json.dumps({"faces": faces, "groups": [], "noise_face_ids": []}))
    made, merged, named = (str(tmp_path / n) for n in ("people", "merged", "named"))
    assert run("people-cluster", str(tmp_path / "faces.json"), "--people", made, "--eps", "0.05") == [{"library_id": "default", "persons": 2}]
    assert [r["id"] for r in run("people-merge", "0", "1", "--people", made, "--output", merged, "--index", stored)] == [0]
    assert run("people-name", "0", "Ann", "--people", merged, "--output", named, "--index", stored)[0]["name"] == "Ann"
    assert run("people-remove", "7", "p1", "--people", merged, "--output", named, "--index", stored, want=2)[0]["error"].startswith("unknown person")
    assert len(cli.parser()._subparsers._group_actions[0].choices) == 11
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)
