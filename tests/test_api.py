"""The library object end to end, and what remains when the training-data operators are gone."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest

from lumenlake.api import Library
from tests.helpers import col, photos


def test_library(spark):
    rows = [{"captured_at": f"2025-0{m}-0{d}T10:00:00", "latitude": 30.0, "longitude": 104.0, "embedding": [1.0, 0.0], "score": 0.1 * d} for m in (1, 2, 3) for d in (1, 2)]
    rows += [{"captured_at": f"2025-04-1{d}T10:00:00", "latitude": 22.3, "longitude": 114.2, "embedding": [0.0, 1.0], "score": 0.5} for d in (1, 2)]
    lib = Library(photos(spark, *rows))
    found, counts = lib.search("photos last year", 3, today="2026-01-02", encode=lambda t: [1.0, 0.1])
    assert len(found.collect()) == 3 and counts.first().candidate_count == 8
    assert counts.first().metadata_fallback is False
    trip = lib.journeys()
    assert [(r.stop_id, r.event_count) for r in trip["stops"].collect()] == [(0, 2)] and trip["journeys"].first().confidence == 1
    assert col(lib.best_shots(1), "id") == ["g"] and lib.similar_groups(window_seconds=1).count() == 0
    for bad in ({"top_k": 0}, {"strategy": "x"}, {"bbox": [1.0]}):
        with pytest.raises(ValueError):
            lib.search("x", **bad)
    assert np.isclose(lib.places().where("is_home").first().latitude, 30.0)


def test_queries_survive_without_the_optional_modules(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("lumenlake.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "search_topk" in e.queries() and "pipeline" not in e.queries() and not any(n.startswith("op") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_queries_survive_the_deletion_of_the_optional_folders(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/lumenlake", tmp_path / "lumenlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    run = lambda code: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    left = "import __spark_entry__ as e; q = e.queries(); assert 'search_topk' in q and 'csv_export' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    assert run(left).returncode == 0
    # A mistake inside of the optional package is not passed over.
    (tmp_path / "lumenlake/llm").mkdir()
    (tmp_path / "lumenlake/llm/__init__.py").write_text("")
    (tmp_path / "lumenlake/llm/queries.py").write_text("import lumenlake.llm.misspelt\n")
    assert "misspelt" in run(left).stderr
    (tmp_path / "lumenlake/llm/queries.py").unlink()
    assert run(left).returncode != 0
