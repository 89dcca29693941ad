"""The registered queries against DuckDB on the driver's smallest tables, where these are there."""

import glob
import math
import os

import duckdb
import pytest

from lumenlake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_every_query_has_an_oracle_or_is_known_to_have_none():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"journeys_attach", "events_people", "ann_report"}  # held against brute force in tests/test_events.py and test_search.py
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and catalog.FLAGSHIP in catalog.queries()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_placed_events_carry_no_vectors(spark):
    """Members are small, and places are found without the table of vectors."""
    from lumenlake.plans import catalog

    placed, members = catalog._placed_events(spark, "/root/testdata/sf0.001")
    assert "embedding" not in members.columns and not any("embeddings" in f for f in placed.inputFiles())


def test_the_photo_view_sends_half_a_vector(spark):
    """Photos are dealt by library with their own vector; what their library shares is added behind the shuffle."""
    from lumenlake.operators import events
    from lumenlake.plans.testbed import photos

    plan = events.sequential_events(photos(spark, "/root/testdata/sf0.001")).select("event_id")._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning(library_id" in line]
    assert sent and "zip_with" not in "".join(plan.split("Exchange hashpartitioning(library_id")[1:]) and plan.count("Window") >= 1


def test_stops_are_found_once_for_both_levels(spark, monkeypatch):
    from lumenlake.operators import metrics
    from lumenlake.plans import catalog

    seen, evaluate = [], metrics.evaluate_journey_hierarchy
    monkeypatch.setattr(metrics, "evaluate_journey_hierarchy", lambda photos, members, stopped, *labels: seen.append(stopped) or evaluate(photos, members, stopped, *labels))
    assert catalog.journey_hierarchy(spark, "/root/testdata/sf0.001").count() == 2
    assert "Window" not in seen[0]._jdf.queryExecution().executedPlan().toString()
