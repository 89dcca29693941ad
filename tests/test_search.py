"""Search plans, filters, vector search, query texts and approximate indexes."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import text
from lumenlake.operators import ann, metrics, search
from lumenlake.operators.ann import Index, benchmark
from lumenlake.operators.graph import Graph
from lumenlake.plans.search_plan import Box, Filter, apply_filter, plan_search, semantic_text, time_windows
from tests.helpers import col, photos


def test_order_cut_and_least_score(spark):
    p = photos(spark, {"embedding": [1.0, 0.0]}, {"embedding": [0.0, 1.0]}, {"embedding": None}, {"embedding": []}, {"embedding": [2.0, 0.0]}, {"embedding": [0.0, 0.0]})
    assert col(search.search(p, [1.0, 0.0], 2), "id") == ["a", "e"]
    assert col(search.search(p, [1.0, 0.0], 20), "id") == ["a", "e", "b", "f"]
    assert col(search.search(p, [1.0, 0.0], 1, 2.0), "id") == [] and search.search(p, [1.0, 0.0], -3).count() == 0
    assert "TakeOrderedAndProject" in search.search(p, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()


def test_plans():
    day = "2026-08-17"
    p = plan_search("去年的海边照片", today=day)
    assert (p.filter.start, p.filter.end, p.time_expression, p.semantic) == (datetime(2025, 1, 1), datetime(2026, 1, 1), "去年", "的海边")
    assert plan_search("photos from last year in Rome", today=day).semantic == "last year Rome"
    assert plan_search("2024 年 dog", today=day).filter.start == datetime(2024, 1, 1)
    assert plan_search("上月", today="2026-01-09").filter.start == datetime(2025, 12, 1) and plan_search("上月", today="2026-01-09").filter.end == datetime(2026, 1, 1)
    assert plan_search("this year", start=date(2020, 2, 3), today=day).filter == Filter(datetime(2020, 2, 3), datetime(2027, 1, 1))
    assert plan_search("x", end="2024-05-06T07:08:09Z", today=day).filter.end == datetime(2024, 5, 6, 7, 8, 9)
    assert semantic_text("photos", None) == "photos"
    with pytest.raises(ValueError):
        plan_search("  ")


def test_windows_as_columns_agree_with_plans(spark):
    words = ["2024年 beach", "LAST  year", "本年", "last month", "上个月", "plain", "2031 年 去年"]
    got = {r.query: r for r in time_windows(spark.createDataFrame([(w,) for w in words], "query string"), "2026-01-31").collect()}
    for w in words:
        p = plan_search(w, today="2026-01-31")
        assert got[w].window_start == (p.filter.start.date() if p.filter.start else None) and got[w].window_end == (p.filter.end.date() if p.filter.end else None) and got[w].time_expression == p.time_expression


def test_only_reliable_times_and_places_pass(spark):
    p = photos(spark, {"captured_at": "2025-06-01T00:00:00+08:00", "latitude": 30.5, "longitude": 120.5, "gps_source": "exif"}, {"captured_at": "2025-06-01", "captured_at_source": "filesystem", "latitude": 30.5, "longitude": 120.5}, {"captured_at": None, "latitude": 31.0, "longitude": 121.0, "gps_source": "exif"}, {"captured_at": "2026-01-01T00:00:00", "latitude": 31.1, "longitude": 120.0, "gps_source": "exif"})
    year = Filter(datetime(2025, 1, 1), datetime(2026, 1, 1))
    assert col(apply_filter(p, year), "id") == ["a"]
    assert col(apply_filter(p, Filter(year.start, year.end, reliable_time=False)), "id") == ["a", "b"]
    assert col(apply_filter(p, Filter(box=Box(30, 120, 31, 121))), "id") == ["a", "c"]
    assert apply_filter(p, Filter(), True).count() == 4
    known = apply_filter(p, year, True)
    assert [(r.id, r.metadata_fallback) for r in known.collect()] == [("a", False)]
    lost = apply_filter(p.where("id in ('b', 'c')"), Filter(year.start, year.end, Box(0, 0, 1, 1)), True)
    assert [(r.id, r.metadata_fallback) for r in lost.collect()] == [("b", True), ("c", True)]


def test_filters_reach_the_scan(spark, tmp_path):
    p = photos(spark, {"captured_at": "2025-06-01T00:00:00"}).select("id", "captured_wall", "captured_at_source", "latitude", "embedding")
    p.write.parquet(f"{tmp_path}/p")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = apply_filter(spark.read.parquet(f"{tmp_path}/p"), Filter(datetime(2025, 1, 1))).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(captured_wall" in plan and "EqualTo(captured_at_source,exif)" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_batch_search_is_the_single_one_for_each(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 8))
    corpus = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(c)] + [(900, 900, [1.0]), (901, 901, None)], "id long, ord long, embedding array<double>")
    got = search.batch_search(corpus.where("id < 270").select(F.col("id").alias("query_id"), "embedding"), corpus, 4)
    unit = c / np.linalg.norm(c, axis=1, keepdims=True)
    want = {(q, r + 1): int(i) for q in range(270) for r, i in enumerate(np.argsort(-(unit @ unit[q]), kind="stable")[:4])}
    assert {(r.query_id, r.rank): r.id for r in got.collect()} == want


def test_expansion_and_prompts(spark):
    q = spark.createDataFrame([("beach ",), ("vacation",), ("blue car",), ("thing",), ("BIRTHDAY",)], "q string")
    got = {r.q: r for r in q.select("q", text.expand_query(F.col("q")).alias("e"), *(text.query_texts(F.col("q"), s).alias(s) for s in text.QUERY_STRATEGIES)).collect()}
    assert got["beach "].e == ["beach", "a beach", "a seaside landscape", "ocean and beach"] and len(got["thing"].prompt_ensemble) == 5 and got["thing"].raw_clip == ["thing"]
    assert "a cat" in got["vacation"].e  # by substring
    assert got["blue car"].e == ["blue car", "a photo of blue car", "a photo showing blue car"] and got["thing"].e == ["thing", "a photo of thing"] and got["BIRTHDAY"].e[1] == "a birthday party"


def test_hash_encoder_in_sql_and_on_the_driver(spark):
    texts = ["A red_car at-noon", "car", "  ", "Ünïcode"]
    got = {r.id: r.embedding for r in text.hash_encode(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert len(got[i]) == 256 and np.allclose(got[i], text.hash_vector(t)) and np.linalg.norm(got[i]) == pytest.approx(1)
    assert np.allclose(text.encode_query(["car", "car"]), text.hash_vector("car"))


def test_what_the_encoder_knows_is_small():
    """Five bytes a slot, and no more tokens than KNOWN and those of one step; results do not depend on what is forgotten."""
    encoder = text._Encoder(256)
    texts = [" ".join(f"w{i}" for i in range(at, at + 20_000)) for at in range(0, 400_000, 20_000)]
    got = list(encoder.run(texts))
    assert len(encoder.known) <= (1 << 17) + 2 * encoder.AT_ONCE and encoder.slots.nbytes + encoder.signs.nbytes == 60 * len(encoder.known)
    assert np.allclose(got[0], text.hash_vector(texts[0])) and np.allclose(got[-1], text.hash_vector(texts[-1]))


def test_indexes(spark):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, i, rng.normal(size=8).tolist()) for i in range(60)], "id long, ord long, embedding array<double>").cache()
    report = {r["method"]: r for r in benchmark(p, [rng.normal(size=8).tolist() for _ in range(2)], ("exact", "graph", "ivf", "lsh", "nope"))}
    assert report["exact"]["recall_at_10"] == 1 and report["graph"]["recall_at_10"] >= 0.95 and report["ivf"]["recall_at_10"] >= 0.9 and report["lsh"]["recall_at_10"] >= 0.9 and not report["nope"]["available"]
    assert Index(p, "faiss_flat").memory_bytes().first()[0] == 60 * 8 * 4
    with pytest.raises(ValueError):
        Index(p, "other")


def test_graphs_find_neighbours_and_read_little():
    """Recall against brute force and the share of vectors read, on vectors with and without structure."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 64))
    for x, most in ((centre[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 64)), 0.12), (rng.normal(size=(3000, 16)), 0.3)):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = Graph.of(x)
        assert [len(n) for n, _ in g.layers] == sorted((len(n) for n, _ in g.layers), reverse=True) and all((near < len(n)).all() for n, near in g.layers)
        assert g.layers[0][1].shape == (3000, 32) and (g.layers[0][1] >= 0).any(1).all()
        got, score, read = Graph.unpack(x, g.pack()).search(x[::15], 10)
        true = np.argsort(-(x[::15] @ x.T), axis=1)[:, :10]
        assert np.mean([np.isin(t, f).mean() for t, f in zip(true, got, strict=True)]) >= 0.97
        assert read.mean() <= most * len(x) and np.allclose(score[:, 0], 1, atol=1e-5)
    for few in (np.ones((1, 3)), np.eye(3), np.ones((50, 2)) / 2**0.5):
        got, _, _ = Graph.of(few).search(few, 10)
        assert (got[:, : min(10, len(few))] >= 0).all()
    assert Graph.of(np.zeros((0, 3))).search(np.zeros((0, 3)), 5)[0].shape[0] == 0


def test_graphs_of_shards_are_merged(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(10, 24))
    x = centre[rng.integers(0, 10, 1500)] + 0.3 * rng.normal(size=(1500, 24))
    p = spark.createDataFrame([(f"p{i}", i, v.tolist()) for i, v in enumerate(x)] + [("odd", 5000, [1.0, 2.0]), ("none", 5001, None)], "id string, ord long, embedding array<double>")
    asked = p.where("ord % 20 = 0").select(F.col("ord").alias("query_id"), "embedding")
    monkeypatch.setattr(ann, "SHARD", 400)
    index = Index(p, "hnsw")
    exact = search.batch_search(asked, p, 10)
    found = ann.recall(index.search_many(asked, 10), exact).first()
    assert found.recall >= 0.95 and found.queries == 76 and index.beam in ann.BEAMS
    read = {r.query_id: r.read for r in index.read_counts(asked).collect()}
    assert len(read) == 76 and read[5000] == 1 and np.mean([n for i, n in read.items() if i != 5000]) < 0.2 * 1500
    assert [r.id for r in index.search([1.0, 2.0], 3).collect()] == ["odd"]
    assert Index(p.limit(0), "graph").search_many(asked, 3).count() == 0


def test_graphs_of_many_shards_find_rows_of_other_shards(spark, monkeypatch):
    """A query is a node of one shard only, so the beam is tuned by vectors that are not in the graph."""
    x = np.random.default_rng(8).normal(size=(2400, 64))
    p = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "id long, ord long, embedding array<double>").cache()
    asked = p.where("ord % 20 = 0").select(F.col("ord").alias("query_id"), "embedding")
    monkeypatch.setattr(ann, "SHARD", 800)
    exact = search.batch_search(asked, p, 10)
    index = Index(p, "graph")
    assert ann.recall(index.search_many(asked, 10), exact).first().recall >= 0.93 and not index.checked
    monkeypatch.setattr(ann, "BEAMS", (10,))  # none is wide enough
    index = Index(p, "graph")
    assert ann.recall(index.search_many(asked, 10), exact).first().recall == 1 and index.checked
    assert {r.read for r in index.read_counts(asked).collect()} == {2400}


def _copied(spark, kinds=150, copies=20):
    """Vectors that are each there many times."""
    x = np.random.default_rng(5).normal(size=(kinds, 24))
    return spark.createDataFrame([(i, i, x[i % kinds].tolist()) for i in range(kinds * copies)], "id long, ord long, embedding array<double>")


def test_graphs_find_copies_and_what_a_check_adds(spark):
    p = _copied(spark)
    asked = p.where("ord % 60 = 0").select(F.col("ord").alias("query_id"), "embedding")
    exact = {(r.query_id, r.rank): r.id for r in search.batch_search(asked, p, 30).collect()}
    assert len(exact) == 50 * 30
    # A beam of 30 nodes, where 30 rows are 2 of them.
    assert ann.recall(Index(p, "graph", beam=30).search_many(asked, 30), search.batch_search(asked, p, 30), 30).first().recall >= 0.95
    m = np.random.default_rng(6).normal(size=(40, 6))[np.arange(120) % 40]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    nodes, node = ann._kinds_of(m)
    got = np.argsort(-(m[:9] @ nodes.T), axis=1)[:, [0, 2, 5, -1]]  # a graph that has missed near nodes
    got[0, 1:] = -1
    i, j, _ = ann._copies_of(m[:9], m, got, node, np.arange(120), 10, True)
    want_i, want_j, _ = search.best_of(m[:9], m, np.arange(120), 10)
    assert i.tolist() == want_i.tolist() and j.tolist() == want_j.tolist()
    i, j, _ = ann._copies_of(m[:9], m, got, node, np.arange(120), 10, False)
    assert (np.bincount(i) == [3] + [10] * 8).all() and set(j[i == 0]) == {0, 40, 80}


@pytest.mark.parametrize("kind", ["lsh", "ivf"])
def test_buckets_are_scored_by_products(spark, kind, monkeypatch):
    """No row for each pair of a query and a vector; a row that is met in several tables counts once."""
    p = _copied(spark)
    asked = p.where("ord % 40 = 0").select(F.col("ord").alias("query_id"), "embedding")
    index = Index(p, kind)
    found = index.search_many(asked, 10)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and dict(index.indexed.dtypes)["values"] == "array<double>"
    assert ann.recall(found, search.batch_search(asked, p, 10)).first().recall >= 0.9
    rows = index._keyed(index.rows, 1).select("key", "id")
    sought = index._keyed(index._asked(asked), getattr(index, "probes", 1)).select("query_id", "key")
    want = {r.query_id: r.n for r in sought.join(rows, "key").groupBy("query_id").agg(F.count_distinct("id").alias("n")).collect()}
    assert {r.query_id: r.read for r in index.read_counts(asked).collect()} == want


def test_many_queries_meet_groups_of_tiles(spark, monkeypatch):
    p = _copied(spark, 300, 2)
    asked = p.select(F.col("ord").alias("query_id"), "embedding")
    want = {(r.query_id, r.rank): r.id for r in search.batch_search(asked, p, 3).collect()}
    monkeypatch.setattr(search, "FEW", 10)
    many = search.batch_search(asked, p, 3)
    assert {(r.query_id, r.rank): r.id for r in many.collect()} == want and "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()


def test_rerank_decorate_and_list(spark):
    r = spark.createDataFrame([("a", 0.5, None, 0, "local"), ("b", 0.45, "2025", 1, "immich"), ("c", 0.5, "", 2, "local")], "id string, score double, captured_at string, ord long, source string")
    assert col(search.rerank(r, 0.1), "id") == ["b", "a", "c"] and col(search.rerank(r), "id") == ["a", "c", "b"]
    assert [(x.id, x.thumbnail_url) for x in search.decorated(r).where("source = 'immich'").collect()] == [("b", "/immich/assets/b/thumbnail")]
    ids = spark.createDataFrame([("0123456789ab",), ("0123456789AB",), (None,)], "i string")
    assert [x[0] for x in ids.select(search.project_id_is_valid(F.col("i"))).collect()] == [True, False, False]


def test_query_strategies_encode_the_corpus_once(spark):
    names, seen = ["large ring", "small box", "blue cup"], spark.sparkContext.accumulator(0)

    def noted(value):
        seen.add(1)
        return value

    rows = spark.createDataFrame([(str(i), names[i % 3]) for i in range(12)], "id string, text string").withColumn("text", F.udf(noted, "string").asNondeterministic()("text"))
    corpus = text.hash_encode(rows).select("id", F.col("id").cast("long").alias("ord"), "embedding")
    cases = spark.createDataFrame([(n, [str(i) for i in range(12) if names[i % 3] == n]) for n in names], "query string, relevant_ids array<string>")
    found = metrics.evaluate_query_strategies(cases, corpus, text.hash_encode, text.QUERY_STRATEGIES).collect()
    assert {(r.strategy, r.k): (r.queries, r.mean_recall) for r in found} == {(s, k): (3, 0.25 if k == 1 else 1.0) for s in text.QUERY_STRATEGIES for k in (1, 5, 10)}
    assert seen.value == 12
