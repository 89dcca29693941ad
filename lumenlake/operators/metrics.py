"""Measures of groupings, of retrieval and of label sheets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.lineage import durable

INVALID = ("", "-1", "review")
CONFIDENCE = {"low": 0, "medium": 1, "high": 2}


def valid_label(label: Column) -> Column:
    return label.isNotNull() & ~label.cast("string").isin(*INVALID)


def _pairs(n: Column) -> Column:
    return F.sum(n * (n - 1) / 2)


def _scores(tp: Column, predicted: Column, expected: Column) -> list[Column]:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(tp, predicted), ratio(tp, expected)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1")]


def _pair_count(df: DataFrame, keys: list[str], into: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").cast("double").alias("__n")).agg(F.coalesce(_pairs(F.col("__n")), F.lit(0.0)).alias(into))


def pairwise_metrics(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 over pairs of rows (predicted, expected); rows without a valid expectation are left out.

    Pairs are counted from the sizes of groups and of their intersections, so no pair is ever formed.
    """
    known = rows.where(valid_label(F.col("expected")))
    found = known.where(valid_label(F.col("predicted")))
    counts = _pair_count(found, ["predicted", "expected"], "tp").crossJoin(_pair_count(found, ["predicted"], "p")).crossJoin(_pair_count(known, ["expected"], "e"))
    return counts.select(*_scores(F.col("tp"), F.col("p"), F.col("e")))


def clustering_f1(rows: DataFrame) -> DataFrame:
    """The same over rows with numeric labels; labels below 0 are in no group, but such rows can be wrongly joined."""
    predicted, expected = rows.where("predicted >= 0"), rows.where("expected >= 0")
    counts = (_pair_count(predicted.where("expected >= 0"), ["predicted", "expected"], "tp").crossJoin(_pair_count(predicted, ["predicted"], "p"))
              .crossJoin(_pair_count(expected, ["expected"], "e")))
    return counts.select(*_scores(F.col("tp"), F.col("p"), F.col("e")))


def boundary_metrics(rows: DataFrame) -> DataFrame:
    """Strict and tolerant scores of rows (predicted, strict, tolerant), and how merged pairs fail the strict labels.

    tolerated: joined, apart under the strict and together under the tolerant labels; hard: joined, apart under the tolerant
    ones.
    All counts come from group sizes (inclusion and exclusion), not from pairs.
    """
    strict = pairwise_metrics(rows.withColumn("expected", F.col("strict"))).select(*(F.col(c).alias(f"strict_{c}") for c in ("precision", "recall", "f1")))
    tolerant = pairwise_metrics(rows.withColumn("expected", F.col("tolerant"))).select(*(F.col(c).alias(f"tolerant_{c}") for c in ("precision", "recall", "f1")))
    joined = rows.where(valid_label(F.col("predicted")))
    both = joined.where(valid_label(F.col("tolerant")))
    exact = both.where(valid_label(F.col("strict")))
    parts = [_pair_count(both, ["predicted", "tolerant"], "alike"), _pair_count(exact, ["predicted", "tolerant", "strict"], "alike_strict"), _pair_count(both, ["predicted"], "merged")]
    counts = reduce(lambda a, b: a.crossJoin(b), parts)
    tolerated, hard = F.col("alike") - F.col("alike_strict"), F.col("merged") - F.col("alike")
    return strict.crossJoin(tolerant).crossJoin(counts.select(tolerated.cast("long").alias("tolerated_merge_pairs"), hard.cast("long").alias("hard_false_positive_pairs")))


def recall_at_k(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, queries, mean_recall) of results (query_id, rank, id) against relevant (query_id, id); rank is from 1.

    A query without relevant ids has recall 0.
    """
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("total"))
    # Relevant ids are as many as the corpus may be: packed they look small enough to be broadcast, but are not.
    hits = results.join(relevant.select("query_id", "id").hint("merge"), ["query_id", "id"], "left_semi")
    counts = hits.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks))
    asked = results.select("query_id").unionByName(relevant.select("query_id")).distinct()
    return _mean_recall(asked.join(totals, "query_id", "left").join(counts, "query_id", "left"), ks)


def recall_of_classes(results: DataFrame, queries: DataFrame, corpus: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall_at_k where all of corpus(id, label) with the label of a query (query_id, label) is relevant.

    Classes are counted and only results get their labels; no list of relevant pairs is made.
    """
    sizes = corpus.groupBy("label").agg(F.count("*").alias("total"))
    labelled = results.join(queries, "query_id").join(corpus.select("id", F.col("label").alias("found")), "id")
    hits = labelled.where("label = found").groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks))
    return _mean_recall(queries.join(sizes, "label", "left").join(hits, "query_id", "left"), ks)


def _mean_recall(each: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    share = each.select("query_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.coalesce(F.col(f"k{k}"), F.lit(0)) / F.col("total")).alias("r")) for k in ks))).alias("x"))
    return share.groupBy(F.col("x.k").alias("k")).agg(F.count("*").alias("queries"), F.avg(F.coalesce("x.r", F.lit(0.0))).alias("mean_recall"))


def latency_summary(latencies: DataFrame) -> DataFrame:
    """Mean and 95th percentile of milliseconds per method; 0 where there are none."""
    return latencies.groupBy("method").agg(F.count("ms").alias("count"), F.coalesce(F.avg("ms"), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.percentile("ms", F.lit(0.95)), F.lit(0.0)).alias("p95_ms"))


def confident(confidence: Column, minimum: str) -> Column:
    """Whether a label is sure enough: blank counts as high, an unknown word as low."""
    low = F.lower(F.trim(F.coalesce(confidence, F.lit(""))))
    level = F.when(low == "", 2)
    for word, n in CONFIDENCE.items():
        level = level.when(low == word, n)
    return level.otherwise(0) >= CONFIDENCE[minimum]


def annotation_labels(sheet: DataFrame, field: str, minimum: str = "low", fallback: str | None = None) -> DataFrame:
    """(photo_id, label) of a label sheet (photo_id, ord, label_confidence, ...); the last row of a photo wins."""
    blank_as_null = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    label = blank_as_null(field) if fallback is None else F.coalesce(blank_as_null(field), blank_as_null(fallback))
    kept = sheet.where(confident(F.col("label_confidence"), minimum)).withColumn("label", label).where("label is not null")
    last = Window.partitionBy("photo_id").orderBy(F.desc("ord"))
    return kept.withColumn("__n", F.row_number().over(last)).where("__n = 1").select("photo_id", "label")


def resolve_labels(labels: DataFrame, photos: DataFrame) -> DataFrame:
    """(id, label): labels whose photo_id is a photo's id, file name or file name without suffix; the last photo wins."""
    name = F.coalesce("original_filename", F.element_at(F.split("path", "/"), -1))
    keys = photos.select("id", "ord", F.explode(F.array_distinct(F.filter(F.array("id", name, F.regexp_replace(name, r"\.[^.]*$", "")), lambda k: k.isNotNull()))).alias("photo_id"))
    last = Window.partitionBy("photo_id").orderBy(F.desc("ord"))
    return keys.withColumn("__n", F.row_number().over(last)).where("__n = 1").join(labels, "photo_id").select("id", "label").distinct()


def coverage(rows: DataFrame) -> DataFrame:
    """Share of rows with a valid expectation that were given a group."""
    known = rows.where(valid_label(F.col("expected")))
    return known.agg(F.coalesce(F.avg(valid_label(F.col("predicted")).cast("int")), F.lit(0.0)).alias("coverage"))


def with_labels(photos: DataFrame, labels: DataFrame, into: str, column: str = "label", default: str | None = "-1") -> DataFrame:
    """photos with the label that labels(library_id, id, column) give them; of several of a photo the last (by ord, if
    there is one, else the greatest) counts, and one without any gets the default."""
    order = [F.desc("ord")] if "ord" in labels.columns else []
    last = Window.partitionBy("library_id", "id").orderBy(*order, F.desc(column))
    one = labels.withColumn("__n", F.row_number().over(last)).where("__n = 1").select("library_id", "id", F.col(column).cast("string").alias("__label"))
    return photos.join(one, ["library_id", "id"], "left").withColumn(into, F.coalesce("__label", F.lit(default))).drop("__label")


def _own(column: Column) -> Column:
    """A group's number as a label that is its own over all libraries; null stays."""
    return F.when(column.isNotNull(), F.concat_ws("/", F.col("library_id").cast("string"), column.cast("string")))


def event_labels(members: DataFrame) -> DataFrame:
    """(library_id, id, label) of the members of events."""
    return members.select("library_id", "id", _own(F.col("event_id")).alias("label"))


def journey_labels(members: DataFrame, journeys: DataFrame, stop: str | None = None) -> DataFrame:
    """(library_id, id, label): the journey of a photo's event; with `stop`, a column of journeys, journey:stop."""
    label = F.col("journey_id") if stop is None else F.concat_ws(":", F.col("journey_id").cast("string"), F.col(stop).cast("string"))
    return members.select("library_id", "id", "event_id").join(journeys, ["library_id", "event_id"]).select("library_id", "id", _own(label).alias("label"))


def evaluate_event_strategies(photos: DataFrame, expected: DataFrame, find: Callable[[str], DataFrame], strategies: tuple[str, ...]) -> DataFrame:
    """(strategy, precision, recall, f1) of every strategy's events, which find(strategy) gives, against expected
    labels (library_id, id, label); a photo without one is left out."""
    # Written out, as every strategy reads the first and every measure reads the others several times.
    known = durable(with_labels(photos.select("library_id", "id"), expected, "expected"))
    each = [pairwise_metrics(durable(with_labels(known, event_labels(find(s)), "predicted").select("expected", "predicted"))).select(F.lit(s).alias("strategy"), "*") for s in strategies]
    return reduce(DataFrame.unionByName, each)


def evaluate_event_boundaries(photos: DataFrame, strict: DataFrame, tolerant: DataFrame, members: DataFrame) -> DataFrame:
    """boundary_metrics of the events of members against two sets of labels (library_id, id, label)."""
    rows = with_labels(with_labels(photos.select("library_id", "id"), strict, "strict"), tolerant, "tolerant")
    return boundary_metrics(durable(with_labels(rows, event_labels(members), "predicted").select("strict", "tolerant", "predicted")))


def evaluate_labels(photos: DataFrame, expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """precision, recall, f1 and coverage of predicted labels against expected ones, both (library_id, id, label)."""
    rows = with_labels(with_labels(photos.select("library_id", "id"), expected, "expected", default=None), predicted, "predicted")
    rows = durable(rows.select("expected", "predicted"))
    return pairwise_metrics(rows).crossJoin(coverage(rows))  # single rows


def evaluate_journeys(photos: DataFrame, members: DataFrame, journeys: DataFrame, expected: DataFrame) -> DataFrame:
    """evaluate_labels of journeys (library_id, event_id, journey_id), whose events members gives."""
    return evaluate_labels(photos, expected, journey_labels(members, journeys))


def evaluate_journey_hierarchy(photos: DataFrame, members: DataFrame, stopped: DataFrame, parents: DataFrame, stops: DataFrame) -> DataFrame:
    """evaluate_labels on two levels: parent_journey, and journey_stop with labels journey:stop; stopped has stop_id."""
    levels = (("parent_journey", parents, None), ("journey_stop", stops, "stop_id"))
    each = [evaluate_labels(photos, expected, journey_labels(members, stopped, stop)).select(F.lit(level).alias("level"), "*") for level, expected, stop in levels]
    return reduce(DataFrame.unionByName, each)


def evaluate_query_strategies(cases: DataFrame, corpus: DataFrame, encode: Callable[[DataFrame], DataFrame], strategies: tuple[str, ...], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(strategy, k, queries, mean_recall) of cases (query, relevant_ids): each query's texts under a strategy are encoded
    (encode: id, text to id, embedding), their mean is searched for in corpus (id, ord, embedding)."""
    from lumenlake.functions import text, vector
    from lumenlake.operators.search import batch_search

    asked = cases.select("query").distinct()
    relevant = cases.select(F.col("query").alias("query_id"), F.explode("relevant_ids").alias("id")).distinct()
    means = []
    for i, s in enumerate(strategies):
        texts = asked.select(F.col("query"), F.explode(text.query_texts(F.col("query"), s)).alias("text"))
        vectors = texts.join(encode(texts.select(F.col("text").alias("id"), "text").distinct()), F.col("text") == F.col("id")).select("query", "embedding")
        means.append(vector.mean_vectors(vectors, ["query"], "embedding").select(F.concat(F.lit(f"{i} "), "query").alias("query_id"), F.col("centroid").alias("embedding")))
    # All strategies ask at once, so that the corpus is encoded and read once.
    found = durable(batch_search(reduce(DataFrame.unionByName, means), corpus, max(ks)))
    of = lambda i: found.where(F.startswith("query_id", F.lit(f"{i} "))).withColumn("query_id", F.substring("query_id", len(f"{i} ") + 1, 1 << 30))
    return reduce(DataFrame.unionByName, [recall_at_k(of(i), relevant, ks).select(F.lit(s).alias("strategy"), "*") for i, s in enumerate(strategies)])
