"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two documents are linked if the sets of their runs of five words have a Jaccard similarity of at least 0.8.
Documents with equal sets form a class; only one of a class goes on, with the class's size.

1. Each class gets HASHES MinHash values; classes that agree in all values of a band meet in a bucket.  Buckets with
   the same members are one.  (At 32 bands of 4, a pair at 0.8 is missed with probability 5e-8, at 0.85 with 3e-10.)
2. In a bucket, pairs are compared some values at a time, and a pair is dropped as soon as the posterior probability
   that its similarity reaches the threshold (uniform prior) is below the tolerance.  All members are held against the
   bucket's leader first: those that survive belong together by it, so only pairs with another member are compared.
   What survives spans components that bring together all pairs that are to be verified.
3. In a component every class is held exactly against a pivot, the class of most documents, and known by its
   difference from it, from which intersections of two classes follow exactly: near copies differ little.  1 less the
   similarity is a distance, so two classes of which the distances to the pivot add up to less than the threshold's are
   linked, and two whose distances lie farther apart than that are not.  Classes are put into tiles by their distance
   to the pivot; pairs of tiles that are certain are counted, not formed, and pairs of classes of the others go through
   the same pruning, and the survivors are verified exactly.

Buckets and components of any size are dealt out as pairs of tiles: a task holds two tiles, and hands on sums per
class and a spanning forest, never all pairs.  Nothing of unbounded size reaches the driver or is broadcast.

Defined cases: a text of one to four words has one run of all of them; texts without words have no links and are
classes of their own; a text of any length is read to its end; equal rows are documents like any other (each counts
the other as a link); a null doc_id is kept, and counts as the smallest when a class is named; groups of the same
smallest doc_id stay apart; other columns play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.lineage import durable
from lumenlake.llm.bytewords import U, Batch, arrow_batches, encoded, mix
from lumenlake.llm.common import frugal
from lumenlake.operators.components import connected_components

WORDS, THRESHOLD = 5, 0.8
#: Bands of ROWS values; values compared at a time; posterior below which a pair is dropped.
BANDS, ROWS, STEP, TOLERANCE = 32, 4, 32, 1e-7
HASHES = BANDS * ROWS
#: Classes of a tile: when signatures are compared, and when sets are verified.  Steps of the distance to a pivot, and
#: the distance of the threshold in such steps.
TILE, SET_TILE, STEPS, FAR = 1024, 256, 1000, 200

_RNG = np.random.default_rng(97)
_XOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) | U(1)
_LOWEST = -(1 << 63)


def signatures(batch: Batch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(texts that have words, their class ids, their sorted sets of runs, their MinHash values)."""
    text, h = batch.shingles(WORDS)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    text, h = text[fresh], h[fresh]
    own, at = np.unique(text, return_index=True)
    if not len(own):
        return own, np.zeros(0, np.int64), [], np.zeros((0, HASHES), np.uint16)
    ends = np.concatenate([at[1:], [len(h)]])
    ids = mix(np.add.reduceat(mix(h), at) + mix((ends - at).astype(np.uint64))).view(np.int64)
    values = np.empty((len(own), HASHES), np.uint16)
    for k in range(HASHES):
        values[:, k] = mix(np.minimum.reduceat((h ^ _XOR[k]) * _TIMES[k], at)) >> U(48)
    return own, ids, [h[a:b] for a, b in zip(at, ends, strict=True)], values


@lru_cache
def least_matches(seen: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among `seen` values at which the posterior of reaching the threshold is not below tolerance.

    With m matches and a uniform prior the similarity is Beta(m + 1, seen - m + 1); its upper tail is a binomial sum.
    """
    tail = 0.0
    for m in range(seen + 1):
        tail += math.comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if tail >= tolerance:
            return m
    return seen


def surviving(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that the incremental comparison keeps."""
    out_i, out_j = [], []
    for at in range(0, len(a), 128):
        part = a[at : at + 128]
        matches = np.zeros((len(part), len(b)), np.uint8)
        for k in range(STEP):
            matches += part[:, k, None] == b[None, :, k]
        i, j = np.nonzero(matches >= least_matches(STEP))
        count = matches[i, j].astype(np.int32)
        for seen in range(STEP, HASHES, STEP):
            count = count + (part[i, seen : seen + STEP] == b[j, seen : seen + STEP]).sum(1)
            keep = count >= least_matches(seen + STEP)
            i, j, count = i[keep], j[keep], count[keep]
        out_i.append(i + at)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (id, smallest id) of the components of the pairs."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            if ids[a] < ids[b]:
                parent[b] = a
            else:
                parent[a] = b
    return [(int(ids[x]), int(ids[r])) for x in range(len(ids)) if (r := find(x)) != x]


def intersections(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements the sets of each pair share."""
    if len(i) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    # Many pairs: intersections of all as products of 0/1 matrices over the runs that both sides have.
    left, right = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(left, right)
    table = np.zeros((len(a), len(b)), np.float32)
    rows_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    rows_b = np.repeat(np.arange(len(b)), [len(x) for x in b])
    for at in range(0, len(shared), 8192):
        part = shared[at : at + 8192]
        table += _incidence(left, rows_a, len(a), part) @ _incidence(right, rows_b, len(b), part).T
    return table[i, j].astype(np.int64)


def verified(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of at least the threshold, exactly."""
    return alike(intersections(a, b, i, j), np.array([len(x) for x in a])[i], np.array([len(x) for x in b])[j])


def alike(common: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    return 5 * common >= 4 * (size_a + size_b - common)


def _incidence(values: np.ndarray, rows: np.ndarray, n: int, columns: np.ndarray) -> np.ndarray:
    at = np.searchsorted(columns, values)
    at[at == len(columns)] = 0
    hit = columns[at] == values
    out = np.zeros((n, len(columns)), np.float32)
    out[rows[hit], at[hit]] = 1
    return out


def _groups(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The stretches of rows with equal first columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        columns = [part.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), part.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = part.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != piece.column(k)[0] for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """rows (with own, their tile, and start and stop, the tiles that it meets), once for every pair of tiles x <= y."""
    other = rows.withColumn("other", F.explode(F.when(F.col("start") < F.col("stop"), F.sequence("start", F.col("stop") - 1))))
    dealt = other.select(group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *(c for c in rows.columns if c not in (group, "own", "start", "stop")))
    return dealt.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


@frugal
def _led(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of members (bucket, id, lead, values, those of the bucket's leader): whether the pair with the leader survives."""
    for part in parts:
        if not part.num_rows:
            continue
        own, lead = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in (3, 4))
        near, count = np.ones(len(own), bool), np.zeros(len(own), np.int32)
        for seen in range(0, HASHES, STEP):
            count += (own[:, seen : seen + STEP] == lead[:, seen : seen + STEP]).sum(1)
            near &= count >= least_matches(seen + STEP)
        yield pa.RecordBatch.from_arrays([part.column(k) for k in range(4)] + [pa.array(near)], ["bucket", "id", "lead", "values", "near"])


@frugal
def _candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the members of pairs of tiles (bucket, x, y, own, id, values): forests of the surviving pairs."""
    out: list[tuple[int, int]] = []
    for group in _groups(parts, 3):
        ids, values, own = group["id"].to_numpy(), _matrix(group["values"]), group["own"].to_numpy()
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        a, b = np.flatnonzero(own == x), np.flatnonzero(own == y)
        if len(a) and len(b):
            i, j = surviving(values[a], values[b])
            i, j = a[i], b[j]
            keep = i < j if x == y else np.ones(len(i), bool)
            out += _forest(ids, i[keep], j[keep])
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


@frugal
def _differences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of classes with the text of their component's pivot (component, id, n, text, pivot): sizes of the set, of the
    pivot's and of what they share, the MinHash values and the runs that only one of the two has."""
    pivots: dict[int, np.ndarray] = {}
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    for part in parts:
        components, want, n = (part.column(k).to_pylist() for k in range(3))
        leads, rows = part.column(4), []
        for first, batch in arrow_batches(part.column(3)):
            for t, i, own, values in zip(*signatures(batch), strict=True):
                k = first + int(t)
                if int(i) != want[k]:
                    continue
                if components[k] not in pivots:
                    if len(pivots) >= 32:
                        pivots = {}
                    pivots[components[k]] = signatures(Batch(encoded([leads[k].as_py()])))[2][0]
                pivot = pivots[components[k]]
                apart = np.setxor1d(own, pivot, assume_unique=True)
                rows.append((components[k], want[k], n[k], len(own), len(pivot), (len(own) + len(pivot) - len(apart)) // 2, values.tobytes(), apart.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["component", "id", "n", "size", "pivot", "common", "values", "apart"])


@frugal
def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the members of pairs of tiles (component, x, y, own, and what _differences gives): links per class, and
    forests of them.

    A row (u, v, links) is an edge if u and v differ, and a class's number of linked documents if they are equal.
    """
    for group in _groups(parts, 3):
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        ids, own, n, size, pivot, common = (group[c].to_numpy() for c in ("id", "own", "n", "size", "pivot", "common"))
        values, apart = _matrix(group["values"]), [np.frombuffer(raw, np.uint64) for raw in group["apart"].to_pylist()]
        a, b = np.flatnonzero(own == x), np.flatnonzero(own == y)
        if not len(a) or not len(b):
            continue
        i, j = surviving(values[a], values[b])
        if x == y:
            i, j = i[i < j], j[i < j]
        # What two sets share: what both have of the pivot, and of the rest.
        shared = intersections([apart[k] for k in a], [apart[k] for k in b], i, j)
        i, j = a[i], b[j]
        shared += common[i] + common[j] - pivot[i]
        good = alike(shared, size[i], size[j])
        i, j = i[good], j[good]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        some = np.flatnonzero(links)
        stars = _forest(ids, i, j)
        yield pa.RecordBatch.from_pydict({
            "u": pa.array(np.concatenate([ids[some], [s[0] for s in stars]]).astype(np.int64)), "v": pa.array(np.concatenate([ids[some], [s[1] for s in stars]]).astype(np.int64)),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(stars))]).astype(np.int64))})


def _by_distance(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with own, start and stop for _dealt; links of each class that are certain) of components.

    Tiles follow each other by distance to the pivot, in steps: a tile holds SET_TILE places in that order, in which a
    class's place within its step is drawn by its hash.  So what is certain of a tile are the tiles up to a number and
    those from a number on.
    """
    step = F.least(F.floor((1 - F.col("common") / (F.col("size") + F.col("pivot") - F.col("common"))) * STEPS), F.lit(STEPS)).cast("int")
    stepped = apart.withColumn("step", step)
    before = Window.partitionBy("component").orderBy("step")
    steps = stepped.groupBy("component", "step").agg(F.count("*").alias("many")).withColumn("first", F.sum("many").over(before) - F.col("many"))  # at most STEPS + 1 of a component
    tiled = (stepped.join(steps, ["component", "step"])
             .withColumn("own", F.floor((F.col("first") + F.pmod(F.xxhash64("id", "component"), F.col("many"))) / SET_TILE).cast("int")).drop("many", "first"))
    tiles = tiled.groupBy("component", "own").agg(F.sum("n").alias("docs"))
    tiles = tiles.join(steps.groupBy("component").agg(F.sum("many").alias("all")), "component")
    # The first and the last step that reach into a tile's places.
    reach = tiles.join(steps, "component").groupBy("component", "own", "docs", "all").agg(
        F.max(F.when(F.col("first") <= F.col("own") * SET_TILE, F.col("step"))).alias("low"),
        (F.max(F.when(F.col("first") < (F.col("own") + 1) * SET_TILE, F.col("step"))) + 1).alias("high"))
    places = lambda limit: F.coalesce(F.sum(F.when(F.col("step") < limit, F.col("many"))), F.lit(0))
    met = reach.join(steps, "component").groupBy("component", "own", "docs", "all", "low", "high").agg(
        places(FAR - F.col("high")).alias("linked"), places(FAR + F.col("high")).alias("upto"), places(F.col("low") - FAR).alias("below"))
    whole = lambda c: F.when(F.col(c) >= F.col("all"), F.ceil(F.col("all") / SET_TILE)).otherwise(F.floor(F.col(c) / SET_TILE)).cast("int")
    met = met.select("component", "own", "docs", whole("linked").alias("linked"), whole("below").alias("below"), F.ceil(F.col("upto") / SET_TILE).cast("int").alias("stop"))
    sums = Window.partitionBy("component").orderBy("own")
    sure = met.select("component", (F.col("own") + 1).alias("linked"), F.sum("docs").over(sums).alias("docs"))  # documents of the tiles below; an empty tile has none
    ends = met.select("component", "own", "linked", "below", "stop")
    # The running sum at the last tile that is there below the number.
    counted = (ends.join(sure.withColumnRenamed("linked", "upto"), "component").where(F.col("upto") <= F.col("linked"))
               .groupBy("component", "own").agg(F.max("docs").alias("docs")))
    ends = ends.join(counted, ["component", "own"], "left")
    classes = tiled.join(ends, ["component", "own"])
    links = classes.where("docs is not null").select("id", (F.col("docs") - F.when(F.col("own") < F.col("linked"), F.col("n")).otherwise(F.lit(0))).alias("links"))
    return classes.withColumn("start", F.greatest("linked", "below")).drop("linked", "below", "docs", "step"), links


def signed(docs: DataFrame) -> DataFrame:
    """doc, mark (a hash of the text), id (the class, null without words) and values of every row."""

    @frugal
    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, values = [None] * part.num_rows, [None] * part.num_rows
            for first, batch in arrow_batches(part.column(2)):
                for t, i, v in zip(*(x for k, x in enumerate(signatures(batch)) if k != 2), strict=True):
                    ids[first + t], values[first + t] = int(i), v.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.int64()), pa.array(values, pa.binary())], ["doc", "mark", "id", "values"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
            .mapInArrow(sign, "doc long, mark long, id long, values binary"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc, mark, class (smallest doc_id of the documents linked, directly or not), n_links and size of the class.

    component tells the classes apart where doc_ids repeat or are null; it is null without words.
    n_links counts the other documents, copies included, whose similarity is at least the threshold.
    """
    rows = durable(signed(docs))
    key = F.coalesce("doc", F.lit(_LOWEST))
    classes = durable(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct(key.alias("doc"), "mark")).alias("first"), F.first("values").alias("values")).select("id", "n", "first.*", "values").toDF("id", "n", "rep", "own", "values"))

    bands = classes.select("id", F.posexplode(F.array(*(F.xxhash64(F.lit(b), F.substring("values", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)))).alias("band", "bucket"))
    buckets = (bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("band").alias("band"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum(F.shiftright(F.xxhash64("id"), 24)).alias("mix"))
               .where("size > 1"))
    distinct = buckets.groupBy("size", "lo", "hi", "mix").agg(F.min("bucket").alias("bucket"))
    leaders = distinct.select("bucket", F.col("lo").alias("lead")).join(classes.select(F.col("id").alias("lead"), F.col("values").alias("of_lead")), "lead")
    members = bands.select("bucket", "id").join(leaders, "bucket").join(classes.select("id", "values"), "id")
    led = durable(members.select("bucket", "id", "lead", "values", "of_lead").mapInArrow(_led, "bucket long, id long, lead long, values binary, near boolean"))
    # Written out, so that the join has two plain exchanges, which Spark can split at a large bucket.
    others = durable(led.groupBy("bucket").agg(F.count_if("near").alias("close"), F.count_if(~F.col("near")).alias("far")).where("far > 0"))
    # Tiles of the others come first; those of the leader's own meet them only.
    far, close, drawn = F.ceil(F.col("far") / TILE).cast("int"), F.ceil(F.col("close") / TILE).cast("int"), F.xxhash64("id", "bucket")
    rest = led.join(others, "bucket").select(
        "bucket", F.when(F.col("near"), far + F.pmod(drawn, close)).otherwise(F.pmod(drawn, far)).cast("int").alias("own"), F.lit(0).alias("start"), F.when(F.col("near"), far).otherwise(far + close).alias("stop"), "id", "values")
    edges = led.where("near and id <> lead").select(F.col("id").alias("u"), F.col("lead").alias("v")).unionByName(_dealt(rest, "bucket").mapInArrow(_candidates, "u long, v long"))
    grouped = durable(connected_components(edges))

    chosen = grouped.join(classes.select("id", "n", "rep", "own"), "id")
    chosen = chosen.join(chosen.groupBy("component").agg(F.max(F.struct("n", "id"))["id"].alias("lead")), "component")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("rep"), F.xxhash64(F.col("text").cast("string")).alias("own"), F.col("text").cast("string").alias("text"))
    ready = durable(chosen.join(texts, ["rep", "own"]).select("component", "lead", "id", "n", "text").dropDuplicates(["id"]))
    pivots = ready.where("id = lead").select("component", F.col("text").alias("pivot"))
    apart = durable(ready.join(pivots, "component").select("component", "id", "n", "text", "pivot")
                    .mapInArrow(_differences, "component long, id long, n long, size long, pivot long, common long, values binary, apart binary"))
    tiled, sure = _by_distance(apart)
    checked = durable(_dealt(tiled, "component").mapInArrow(_verify, "u long, v long, links long"))

    links = checked.where("u = v").select(F.col("u").alias("id"), "links").unionByName(sure).groupBy("id").agg(F.sum("links").alias("links"))
    to_pivot = apart.where("5 * common >= 4 * (size + pivot - common)").join(ready.where("id = lead").select("component", "lead"), "component").where("id <> lead")
    linked = connected_components(checked.where("u <> v").select("u", "v").unionByName(to_pivot.select(F.col("id").alias("u"), F.col("lead").alias("v"))))
    named = classes.select("id", "n", "rep").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")).join(links, "id", "left")
    names = named.groupBy("component").agg(F.min("rep").alias("least"), F.sum("n").alias("members"))
    # One row per class; rows of equal texts, however many, are joined to it.
    facts = named.join(names, "component").select("id", "component", F.col("least").alias("class_id"), F.col("members").alias("class_size"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return rows.select("doc", "mark", "id").join(facts, "id", "left").select(
        "doc", "mark", "id", "component", F.when(F.col("id").isNull(), F.col("doc")).when(F.col("class_id") == _LOWEST, None).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest doc_id stays; all columns.

    Texts without words stay.  Of a group's rows with its smallest doc_id the one whose text hashes least stays.
    """
    found = near_duplicates(docs)
    key = F.coalesce("doc", F.lit(_LOWEST))
    first = found.where("id is not null").groupBy("component").agg(F.min(F.struct(key.alias("doc"), F.col("mark").alias("own"))).alias("first"))
    bare = found.where("id is null").select(key.alias("doc"), F.col("mark").alias("own"), F.lit(True).alias("bare")).distinct()
    kept = first.select("first.doc", "first.own", F.lit(False).alias("bare")).unionByName(bare)
    # The row is packed, so that no column's name can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("own"))
    one = rows.join(kept, ["doc", "own"]).groupBy("doc", "own", F.when(F.col("bare"), F.monotonically_increasing_id()).alias("each")).agg(F.first("row").alias("row"))
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns))
