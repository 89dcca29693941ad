"""Rules between the rows of a library, evaluated block by block.

A rule is a numpy function of two sets of rows that tells which pairs satisfy it.  A library that fits in a tile is one
block; of a larger one the rows are dealt into tiles, and every pair of tiles that can hold a pair is a block.  A task
holds one block at a time and hands on what the caller needs: a spanning forest of the pairs, sums per row, or, where
they are the result, the pairs themselves.

Rows with a place (a time, a latitude) satisfy a rule only with rows whose place is within `width`: they are dealt by
steps of that width and meet their own and the next step.  Loose rows may satisfy it with any row and meet all.

Where a loose row satisfies the rule only with rows that look `alike`, by a least cosine of their vectors, tiles are made
of rows near one pivot, and a cell knows the widest angle to it.  By the triangle inequality on the sphere, a row can
satisfy the rule with one of a cell only if it is no farther from the cell's pivot than that angle and the rule's own
together; it is sent to those cells alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import vector
from lumenlake.functions.lineage import durable
from lumenlake.operators.components import connected_components

#: Rows of a tile, by which blocks are worked on; tiles of rows near one pivot hold up to WIDE times as many.
TILE, WIDE = 1024, 8
#: Most pivots, and rows that they are chosen from.
PIVOTS, SAMPLE = 256, 20_000

_KEYS = ("library_id", "part", "x", "y")


class Rows:
    """The columns of a block as arrays: nulls are NaN (or None); vectors as one matrix."""

    def __init__(self, table: pa.Table):
        self.table = table
        self._held: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return self.table.num_rows

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._held:
            self._held[name] = self.table[name].to_numpy()
        return self._held[name]

    def number(self, name: str) -> np.ndarray:
        """A numeric column in doubles, NaN for null."""
        if f"{name}#" not in self._held:
            self._held[f"{name}#"] = self.table[name].cast(pa.float64()).to_numpy().astype(np.float64)
        return self._held[f"{name}#"]

    def vectors(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matrix, lengths, components) of a column of vectors; a missing one has no components."""
        if f"{name}@" not in self._held:
            column = self.table[name].combine_chunks()
            size = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            out = np.zeros((len(size), int(size.max(initial=0))))
            out[np.arange(out.shape[1])[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            self._held[f"{name}@"], self._held[f"{name}|"], self._held[f"{name}:"] = out, np.sqrt((out * out).sum(1)), size
        return self._held[f"{name}@"], self._held[f"{name}|"], self._held[f"{name}:"]


Rule = Callable[[Rows, np.ndarray, np.ndarray], np.ndarray]


def cosine(rows: Rows, a: np.ndarray, b: np.ndarray, name: str = "embedding") -> np.ndarray:
    """Cosines of rows a and rows b, NaN where a vector is missing or the two differ in size."""
    matrix, length, size = rows.vectors(name)
    out = matrix[a] @ matrix[b].T / np.maximum(np.outer(length[a], length[b]), 1e-12)
    out[(size[a][:, None] != size[b][None, :]) | (size[a] == 0)[:, None]] = np.nan
    return out


def apart(rows: Rows, a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
    """Absolute differences of a column, NaN where a side is null."""
    x = rows.number(name)
    return np.abs(x[a][:, None] - x[b][None, :])


def kilometres(rows: Rows, a: np.ndarray, b: np.ndarray, latitude: str = "latitude", longitude: str = "longitude") -> np.ndarray:
    """Great-circle distances, NaN where a coordinate is null."""
    lat, lon = np.radians(rows.number(latitude)), np.radians(rows.number(longitude))
    half = lambda x: np.sin((x[b][None, :] - x[a][:, None]) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(half(lat) + np.cos(lat[a])[:, None] * np.cos(lat[b])[None, :] * half(lon), 1.0)))


def bits_apart(rows: Rows, a: np.ndarray, b: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """How many bits of the columns together differ; NaN where one is null."""
    out = np.zeros((len(a), len(b)))
    for name in names:
        x = rows.number(name)
        word = np.nan_to_num(x).astype(np.int64)
        out += np.bitwise_count(word[a][:, None] ^ word[b][None, :])
        out[np.isnan(x)[a]] = np.nan
        out[:, np.isnan(x)[b]] = np.nan
    return out


def has_large(rows: DataFrame) -> bool:
    """Whether a library does not fit in a tile."""
    return not rows.groupBy("library_id").count().where(F.col("count") > TILE).isEmpty()


def _pivots(rows: DataFrame, column: str) -> np.ndarray:
    """Directions around which vectors lie: a few rounds of k-means over a sample, for all libraries together."""
    v = vector.as_double(F.col(column))
    sample = [np.array(r.v) for r in rows.where(vector.present(F.col(column)) & (vector.norm(v) > vector.EPSILON)).orderBy(F.xxhash64("node")).limit(SAMPLE).select(v.alias("v")).collect()]
    if not sample:
        return np.zeros((0, 1))
    sizes = np.array([len(x) for x in sample])
    x = np.array([v for v in sample if len(v) == np.bincount(sizes).argmax()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = max(1, min(PIVOTS, 2 * len(x) // TILE, len(x)))
    # Each start is the row least like those before, so that no two of well parted groups have a pivot in common.
    start, most = [0], x @ x[0]
    while len(start) < n:
        start.append(int(most.argmin()))
        most = np.maximum(most, x @ x[start[-1]])
    return centres(x, n, np.random.default_rng(7), start=start)


def centres(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8, start: list[int] | None = None) -> np.ndarray:
    """k-means of unit vectors by cosine, from rows drawn at random or those given."""
    c = x[rng.choice(len(x), n, replace=False) if start is None else start]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.maximum(length, 1e-12), c)
    return c


def _celled(rows: DataFrame, column: str, pivots: np.ndarray) -> DataFrame:
    """rows with the nearest pivot (cell) and the angle to it; vectors of another size have a cell of their own, which
    meets itself alone, and rows without a direction are left out."""

    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, angle = np.full(len(batch), -1), np.zeros(len(batch))
            sizes = np.array([0 if v is None else len(v) for v in batch])
            for size in set(sizes.tolist()) - {0}:
                which = np.flatnonzero(sizes == size)
                x = np.array([batch.iloc[i] for i in which], float)
                length = np.linalg.norm(x, axis=1)
                which, x = which[length > vector.EPSILON], x[length > vector.EPSILON] / length[length > vector.EPSILON, None]
                if size == pivots.shape[1] and len(pivots):
                    alike = x @ pivots.T
                    cell[which], angle[which] = alike.argmax(1), np.arccos(np.clip(alike.max(1, initial=-1.0), -1, 1))
                else:
                    cell[which] = PIVOTS + size
            yield pd.DataFrame({"cell": cell, "angle": angle})

    found = F.pandas_udf(cells, "cell long, angle double").asNondeterministic()
    return rows.withColumn("found", found(vector.as_double(F.col(column)))).select("*", "found.cell", "found.angle").drop("found").where("cell >= 0")


def _visits(rows: DataFrame, column: str, pivots: np.ndarray, reach: list[tuple[int, float]], most: float) -> DataFrame:
    """rows (cell, loose, a vector) with their code (a cell's bound rows and its loose ones have a code each) and visits: the
    greater codes in which there may be a row within `most` of them.  reach has the widest angle of every code."""
    codes, angles = np.array([c for c, _ in reach], np.int64), np.array([a for _, a in reach], float)

    def sought(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch, code in batches:
            # A cell of vectors of another size is met from its own bound rows alone.
            own, out = code.to_numpy(np.int64), [[c + 1] if c % 2 == 0 else [] for c in code.tolist()]
            which = np.flatnonzero(own < 2 * PIVOTS)
            if len(which) and len(codes):
                x = np.array([batch.iloc[i] for i in which], float)
                away = np.arccos(np.clip(x @ pivots.T / np.linalg.norm(x, axis=1, keepdims=True), -1, 1))[:, codes // 2]
                met = (away <= angles[None, :] + most) & (codes[None, :] > own[which][:, None]) & ((codes[None, :] | own[which][:, None]) % 2 == 1)
                for i, hit in zip(which.tolist(), met, strict=True):
                    out[i] = codes[hit].tolist()
            yield pd.Series(out)

    found = F.pandas_udf(sought, "array<long>").asNondeterministic()
    return rows.withColumn("code", 2 * F.col("cell") + F.col("loose").cast("long")).withColumn("visits", found(vector.as_double(F.col(column)), F.col("code")))


def _alike(large: DataFrame, names: list[str], column: str, cosine: float) -> DataFrame:
    """Loose rows of large libraries and those that they may meet, once for every block: part, x, y and own.

    A row is sent to the cells that its own angles to their pivots leave open, so of two cells only the rows between them
    meet.  Tiles hold a sixteenth of a library, TILE rows at least and WIDE * TILE at most: as long as that lasts, a row is
    in as many blocks however large its library.  The guests of a cell have tiles of their own, numbered after all others.
    """
    pivots = _pivots(large, column)
    rows = durable(_celled(large, column, pivots).select(*names, "loose", "cell", "angle"))
    code = (2 * F.col("cell") + F.col("loose").cast("long")).alias("code")
    reach = [(r.code, r.reach) for r in rows.where(F.col("cell") < PIVOTS).groupBy(code).agg(F.max("angle").alias("reach")).orderBy("code").collect()]  # at most two for each pivot
    seen = _visits(rows, column, pivots, reach, float(np.arccos(cosine)) + 1e-6)
    guests = seen.select("library_id", F.explode("visits").alias("code")).groupBy("library_id", "code").agg(F.count("*").alias("guests"))
    cells = rows.groupBy("library_id", code).agg(F.count("*").alias("many")).join(guests, ["library_id", "code"], "left")
    whole, before = Window.partitionBy("library_id"), Window.partitionBy("library_id").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    size = F.least(F.greatest(F.ceil(F.sum("many").over(whole) / 16), F.lit(TILE)), F.lit(WIDE * TILE))
    cells = cells.withColumn("size", size).withColumn("tiles", F.ceil(F.col("many") / F.col("size")).cast("int")).withColumn("rooms", F.ceil(F.coalesce("guests", F.lit(0)) / F.col("size")).cast("int"))
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    cells = cells.withColumn("first", start("tiles")).withColumn("room", (F.sum("tiles").over(whole) + start("rooms")).cast("int"))
    plans = durable(cells.groupBy("library_id").agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("first", "tiles", "room", "rooms")))).alias("cells")))
    drawn = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda first, n: F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda x, y, own: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), own.cast("int").alias("own"))
    met = seen.join(plans, "library_id").withColumn("me", F.col("cells")[F.col("code")]).withColumn("mine", F.col("me.first") + drawn(F.col("me.tiles")))
    mine, none = F.col("mine"), F.array().cast("array<struct<x: int, y: int, own: int>>")
    inside = F.when(F.col("loose"), F.transform(upto(F.col("me.first"), F.col("me.tiles")), lambda j: at(F.least(mine, j), F.greatest(mine, j), mine))).otherwise(none)
    host = F.transform(upto(F.col("me.room"), F.col("me.rooms")), lambda g: at(mine, g, mine))

    def guest(cell: Column) -> Column:
        room = cell["room"] + drawn(cell["rooms"])
        return F.transform(upto(cell["first"], cell["tiles"]), lambda j: at(j, room, room))

    there = F.filter(F.transform("visits", lambda c: F.col("cells")[c]), lambda cell: cell.isNotNull())
    return met.withColumn("block", F.explode(F.concat(inside, host, F.flatten(F.transform(there, guest))))).select(*names, F.lit(0).cast("long").alias("part"), "block.x", "block.y", "block.own")


def _dealt(rows: DataFrame, loose: Column | None, at: Column | None, width: float, alike: tuple[str, float] | None = None) -> DataFrame:
    """rows with part, x, y and own: once for every block that they are in."""
    names = rows.columns
    placed = at is not None
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    drawn = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    marked = rows.withColumn("loose", F.coalesce(loose, F.lit(False)) if placed and loose is not None else F.lit(not placed))
    sizes = marked.groupBy("library_id").agg(F.count("*").alias("n"), F.count_if("loose").alias("free")).withColumn("bound", F.col("n") - F.col("free"))
    sized = marked.join(sizes, "library_id")
    fits = F.col("n") <= TILE
    # Tiles of the loose rows come first and meet all; those of the others meet only them.
    first, others = tiles("free"), tiles("bound")
    own = F.when(fits, 0).when(F.col("loose"), drawn(first)).otherwise(first + drawn(others))
    stop = F.when(fits, 1).when(F.col("loose"), first + others).otherwise(first)
    zeros = (F.lit(0).cast("long").alias("part"), F.lit(0).alias("own"), F.lit(0).alias("start"), F.lit(1).alias("stop"))
    if alike is not None and alike[1] > 0:  # at a right angle and beyond, nothing is told apart
        parts, looks = [sized.where(fits).select(*names, *zeros)], _alike(sized.where(~fits), names, *alike)
    else:
        looks = None
        parts = [sized.select(*names, F.lit(0).cast("long").alias("part"), own.cast("int").alias("own"), F.lit(0).alias("start"), stop.cast("int").alias("stop"))]
    if placed:
        bound = sized.where(~fits & ~F.col("loose")).withColumn("step", F.floor(at / width).cast("long"))
        counts = bound.groupBy("library_id", "step").agg(F.count("*").alias("many")).withColumn("tiles", tiles("many")).drop("many")
        near = counts.join(counts.select("library_id", (F.col("step") - 1).alias("step"), F.col("tiles").alias("above")), ["library_id", "step"], "left")
        near = near.join(counts.select("library_id", (F.col("step") + 1).alias("step"), F.col("tiles").alias("below")), ["library_id", "step"], "left")
        stepped = bound.join(near.na.fill(0, ["above", "below"]), ["library_id", "step"]).withColumn("sub", drawn(F.col("tiles")))
        pick = lambda part, own, start, stop, keep: stepped.where(keep).select(*names, part.alias("part"), own.cast("int").alias("own"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))
        # Of the numbers of parts 0 is taken; a step has one for its own pairs and one for those with the next step.
        zero, inside, above, below = F.lit(0), 4 * F.col("step") + 1, 4 * F.col("step") + 2, 4 * F.col("step") - 2
        parts += [pick(inside, F.col("sub"), zero, F.col("tiles"), F.lit(True)), pick(above, F.col("sub"), F.col("tiles"), F.col("tiles") + F.col("above"), F.col("above") > 0),
                  pick(below, F.col("below") + F.col("sub"), zero, F.col("below"), F.col("below") > 0)]
    dealt = parts[0]
    for p in parts[1:]:
        dealt = dealt.unionByName(p)
    dealt = dealt.where("start < stop").withColumn("other", F.explode(F.sequence("start", F.col("stop") - 1)))
    dealt = dealt.select(*names, "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    return dealt if looks is None else dealt.unionByName(looks)


def _groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The stretches of rows with equal keys, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        columns = [part.column(k).to_numpy(zero_copy_only=False) for k in range(len(_KEYS))]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), part.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = part.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != piece.column(k)[0] for k in range(len(_KEYS))):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def over_blocks(rows: DataFrame, work: Callable[[Rows, np.ndarray, np.ndarray, bool], dict[str, np.ndarray] | None], schema: str, loose: Column | None = None, at: Column | None = None, width: float = 1.0, alike: tuple[str, float] | None = None) -> DataFrame:
    """What `work` gives of every block (its rows, those of the one and of the other tile, whether the tiles are one).

    rows need library_id and node, a number of their own; `schema` is that of the arrays that work returns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, most = to_arrow_schema(StructType.fromDDL(schema)), TILE
    if not has_large(rows):
        # Every library is a block; rows that are dealt by library already stay where they are.
        def whole(table: pa.Table) -> pa.Table:
            block, all_rows = Rows(table), np.arange(table.num_rows)
            out = work(block, all_rows, all_rows, True)
            return pa.table({f.name: pa.array([] if out is None else out[f.name], f.type) for f in arrow}, schema=arrow)

        return rows.groupBy("library_id").applyInArrow(whole, schema)
    rest = [c for c in rows.columns if c != "library_id"]
    keyed = _dealt(rows, loose, at, width, alike).select(*_KEYS, "own", *rest)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in _groups(parts):
            block = Rows(table)
            x, y, own = table["x"][0].as_py(), table["y"][0].as_py(), block["own"]
            a, b = np.flatnonzero(own == x), np.flatnonzero(own == y)
            for i, j in ((i, j) for i in range(0, len(a), most) for j in range(i if x == y else 0, len(b), most)):
                if (out := work(block, a[i : i + most], b[j : j + most], x == y and i == j)) is None:
                    continue
                held.append(pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow))
                size += held[-1].num_rows
                if size > 50_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return keyed.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, schema)


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Star edges (node, smallest node) of the components of pairs of places."""
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            if nodes[p] < nodes[q]:
                parent[q] = p
            else:
                parent[p] = q
    ends = [(int(nodes[x]), int(nodes[r])) for x in range(len(nodes)) if (r := find(x)) != x]
    return [u for u, _ in ends], [v for _, v in ends]


def linked(rows: DataFrame, rule: Rule, loose: Column | None = None, at: Column | None = None, width: float = 1.0, alike: tuple[str, float] | None = None) -> DataFrame:
    """(id, component) of the nodes that satisfy the rule with others, directly or not."""

    def work(block: Rows, a: np.ndarray, b: np.ndarray, same: bool) -> dict | None:
        i, j = np.nonzero(np.triu(rule(block, a, b), 1) if same else rule(block, a, b))
        if not len(i):
            return None
        u, v = _forest(block["node"], a[i], b[j])
        return {"u": u, "v": v}

    return connected_components(over_blocks(rows, work, "u long, v long", loose, at, width, alike))


def pairs(rows: DataFrame, rule: Rule, loose: Column | None = None, at: Column | None = None, width: float = 1.0, alike: tuple[str, float] | None = None) -> DataFrame:
    """(library_id, left_id, left_ord, right_id, right_ord) of the pairs that satisfy the rule, by ord."""
    kind, ident = dict(rows.dtypes)["library_id"], dict(rows.dtypes)["id"]

    def work(block: Rows, a: np.ndarray, b: np.ndarray, same: bool) -> dict | None:
        i, j = np.nonzero(np.triu(rule(block, a, b), 1) if same else rule(block, a, b))
        if not len(i):
            return None
        i, j = a[i], b[j]
        turned = block["ord"][i] > block["ord"][j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        return {"library_id": block["library_id"][i], "left_id": block["id"][i], "left_ord": block["ord"][i], "right_id": block["id"][j], "right_ord": block["ord"][j]}

    return over_blocks(rows, work, f"library_id {kind}, left_id {ident}, left_ord long, right_id {ident}, right_ord long", loose, at, width, alike)


def counted(rows: DataFrame, rule: Rule, alike: tuple[str, float] | None = None) -> DataFrame:
    """(node, n): with how many other rows of its library each satisfies the rule; rows without any are left out."""

    def work(block: Rows, a: np.ndarray, b: np.ndarray, same: bool) -> dict | None:
        hit = rule(block, a, b)
        if same:
            np.fill_diagonal(hit, False)
            node, n = block["node"][a], hit.sum(1)
        else:
            node, n = np.concatenate([block["node"][a], block["node"][b]]), np.concatenate([hit.sum(1), hit.sum(0)])
        return {"node": node[n > 0], "n": n[n > 0]}

    return over_blocks(rows, work, "node long, n long", alike=alike).groupBy("node").agg(F.sum("n").alias("n"))


def least(rows: DataFrame, rule: Rule, value: str, alike: tuple[str, float] | None = None) -> DataFrame:
    """(node, value): the least value of the rows with one that a row without one satisfies the rule with."""

    def work(block: Rows, a: np.ndarray, b: np.ndarray, same: bool) -> dict | None:
        hit, x = rule(block, a, b), block.number(value)
        out_node, out = [], []
        for p, q, m in ((a, b, hit), (b, a, hit.T)) if not same else ((a, b, hit),):
            known = np.where(np.isnan(x[q]), np.inf, x[q])
            best = np.where(m, known[None, :], np.inf).min(1)
            ok = np.isnan(x[p]) & (best < np.inf)
            out_node.append(block["node"][p][ok])
            out.append(best[ok].astype(np.int64))
        return {"node": np.concatenate(out_node), value: np.concatenate(out)}

    return over_blocks(rows, work, f"node long, {value} long", alike=alike).groupBy("node").agg(F.min(value).alias(value))


def node(library_id: str = "library_id", number: str = "ord") -> Column:
    """The number of a row that is its own over all libraries."""
    return F.xxhash64(F.col(library_id).cast("string"), F.col(number).cast("long"))
