"""Vector columns: arrays of numbers, computed in double precision; null or empty means no vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-12


def present(v: Column) -> Column:
    return F.coalesce(F.size(v) > 0, F.lit(False))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is missing."""
    return F.when(present(a) & present(b), dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON)))


def query_cosine(query: list[float], v: Column) -> Column:
    """Cosine of a fixed query and a column, each divided by its own length first."""
    length = max(sum(x * x for x in query) ** 0.5, EPSILON)
    q = F.array(*(F.lit(float(x) / length) for x in query))
    return dot(q, v) / F.greatest(norm(v), F.lit(EPSILON))


def visual_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 where a vector is missing."""
    return F.coalesce(1 - cosine(a, b), F.lit(0.0))


class _Sums:
    """Weighted sums of vectors by key; weights are kept once, or element by element where vectors differ in length."""

    def __init__(self, fields: list[pa.Field]):
        self.fields, self.held = fields, {}

    def add(self, part: pa.RecordBatch) -> None:
        """Rows of the keys, a vector, and its weights (one for all elements, or one for each)."""
        n = len(self.fields)
        keys = pd.DataFrame({i: part.column(i).to_pandas() for i in range(n)})
        code = keys.groupby(list(range(n)), sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(code, return_index=True)[1]
        names = list(zip(*(part.column(i).take(pa.array(first)).to_pylist() for i in range(n)), strict=True))
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(first)))
        matrix, long = padded(part.column(n))
        weights, spread = padded(part.column(n + 1))
        if (long != matrix.shape[1]).any() or (spread != 1).any():
            inside = np.arange(matrix.shape[1])[None, :] < long[:, None]
            weights = np.where(spread[:, None] == 1, weights[:, :1], np.pad(weights, ((0, 0), (0, matrix.shape[1] - weights.shape[1])))) * inside
        total, weight = (np.add.reduceat(x[order], starts, axis=0) for x in (matrix, weights))
        for key, t, w in zip(names, total, weight, strict=True):
            if len(w) > 1:  # as long as the longest vector of the key
                t, w = t[: (n := int(np.flatnonzero(w)[-1]) + 1)], w[:n]
            if (old := self.held.get(key)) is not None:
                t, w = plus(old[0], t), (old[1] + w if len(old[1]) == len(w) == 1 and len(old[0]) == len(t) else plus(_each(old[1], old[0]), _each(w, t)))
            self.held[key] = t, w

    def out(self, most: int, finish: Callable[[np.ndarray, np.ndarray], np.ndarray | None] | None = None) -> Iterator[pa.RecordBatch]:
        """What has been added up, but for the `most` last keys."""
        if len(self.held) <= most:
            return
        done = [(k, self.held.pop(k)) for k in list(self.held)[: len(self.held) - most]]
        if finish is not None:
            done = [(k, (v,)) for k, (t, w) in done if (v := finish(t, w)) is not None]
        kind = pa.list_(pa.float64())
        arrays = [pa.array([k[i] for k, _ in done], f.type) for i, f in enumerate(self.fields)]
        values = [pa.array([v[i] for _, v in done], kind) for i in range(1 if finish is not None else 2)]
        yield pa.RecordBatch.from_arrays(arrays + values, [*(f.name for f in self.fields), *("__v", "__w")[: len(values)]])


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    long = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, most = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False), int(long.max(initial=0))
    if (long == most).all():
        return flat.reshape(len(long), most), long
    out = np.zeros((len(long), most))
    out[np.arange(most)[None, :] < long[:, None]] = flat
    return out, long


def _each(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    return weight if len(weight) == len(total) else np.repeat(weight, len(total))


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two vectors; what the shorter one lacks counts as 0."""
    if len(a) < len(b):
        a, b = b, a
    out = a.copy()
    out[: len(b)] += b
    return out


#: Keys whose sums a task holds before it hands them on.
HELD = 20_000


def _aggregated(df: DataFrame, keys: list[str], vector: str, weight: str | None, finish: Callable[[np.ndarray, np.ndarray], np.ndarray | None], together: bool = False) -> DataFrame:
    """Per key what `finish` makes of the sum of the weighted present vectors and of their weights.

    A task adds up what it has, in Arrow batches, and hands on one vector for each of its keys; so a group of any size is
    aggregated before the shuffle and never gathered, and a vector is never taken apart.  Where the rows of a key are
    `together` in a task, as behind a window over some of the keys, they are sorted and added up there, without a shuffle.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.col(weight).cast("double"), F.lit(1e-6))
    v = as_double(F.col(vector))
    rows = df.where(present(F.col(vector)) & w.isNotNull()).select(*keys, (v if weight is None else F.transform(v, lambda x: x * w)).alias("__v"), F.array(w).alias("__w"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for part in parts:
            sums = sums or _Sums([part.schema.field(i) for i in range(len(keys))])
            if part.num_rows:
                sums.add(part)
            if len(sums.held) > HELD:
                yield from sums.out(0)
        if sums:
            yield from sums.out(0)

    def final(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for part in parts:
            sums = sums or _Sums([part.schema.field(i) for i in range(len(keys))])
            if part.num_rows:
                sums.add(part)
            yield from sums.out(1, finish)  # rows are sorted: the last key may go on
        if sums:
            yield from sums.out(0, finish)

    dealt = rows if together else rows.mapInArrow(partial, f"{schema}, __v array<double>, __w array<double>").repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(final, f"{schema}, __v array<double>")


def partial_sums(rows: DataFrame, keys: int) -> DataFrame:
    """The first `keys` columns of rows and v: sums of the last column, a vector, as far as a task has them.

    A column between them tells, of rows that follow each other, which ones are averaged first, at unit length.
    """
    names = rows.columns[:keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:keys])
    averaged = len(rows.columns) > keys + 1

    def one(n: int) -> pa.Array:
        return pa.array([[1.0]] * n, pa.list_(pa.float64()))

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = None, None

        def added(batches: Iterator[pa.RecordBatch]) -> None:
            for b in batches:
                outer.add(pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keys)), b.column(b.num_columns - 1), one(b.num_rows)], [*names, "__v", "__w"]))

        def handed(least: int) -> Iterator[pa.RecordBatch]:
            if len(outer.held) > least:
                yield from (b.drop_columns(["__w"]).rename_columns([*names, "v"]) for b in outer.out(0))

        for part in parts:
            if outer is None:
                inner, outer = _Sums([part.schema.field(i) for i in range(keys + 1)]), _Sums([part.schema.field(i) for i in range(keys)])
            if part.num_rows and averaged:
                inner.add(pa.RecordBatch.from_arrays([*part.columns, one(part.num_rows)], [*part.schema.names, "__w"]))
                added(inner.out(1, _direction))
            elif part.num_rows:
                added([part])
            yield from handed(HELD)
        if outer is not None:
            added(inner.out(0, _direction))
            yield from handed(0)

    return rows.mapInArrow(partial, f"{schema}, v array<double>")


def _direction(total: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
    mean = np.divide(total, weight, out=np.zeros_like(total), where=np.broadcast_to(weight, total.shape) > 0)
    length = float(np.sqrt((mean * mean).sum()))
    return mean / length if length > EPSILON else None


def sum_vectors(df: DataFrame, keys: list[str], vector: str, into: str = "total") -> DataFrame:
    """Per key the element-wise sum of the present vectors."""
    return _aggregated(df, keys, vector, None, lambda total, weight: total).withColumnRenamed("__v", into)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, into: str = "centroid", weight: str | None = None, together: bool = False) -> DataFrame:
    """Per key the element-wise mean of the present vectors (weighted, if a weight column is given), at unit length.

    A group whose mean has no length has no row.  `together`: the rows of a key are in one task already.
    """
    return _aggregated(df, keys, vector, weight, _direction, together).withColumnRenamed("__v", into)
