"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments, from coarse to fine; a segment's mean and deviation of query and candidate give a lower
bound of their distance: with n components, n * ((mean - mean')^2 + (dev - dev')^2) per segment.  As
|q|^2 + |x|^2 - distance^2 = 2 q.x, that bounds the score from above.  Level by level, pairs whose bound is below the
k-th best score known so far drop out, and finer levels look at the others only; exact scores are computed for what
survives the finest level.  Bounds are in single precision with room for its rounding, scores in double precision.

Queries and candidates are packed into blocks of rows.  Blocks of candidates are dealt into groups, and a task gets
one block of queries and one group: the best known of each query are handed on from block to block of the group, and
only the k best of each query and group go on.  A vector that a third of all rows share is spread over the blocks like
any other.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
vectors are compared with those of their own length only; rows that share the query's id are its own and left out;
a repeated query row is answered once, and queries that share an id but not the vector are answered each; repeated
candidate rows count each; ties go to the smaller vec_id; a vector whose components are too large for exact doubles is
scored in whole numbers of any size, it alone, and scores beyond 64 bits are clipped; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import frugal

#: Vectors of a block of queries and of one of candidates, queries whose bounds a task holds at once, and blocks of
#: candidates of a group: for each group a block of queries is shuffled once, and for each block of queries a group.
QUERY_BLOCK, CANDIDATE_BLOCK, AT_ONCE, GROUP = 4096, 4096, 256, 16
#: Segments of the levels, coarse to fine.
LEVELS = (4, 16, 32)
#: Most partitions of the search; share of live pairs from which bounds are one matrix product instead of one by one.
MOST_TASKS, DENSE = 10_000, 0.25

_PACKED = "qb int, dim int, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _pack(keyed: DataFrame, rows: int, once: bool) -> DataFrame:
    """Rows (qb, id, v) as blocks of at most `rows` of one qb and one length; once: equal rows count once."""

    @frugal
    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[int, int], tuple[list[int], list[bytes]]] = {}
        seen: set[bytes] = set()

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            ids, vectors = open_.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], ["qb", "dim", "ids", "vectors"])

        for part in parts:
            at = part.column(2).offsets.to_numpy()
            values = np.asarray(part.column(2).values.to_numpy(zero_copy_only=False), np.float64)
            for i, (qb, vec) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                raw = values[at[i] : at[i + 1]].tobytes()
                if once:
                    mark = hashlib.blake2b(vec.to_bytes(8, "little", signed=True) + raw, digest_size=16).digest()
                    if mark in seen:
                        continue
                    seen.add(mark)
                key = (qb, len(raw) // 8)
                ids, vectors = open_.setdefault(key, ([], []))
                ids.append(vec)
                vectors.append(raw)
                if len(ids) == rows:
                    yield out(key)
        for key in list(open_):
            yield out(key)

    return keyed.mapInArrow(pack, _PACKED)


def _segments(x: np.ndarray, n: int) -> np.ndarray:
    """sqrt(length) times mean and deviation of n segments: rows whose squared distance bounds that of the vectors."""
    parts = np.array_split(x, min(n, x.shape[1]), axis=1)
    return np.hstack([f for p in parts for f in (np.sqrt(p.shape[1]) * p.mean(1, keepdims=True), np.sqrt(p.shape[1]) * p.std(1, keepdims=True))])


class Block:
    """Vectors with what the search needs to know of them; vectors too large for exact doubles are kept apart."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        # Inner products of vectors within the limit are exact in doubles.
        small = np.abs(x).max(1, initial=0.0) <= 2.0**26 / max(1, x.shape[1]) ** 0.5
        self.plain, self.large = np.flatnonzero(small), np.flatnonzero(~small)
        self.values, self.plain_ids = x[self.plain], ids[self.plain]
        self.norms = np.sqrt((self.values * self.values).sum(1))
        self._levels: dict[int, np.ndarray] = {}

    def segments(self, n: int) -> np.ndarray:
        if n not in self._levels:
            self._levels[n] = _segments(self.values, n).astype(np.float32)
        return self._levels[n]


class Best:
    """The k best candidates known so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k, self.known = k, np.full(n, -np.inf)
        self.scores, self.ids = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            best = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[best], ids[best]
        scores, ids = np.concatenate([self.scores[i], scores.astype(np.int64)]), np.concatenate([self.ids[i], ids])
        order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[order], ids[order]
        if len(order) == self.k:
            self.known[i] = float(scores[order[-1]])

    def rows(self) -> list[tuple[int, int, int]]:
        return [(i, v, s) for i in range(len(self.ids)) for v, s in zip(self.ids[i].tolist(), self.scores[i].tolist(), strict=True)]


def _cascade(q: Block, rows: slice, c: Block, best: Best, seen: Counter) -> None:
    """The plain queries numbered `rows` against the plain candidates of a block."""
    mine, x = q.plain[rows], q.values[rows]
    if not len(mine) or not len(c.plain):
        return
    live = q.plain_ids[rows, None] != c.plain_ids[None, :]
    slack = 1e-5 * q.norms[rows] * c.norms.max() + 1e-3
    seen["pairs"] += live.size

    def score(i: int, at: np.ndarray) -> None:
        live[i, at] = False
        seen["scored"] += len(at)
        best.add(int(mine[i]), c.values[at] @ x[i], c.plain_ids[at])

    for n in LEVELS:
        if n >= x.shape[1]:
            break  # as long as the vectors themselves
        fq, fc = q.segments(n)[rows], c.segments(n)
        if live.mean() > DENSE:
            bound = np.where(live, fq @ fc.T, -np.inf)
        else:
            bound = np.full(live.shape, -np.inf, np.float32)
            for i in range(len(mine)):
                at = np.flatnonzero(live[i])
                bound[i, at] = fc[at] @ fq[i]
        probes = min(2 * best.k, live.shape[1])
        likely = np.argpartition(-bound, probes - 1, axis=1)[:, :probes]
        for i in range(len(mine)):
            if len(at := likely[i][live[i, likely[i]]]):
                score(i, at)
        live &= bound >= (best.known[mine] - slack)[:, None]
        seen[f"after level {n}"] += int(live.sum())
    for i in range(len(mine)):
        if len(at := np.flatnonzero(live[i])):
            score(i, at)


def _whole(x: np.ndarray) -> list[int]:
    return [int(v) for v in x]


def compare(q: Block, c: Block, best: Best, seen: Counter | None = None) -> None:
    """Brings the candidates of a block to what is known of a block of queries."""
    seen = Counter() if seen is None else seen
    for at in range(0, len(q.plain), AT_ONCE):
        _cascade(q, slice(at, at + AT_ONCE), c, best, seen)
    if not len(q.large) and not len(c.large):
        return
    # Vectors too large for exact doubles: in whole numbers of any size, held to 64 bits.
    whole = {j: _whole(c.x[j]) for j in (range(len(c.ids)) if len(q.large) else c.large.tolist())}
    large = set(q.large.tolist())
    for i in range(len(q.ids)):
        at = [j for j in (range(len(c.ids)) if i in large else c.large.tolist()) if c.ids[j] != q.ids[i]]
        if at:
            v = _whole(q.x[i])
            scores = [max(-(2**63), min(2**63 - 1, sum(map(mul, v, whole[j])))) for j in at]
            best.add(i, np.array(scores, np.int64), c.ids[at])


def block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's place, vec_id, score) of the k best candidates of each query, ties to smaller ids."""
    best = Best(len(q_ids), k)
    compare(Block(q_ids, q), Block(c_ids, c), best)
    return best.rows()


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of vectors(vec_id, embedding) for every query row."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("is_query"),
        F.expr(f"transform(embedding, x -> cast(floor(cast(x as double) * {scale}D) as double))").alias("v"))
    queries = rows.where("is_query")
    size = rows.agg(F.count("*").alias("rows"), F.count_if("is_query").alias("queries")).first()
    blocks, packs = max(1, -(-size.queries // QUERY_BLOCK)), max(1, -(-size.rows // CANDIDATE_BLOCK))
    groups = max(-(-packs // GROUP), min(packs, -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks)))
    keys, tasks = ["qb", "cg", "dim"], min(MOST_TASKS, blocks * groups)
    asked = _pack(queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("qb"), "vec_id", "v").repartition(blocks, "qb"), QUERY_BLOCK, once=True)
    asked = asked.withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, *keys)
    packed = _pack(rows.select(F.lit(0).alias("qb"), "vec_id", "v"), CANDIDATE_BLOCK, once=False).withColumn("cg", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    packed = packed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *keys)
    met = (packed.select(*keys, F.col("ids").alias("c_ids"), F.col("vectors").alias("c")).join(asked.hint("merge"), keys).select(*keys, "ids", "vectors", "c_ids", "c"))

    @frugal
    def top(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> pa.RecordBatch:
            found = [(int(q.ids[i]), marks[i], v, s) for q, marks, best in held.values() for i, v, s in best.rows()]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in enumerate(kinds)], ["query_id", "mark", "vec_id", "score"])

        for part in parts:
            for n in range(part.num_rows):
                row = part.slice(n, 1).to_pylist()[0]
                if now != (key := (row["qb"], row["cg"], row["dim"])):
                    if held:
                        yield out()
                    now, held = key, {}
                # Blocks of queries are told apart by all that they hold: many vectors may share an id.
                block = hashlib.blake2b(row["ids"] + row["vectors"], digest_size=16).digest()
                if block not in held:
                    ids = np.frombuffer(row["ids"], np.int64)
                    q = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"])
                    held[block] = (Block(ids, q), [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in q], Best(len(ids), k))
                q, _, best = held[block]
                c_ids = np.frombuffer(row["c_ids"], np.int64)
                compare(q, Block(c_ids, np.frombuffer(row["c"], np.float64).reshape(len(c_ids), row["dim"])), best)
        if held:
            yield out()

    best = met.mapInArrow(top, "query_id long, mark string, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = 5, every: int = 50, scale: int = 256) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= {k}
"""
