"""Vector search: one query or many, exact; and what is done with the results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import vector
from lumenlake.plans.search_plan import SearchPlan, apply_filter

#: Queries of a block and vectors of a tile in batch search.
QUERY_BLOCK, TILE = 256, 4096
#: Queries that are broadcast, and groups of tiles that more of them are sent to.
FEW, GROUPS = 1024, 64
#: Decimals by which scores are compared in batch search.
DIGITS = 12


def search(photos: DataFrame, query: list[float], top_k: int = 20, min_score: float | None = None) -> DataFrame:
    """The top_k photos by cosine with the query; min_score is applied to those only, and nothing fills up.

    Photos without a vector take no part; ties go to the smaller ord.  Sort and limit are one top-k node in Spark.
    """
    scored = photos.where(vector.present(F.col("embedding"))).withColumn("score", vector.query_cosine(query, vector.as_double(F.col("embedding"))))
    top = scored.orderBy(F.desc("score"), "ord").limit(max(0, top_k))
    return top if min_score is None else top.where(F.col("score") >= min_score)


def search_details(photos: DataFrame, plan: SearchPlan, query: list[float], top_k: int = 20, min_score: float | None = None, fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, one row of total_count, candidate_count and metadata_fallback) of a planned search."""
    candidates = apply_filter(photos, plan.filter, fallback)
    counts = photos.agg(F.count("*").alias("total_count")).crossJoin(candidates.agg(F.count("*").alias("candidate_count"), F.coalesce(F.bool_or("metadata_fallback"), F.lit(False)).alias("metadata_fallback")))
    return search(candidates, query, top_k, min_score), counts


def packed(rows: DataFrame, keys: dict[str, str], most: int, by: str | None = None) -> DataFrame:
    """rows (the keys, embedding) with up to `most` of a partition in one row: lists of the keys, of the vectors' sizes
    and of their components.  With `by`, a long column that partitions are sorted by, those of one row have it in common."""
    names, kept = list(keys), [] if by is None else [by]
    schema = ", ".join([*(f"{n} bigint" for n in kept), *(f"{n} array<{k}>" for n, k in keys.items()), "sizes array<int>", "values array<double>"])

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(array: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

        for part in parts:
            ends = [part.num_rows]
            if kept and part.num_rows:
                of = part.column(0).to_numpy()
                ends = [*(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), part.num_rows]
            for start, end in zip([0, *ends], ends):  # noqa: B905
                for at in range(start, end, most):
                    piece = part.slice(at, min(most, end - at))
                    vectors = piece.column(len(kept) + len(names))
                    yield pa.RecordBatch.from_arrays([*(piece.column(k).slice(0, 1) for k in range(len(kept))), *(one(piece.column(len(kept) + k)) for k in range(len(names))), one(pa.compute.list_value_length(vectors)), one(vectors.flatten())],
                                                     [*kept, *names, "sizes", "values"])

    return rows.select(*kept, *names, "embedding").mapInArrow(pack, schema)


def by_size(sizes: list[int], values: list[float]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Size of vectors -> (their places, the vectors at unit length)."""
    sizes, values = np.asarray(sizes, np.int64), np.asarray(values, np.float64)
    ends = np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        m = values[(ends[at] - n)[:, None] + np.arange(n)[None, :]]
        out[n] = (at, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))
    return out


def _present(df: DataFrame) -> DataFrame:
    return df.where(vector.present(F.col("embedding"))).withColumn("embedding", vector.as_double(F.col("embedding")))


def best_of(q: np.ndarray, m: np.ndarray, ord_: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, rows of m, scores): the top_k rows of m for each of q by score, then by ord_.

    How a product is rounded depends on the block that a row is in, so scores are compared in DIGITS decimals.
    """
    table = q @ m.T
    if len(m) > top_k:
        least = np.partition(table, len(m) - top_k, axis=1)[:, len(m) - top_k]
        i, j = np.nonzero(table >= (least - 2 * 10.0**-DIGITS)[:, None])
    else:
        i, j = (x.ravel() for x in np.indices(table.shape))
    score = np.round(table[i, j], DIGITS)
    order = np.lexsort((ord_[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < top_k
    return i[first], j[first], score[first]


def meet_blocks(queries: DataFrame, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Every row of packed `rows` with every block of queries(query_id, embedding): the block's query_id, q_sizes and
    q_values, then the columns.

    Up to FEW queries are broadcast.  More of them are sent to every one of GROUPS groups of rows, which are dealt out by
    their first ord; so rows are sent once, however many queries there are, and never broadcast: what Spark expects of their
    size comes from the files that they were made from.
    """
    asked = _present(queries)
    many = asked.count()
    blocks = max(1, -(-many // QUERY_BLOCK))
    those = packed(asked.repartition(blocks, F.xxhash64("query_id")), {"query_id": dict(queries.dtypes)["query_id"]}, QUERY_BLOCK)
    those = those.withColumnsRenamed({"sizes": "q_sizes", "values": "q_values"})
    if many <= FEW:
        return rows.crossJoin(F.broadcast(those)).select("query_id", "q_sizes", "q_values", *columns)
    grouped = rows.withColumn("block", F.pmod(F.xxhash64(F.col("ord")[0]), F.lit(GROUPS)).cast("int"))
    sent = those.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    return grouped.join(sent.hint("merge"), "block").select("query_id", "q_sizes", "q_values", *columns)


def score_blocks(met: DataFrame, kinds: dict[str, str], top_k: int) -> DataFrame:
    """(query_id, id, ord, score): the best of each query in every row of met(query_id, q_sizes, q_values, id, ord, sizes,
    values), by one matrix product each."""
    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for n in range(part.num_rows):
                q_ids, ids, ords = (part.column(k)[n].values for k in (0, 3, 4))
                ord_ = ords.to_numpy(zero_copy_only=False)
                asked, members = (by_size(part.column(k)[n].values.to_numpy(zero_copy_only=False), part.column(k + 1)[n].values.to_numpy(zero_copy_only=False)) for k in (1, 5))
                for size, (q_at, q) in asked.items():
                    if size not in members:
                        continue
                    at, m = members[size]
                    i, j, scores = best_of(q, m, ord_[at], top_k)
                    who, what = pa.array(q_at[i]), pa.array(at[j])
                    yield pa.RecordBatch.from_arrays([q_ids.take(who), ids.take(what), ords.take(what), pa.array(scores)], ["query_id", "id", "ord", "score"])

    return met.mapInArrow(score, f"query_id {kinds['q']}, id {kinds['i']}, ord long, score double")


def batch_search(queries: DataFrame, corpus: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the top_k of corpus(id, ord, embedding) for each of queries(query_id, embedding).

    Both sides are packed in blocks where they lie; every block of the corpus meets every block of queries, a pair of
    blocks is scored by one matrix product, and only its best of each query are shuffled for the final ranks.  Scores that
    agree in DIGITS decimals are ties, which go to the smaller ord.
    """
    kinds = {"q": dict(queries.dtypes)["query_id"], "i": dict(corpus.dtypes)["id"]}
    rows = packed(_present(corpus).withColumn("ord", F.col("ord").cast("long")), {"id": kinds["i"], "ord": "bigint"}, TILE)
    best = score_blocks(meet_blocks(queries, rows, ("id", "ord", "sizes", "values")), kinds, top_k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def rerank(results: DataFrame, recency_bonus: float = 0.0) -> DataFrame:
    """results (score, captured_at, ord) with final_score: a bonus for those with a capture time; best first."""
    dated = (F.coalesce(F.length(F.col("captured_at").cast("string")), F.lit(0)) > 0).cast("int")
    return results.withColumn("final_score", F.col("score") + recency_bonus * dated).orderBy(F.desc("final_score"), "ord")


def decorated(results: DataFrame) -> DataFrame:
    """results with asset id and thumbnail path for photos of the remote manager."""
    remote = F.col("source") == "immich"
    asset = F.regexp_replace(F.col("id").cast("string"), "^immich:", "")
    return results.withColumn("immich_asset_id", F.when(remote, asset)).withColumn("thumbnail_url", F.when(remote, F.concat(F.lit("/immich/assets/"), asset, F.lit("/thumbnail"))))


def listing(photos: DataFrame, root: str = "", files: DataFrame | None = None) -> DataFrame:
    """id, filename, relative path, capture time and score of photos, by path.

    files (id, path): files of the folder, of which those not analysed yet are listed without time and score.
    """
    if files is not None:
        kinds = dict(photos.dtypes)
        fresh = files.join(photos.select("id"), "id", "left_anti")
        missing = [c for c in ("original_filename", "captured_at", "quality") if c in kinds]
        photos = photos.select("id", "path", *missing).unionByName(fresh.select("id", "path", *(F.lit(None).cast(kinds[c]).alias(c) for c in missing)))
    name = F.coalesce("original_filename", F.element_at(F.split("path", "/"), -1))
    relative = F.when(F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")), F.substring("path", len(root.rstrip("/")) + 2, 1 << 30)).otherwise(F.col("path"))
    return photos.select("id", name.alias("filename"), relative.alias("relative_path"), "captured_at", F.col("quality.score").alias("quality_score")).orderBy("relative_path")


def health(photos: DataFrame, encoder: str = "hash") -> DataFrame:
    return photos.agg(F.count("*").alias("photos"), F.count_if(vector.present(F.col("embedding"))).alias("with_vectors")).withColumn("encoder", F.lit(encoder))


def project_id_is_valid(project_id: Column) -> Column:
    return F.coalesce(project_id.rlike("^[a-f0-9]{12}$"), F.lit(False))


def lookup(photos: DataFrame, photo_id: str) -> DataFrame:
    """The first photo with the id, if any."""
    return photos.where(F.col("id").cast("string") == str(photo_id)).orderBy("ord").limit(1)
