"""Benchmark decontamination by greedy string tiling.

Runs of `min_match` words that a test item shares with a document are the seeds.  Where the seeds could cover enough
of an item, item and document are tiled: running Karp-Rabin hashes find the longest matches of words not yet marked,
the longest are marked first, and the length sought is lowered down to `min_match`.  Tiles may lie in any order, so
reordered passages count as well.  An item has leaked if tiles cover at least `coverage` of its words.

An item's most frequent seeds are left out of the search as long as they cover less of it than is needed for a leak: a
leak has one of the others too.  So a phrase that many items share does not bring them all to every document that has
it.  Items whose texts are at most `block_bytes` together (their size is measured first) go to all workers, and nothing
is shuffled.  More items meet the documents in a join on seeds instead; of the documents only seeds that a Bloom filter
of fixed size finds among the items' are shuffled, and only documents with candidates are tiled.  Both ways find the
same leaks.

Defined cases: an item shorter than `min_match` words matches as a whole run of words, whatever its length, and one
without words never; null or empty texts match nothing; a text of any length is searched to its end; of matches of the
same length the first in the item and then in the document is marked first; equal items are reported each; repeated
rows get equal results; other columns play no part; an empty benchmark contaminates no document, and an empty table of
documents gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.lineage import durable
from lumenlake.llm.bytewords import _WORDS, Batch, arrow_batches, batches, encoded, prefix, span
from lumenlake.llm.common import frugal

#: Least words of a tile, and the share of an item's words that counts as a leak.
MIN_MATCH, COVERAGE = 6, 0.5
#: Most bytes of items that are sent to all workers.
BLOCK_BYTES = 16 << 20
#: Items that a seed may be in before it counts as frequent, pairs of seeds that are held at once, and bits, as a power
#: of two, of the filter of seeds.
FREQUENT, AT_ONCE, BITS = 16, 1 << 21, 26


def rare_seeds(count: np.ndarray, n: int, words: int, coverage: float) -> np.ndarray:
    """Which of an item's seeds (of n words, in order) are searched for, given in how many items each is.

    The most frequent ones are left out while they cover less than the share of the words that a leak needs.
    """
    keep, covered = np.ones(len(count), bool), np.zeros(words, bool)
    for at in np.argsort(-count, kind="stable").tolist():
        if count[at] <= FREQUENT:
            break
        covered[at : at + n] = True
        if covered.sum() >= coverage * words:
            break
        keep[at] = False
    return keep


class Items:
    """Test items, indexed by their rarer seeds."""

    def __init__(self, ids: list[int], texts: list[str], min_match: int, coverage: float = COVERAGE):
        self.ids, self.min_match, self.coverage = ids, min_match, coverage
        batch = Batch(encoded(texts))
        self.words = [batch.word[batch.first[i] : batch.first[i + 1]] for i in range(len(texts))]
        self.table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = np.diff(batch.first)
        for n in sorted({min(min_match, int(w)) for w in size if w}):
            k, h = batch.grams(n)
            item = np.searchsorted(batch.first, k, side="right") - 1
            own = size[item] >= n if n == min_match else size[item] == n
            k, h, item = k[own], h[own], item[own]
            _, back, count = np.unique(h, return_inverse=True, return_counts=True)
            keep = np.ones(len(h), bool)
            for i in np.unique(item[count[back] > FREQUENT]).tolist():
                a, b = np.searchsorted(item, [i, i + 1])
                keep[a:b] = rare_seeds(count[back[a:b]], n, int(size[i]), coverage)
            h, item = h[keep], item[keep]
            order = np.lexsort((item, h))
            h, item = h[order], item[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
            self.table[n] = (h[fresh], item[fresh])

    def candidates(self, batch: Batch) -> np.ndarray:
        """Pairs document * items + item that share a seed, in order."""
        out = []
        for n, (h, item) in self.table.items():
            k, g = batch.grams(n)
            if not len(h) or not len(g):
                continue
            sieve = np.zeros(1 << 20, bool)
            sieve[(h >> np.uint64(44)).astype(np.int64)] = True
            maybe = sieve[(g >> np.uint64(44)).astype(np.int64)]
            k, g = k[maybe], g[maybe]
            lo = np.searchsorted(h, g, "left")
            many = np.searchsorted(h, g, "right") - lo
            k, lo, many = k[many > 0], lo[many > 0], many[many > 0]
            doc = np.searchsorted(batch.first, k, side="right") - 1
            # A seed that recurs in a document brings its items once.
            _, first = np.unique(np.stack([doc, lo]), axis=1, return_index=True)
            doc, lo, many = doc[first], lo[first], many[first]
            edge = np.concatenate([[0], np.cumsum(many)])
            for a in _slices(edge):
                at = np.repeat(lo[a] - (edge[a.start : a.stop] - edge[a.start]), many[a]) + np.arange(edge[a.stop] - edge[a.start])
                out.append(np.unique(np.repeat(doc[a], many[a]) * len(self.ids) + item[at]))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def leaks(self, batch: Batch, coverage: float | None = None) -> dict[int, list[tuple[int, float, int]]]:
        """Document -> (item id, covered share, tiles) of what has leaked into it."""
        out: dict[int, list[tuple[int, float, int]]] = {}
        for pair in self.candidates(batch).tolist():
            doc, item = divmod(pair, len(self.ids))
            found = leak(batch.word[batch.first[doc] : batch.first[doc + 1]], self.words[item], self.min_match, self.coverage if coverage is None else coverage)
            if found is not None:
                out.setdefault(doc, []).append((self.ids[item], *found))
        return out


def _slices(edge: np.ndarray) -> Iterator[slice]:
    """Stretches between running sums that grow by about AT_ONCE each."""
    a = 0
    while a < len(edge) - 1:
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + AT_ONCE, "right")) - 1)
        yield slice(a, b)
        a = b


def seeds_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    k = np.arange(max(0, len(words) - n + 1))
    return span(prefix(words, _WORDS), k, k + n, _WORDS)


def leak(doc: np.ndarray, item: np.ndarray, min_match: int, coverage: float) -> tuple[float, int] | None:
    """(covered share, tiles) if the item has leaked into the document."""
    n = min(min_match, len(item))
    reach = np.zeros(len(item) + 1, np.int64)
    at = np.flatnonzero(np.isin(seeds_of(item, n), seeds_of(doc, n)))
    reach[at] += 1
    np.add.at(reach, at + n, -1)
    if (np.cumsum(reach[:-1]) > 0).sum() < coverage * len(item):
        return None  # not even with all seeds
    tiles = tile(doc, item, n)
    share = sum(t[2] for t in tiles) / len(item)
    return (share, len(tiles)) if share >= coverage else None


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of words: (start in doc, start in item, words) of the tiles, longest first."""
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    doc_sums, item_sums = prefix(doc, _WORDS), prefix(item, _WORDS)
    tiles, size = [], max(least, len(item))
    while True:
        found = [(-n, i, d) for d, i, n in _matches(doc, item, doc_free, item_free, doc_sums, item_sums, size)]
        heapq.heapify(found)
        while found:
            n, i, d = heapq.heappop(found)
            free = doc_free[d : d - n] & item_free[i : i - n]
            if free.all():
                doc_free[d : d - n] = item_free[i : i - n] = False
                tiles.append((d, i, -n))
                continue
            # What longer tiles have left of the match takes its place among the others.
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= size:
                    heapq.heappush(found, (a - b, i + a, d + a))
        if size == least:
            return tiles
        size = max(least, size // 2)


def _matches(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray, doc_sums: np.ndarray, item_sums: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Longest extensions of the matches of n unmarked words."""
    d, i = _free_runs(doc_free, n), _free_runs(item_free, n)
    if not len(d) or not len(i):
        return []
    places: dict[int, list[int]] = {}
    own = span(item_sums, i, i + n, _WORDS)
    for h, at in zip(own.tolist(), i.tolist(), strict=True):
        places.setdefault(h, []).append(at)
    hashes = span(doc_sums, d, d + n, _WORDS)
    out, beyond = [], {}
    for at in np.flatnonzero(np.isin(hashes, own)):
        a = int(d[at])
        for b in places[int(hashes[at])]:
            if beyond.get(a - b, -1) >= a + n or not np.array_equal(doc[a : a + n], item[b : b + n]):
                continue  # part of the match before it
            k = n
            while a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k] and doc_free[a + k] and item_free[b + k]:
                k += 1
            beyond[a - b] = a + k
            out.append((a, b, k))
    return out


def _free_runs(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of n unmarked places in a row."""
    if len(free) < n:
        return np.zeros(0, np.int64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[n:] == marked[:-n])


_KIND = "array<struct<item_id: long, coverage: double, tiles: int>>"


def _search(block, min_match: int, coverage: float):
    """A column function from texts to what of the broadcast items has leaked into them."""

    @F.pandas_udf(_KIND)
    @frugal
    def leaks(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(*block.value, min_match, coverage)
        for column in columns:
            out = [[] for _ in range(len(column))]
            for first, batch in batches(encoded(column)):
                for doc, hits in items.leaks(batch).items():
                    out[first + doc] = [{"item_id": i, "coverage": c, "tiles": t} for i, c, t in hits]
            yield pd.Series(out, dtype=object)

    return leaks


def _item_seeds(min_match: int):
    """From items (key, text): key, words, n and, of every seed, its hash and place."""

    @frugal
    def seeds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            batch = Batch(encoded(part.column(1).to_pylist()))
            rows = []
            for i, key in enumerate(part.column(0).to_pylist()):
                words = batch.word[batch.first[i] : batch.first[i + 1]]
                n = min(min_match, len(words))
                rows += [(key, len(words), n, int(h), at) for at, h in enumerate(seeds_of(words, n).view(np.int64).tolist())] if n else []
            types = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["key", "words", "n", "seed", "at"])

    return seeds


def _doc_seeds(lengths: list[int], wanted):
    """From texts (tid, text): tid, n and hash of the seeds that may be an item's."""

    @frugal
    def seeds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.int64)
        for part in parts:
            for first, batch in arrow_batches(part.column(1)):
                for n in lengths:
                    k = np.arange(max(0, len(batch.word) - n + 1))
                    text = np.searchsorted(batch.first, k, side="right") - 1
                    inside = k + n <= batch.first[text + 1]
                    k, text = k[inside], text[inside]
                    h = span(prefix(batch.word, _WORDS), k, k + n, _WORDS)
                    at = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    known = (bits[at >> 6] >> (at & 63)) & 1 == 1
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(first + text[known])), pa.array(np.full(known.sum(), n), pa.int32()), pa.array(h[known].view(np.int64))], ["tid", "n", "seed"])

    return seeds


def _tiled(min_match: int, coverage: float):
    """From pairs (tid, ids of the item, its text, the document's text): the leaks."""

    @frugal
    def leaks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, last, words = [], None, None
            for tid, ids, item, text in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if tid != last:
                    last, words = tid, Batch(encoded([text])).word
                if (found := leak(words, Batch(encoded([item])).word, min_match, coverage)) is not None:
                    rows += [(tid, i, *found) for i in ids]
            types = (pa.binary(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["tid", "item_id", "coverage", "tiles"])

    return leaks


def _joined(docs: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """tid, item_id, coverage and tiles of all leaks into texts, by a join on seeds; tid is the MD5 of a text."""
    spark = docs.sparkSession
    known = items.select(F.unhex(F.md5(F.col("t").cast("binary"))).alias("key"), "id", "t").groupBy("key").agg(F.first("t").alias("t"), F.collect_list(F.coalesce("id", F.lit(-1 << 63))).alias("ids"))
    seeds = durable(known.select("key", "t").mapInArrow(_item_seeds(min_match), "key binary, words int, n int, seed long, at int"))

    def rare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        keep = rare_seeds(pdf["count"].to_numpy(), int(pdf["n"].iloc[0]), int(pdf["words"].iloc[0]), coverage)
        return pdf[keep][["key", "n", "seed"]].drop_duplicates()

    counted = seeds.join(seeds.groupBy("n", "seed").count(), ["n", "seed"])
    kept = durable(counted.groupBy("key").applyInPandas(rare, "key binary, n int, seed long"))
    lengths = sorted(r.n for r in kept.select("n").distinct().collect())  # at most min_match of them
    words = kept.select(F.shiftright(F.col("seed").bitwiseAND(F.lit((1 << BITS) - 1)), 6).alias("word"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)  # at most that many rows
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("tid"), "text")
    asked = texts.mapInArrow(_doc_seeds(lengths, spark.sparkContext.broadcast(bits.tobytes())), "tid binary, n int, seed long")
    # Both sides are plain exchanges, so Spark can split the join at a frequent seed.
    pairs = durable(asked.join(kept, ["n", "seed"]).select("tid", "key").distinct())
    bodies = texts.join(pairs.select("tid").distinct(), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    return pairs.join(known, "key").join(bodies, "tid").select("tid", "ids", "t", "text").mapInArrow(_tiled(min_match, coverage), "tid binary, item_id long, coverage double, tiles int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, into: str = "leaks", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with an array `into` (replaced if there) of (item_id, coverage, tiles) of the leaked items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    if size <= block_bytes:
        rows = sorted(items.collect(), key=lambda r: (r.id is None, r.id or 0, r.t))  # at most block_bytes
        block = docs.sparkSession.sparkContext.broadcast(([r.id for r in rows], [r.t for r in rows]))
        return docs.withColumn(into, _search(block, min_match, coverage)(F.col("text").cast("string")) if rows else F.array().cast(_KIND))
    found = _joined(docs, items, min_match, coverage)
    one = F.struct(F.when(F.col("item_id") != -1 << 63, F.col("item_id")).alias("item_id"), "coverage", "tiles")
    leaks = durable(found.groupBy("tid").agg(F.array_sort(F.collect_list(one)).alias("leaks")))
    names = [c for c in docs.columns if c.lower() != into.lower()]
    # The row is packed, so that no column's name can clash.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("tid"))
    joined = packed.join(leaks, "tid", "left")
    return joined.select(*(F.col("row")[c].alias(c) for c in names), F.coalesce("leaks", F.array().cast(_KIND)).alias(into))
