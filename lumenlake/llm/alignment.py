"""Alignment of two tokenizers over the same texts.

Every text is encoded by tokenizer A (with a space put before it) and by tokenizer B (which puts one there itself).  An
Arrow batch becomes two tables of token intervals in bytes, in a DuckDB connection of the task: ASOF joins find the first
and the last B token that an A token meets, a range join lists those between them, and running sums over the places
where both end number the groups.  The intervals of a batch follow each other in one row of bytes, so that no join needs
the text's number.

How many documents hold a pair of ids linked is counted in two steps: a task numbers the distinct pairs of a block of
documents and counts each in the block, and Spark adds the blocks' counts up.  A block hands on each of its distinct
pairs once, and gets the pair's count back under its number; the links themselves stay with the block, as numbers in
order, compressed.  So neither a text nor a link is shuffled by its ids, and a common pair costs one row a block.

Blocks are written as a table before they are read twice.  Very long texts go through DuckDB in segments, which end
where both tokenizers' tokens end, and so do groups and links; a task holds the ids of one such text.

Defined cases: null and empty texts, and texts that one of the tokenizers' tokens do not spell (a text with U+2581 in
it, which B takes for a space), have no tokens: zeros and an empty groups_sha256; texts of special tokens are plain text;
repeated rows count each as a document; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.lineage import written
from lumenlake.llm.common import frugal
from lumenlake.llm.resync import Resync, coder

#: Bytes of text that go through DuckDB at once, and of the texts of a block; the memory that a connection may take.
AT_ONCE, BLOCK, MEMORY = 1 << 20, 8 << 20, "200MB"
#: Bytes of the chunks in which very long texts are encoded.
CHUNK = 1 << 18

#: The B token that each A token begins in, and the B tokens that begin inside of an A token: tables, so that the range join
#: of those that are left is planned by their true sizes.
_STEPS = (
    "CREATE OR REPLACE TEMP TABLE low AS SELECT a.seg, a.id, a.s, a.e, b.id AS b, b.e AS until FROM a ASOF JOIN b ON a.s >= b.s",
    "CREATE OR REPLACE TEMP TABLE inner_b AS SELECT b.id, b.s FROM b ANTI JOIN a ON a.s = b.s",
    "CREATE OR REPLACE TEMP TABLE wide AS SELECT seg, id, s, e FROM low WHERE e > until",
)
_LINKS = """
WITH met AS (SELECT seg, id, b FROM low UNION ALL SELECT wide.seg, wide.id, inner_b.id FROM wide JOIN inner_b ON inner_b.s > wide.s AND inner_b.s < wide.e)
SELECT seg, id AS a, b, count(*)::INTEGER AS many FROM met GROUP BY ALL ORDER BY seg
"""
#: The places where both tokens end, that is the last A and B token of every group, numbered by a running sum.
_GROUPS = "SELECT a.i, b.j, sum(1) OVER (ORDER BY a.i ROWS UNBOUNDED PRECEDING)::INTEGER AS g FROM a JOIN b ON a.e = b.e"


class Joiner:
    """The DuckDB connection of a task."""

    def __init__(self):
        import duckdb

        self.connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": "false"})

    def run(self, segments: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of segments (ids and lengths by A, ids and lengths by B): links (seg, a, b, many), and the first A and B token after
        each group, in order."""
        for name, number, ids, lengths in (("a", "i", 0, 1), ("b", "j", 2, 3)):
            size = np.concatenate([s[lengths] for s in segments])
            end = np.cumsum(size, dtype=np.int64)
            self.connection.register(name, pa.table({
                "seg": np.repeat(np.arange(len(segments), dtype=np.int32), [len(s[ids]) for s in segments]), number: np.arange(len(end), dtype=np.int32), "id": np.concatenate([s[ids] for s in segments]), "s": end - size, "e": end}))
        for step in _STEPS:
            self.connection.execute(step)
        links, groups = self.connection.execute(_LINKS).fetchnumpy(), self.connection.execute(_GROUPS).fetchnumpy()
        self.connection.unregister("a")
        self.connection.unregister("b")
        order = np.empty(len(groups["g"]), np.int64)
        order[groups["g"] - 1] = np.arange(len(order))
        return links, groups["i"][order].astype(np.int64) + 1, groups["j"][order].astype(np.int64) + 1


def segments(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(first and last A token, first and last B token) of segments of about `most` bytes, from the tokens' ends."""
    if a[-1] <= most:
        return [(0, len(a), 0, len(b))]
    both = np.intersect1d(a, b, assume_unique=True)
    picked = both[np.unique(np.searchsorted(both, np.arange(most, a[-1] + most, most)).clip(max=len(both) - 1))]
    at, bt = np.searchsorted(a, picked) + 1, np.searchsorted(b, picked) + 1
    return list(zip([0, *at[:-1].tolist()], at.tolist(), [0, *bt[:-1].tolist()], bt.tolist(), strict=True))


class Aligner:
    """Encodes texts by both tokenizers and joins their tokens."""

    def __init__(self, a, b, at_once: int = AT_ONCE):
        self.a, self.b, self.at_once = Resync(a, CHUNK), Resync(b, CHUNK), at_once
        self.joiner = Joiner()
        # An id with what may stand before it: nothing, the comma within a side, the bar between sides, the next group's sign.
        self.size = max(len(a.bytes), len(b.bytes))
        self.signed = pa.array([sign + str(i) for sign in ("", ",", "|", ";") for i in range(self.size)], pa.large_string())
        self.spelling = pa.array(a.bytes, pa.large_binary()), pa.array(b.bytes, pa.large_binary())

    def _spelled(self, side: int, ids: list[np.ndarray], raws: list[bytes]) -> list[bool]:
        """Whether the tokens of each text spell it."""
        if not (total := sum(map(len, ids))):
            return [not r for r in raws]
        got = self.spelling[side].take(pa.array(np.concatenate(ids)))
        at = np.frombuffer(got.buffers()[1], np.int64, total + 1)[np.concatenate([[0], np.cumsum([len(i) for i in ids])])].tolist()
        data = got.buffers()[2].to_pybytes()
        return [data[x:y] == r for x, y, r in zip(at, at[1:], raws, strict=False)]

    def _bodies(self, held: list[tuple], i: np.ndarray, j: np.ndarray) -> list[memoryview]:
        """The groups of each segment as text; i and j are the first tokens after each group."""
        of_a, of_b = (np.cumsum([len(s[n]) for _, s in held]) for n in (0, 2))
        i0, j0 = (np.concatenate([[0], x[:-1]]) for x in (i, j))
        code = np.empty(int(i[-1] + j[-1]), np.int64)
        # A group's A tokens stand before its B tokens, after all tokens of the groups before.
        for first, last, shift, ids, number, sign in ((i0, i, j0, 0, 0, 3), (j0, j, i, 2, 1, 2)):
            signs = np.ones(int(last[-1]), np.int64)
            signs[first] = sign
            if not number:
                signs[np.concatenate([[0], of_a[:-1]])] = 0
            code[np.arange(int(last[-1])) + np.repeat(shift, last - first)] = np.concatenate([s[ids] for _, s in held]) + signs * self.size
        text = self.signed.take(pa.array(code))
        at = np.frombuffer(text.buffers()[1], np.int64, len(code) + 1)[np.concatenate([[0], of_a + of_b])].tolist()
        data = memoryview(text.buffers()[2])
        return [data[x:y] for x, y in zip(at, at[1:], strict=False)]

    def run(self, texts: list[str]) -> tuple[list[tuple[int, int, int, int, str]], list[tuple[np.ndarray, np.ndarray]]]:
        """Of each text: (n_a, n_b, n_groups, n_links, groups_sha256), and (distinct pairs as a << 32 | b, times linked)."""
        spaced = [" " + t for t in texts]
        raws = [t.encode() if len(t) > 1 else b"" for t in spaced]
        ids = [list(self.a.ids(spaced)), list(self.b.ids(texts))]
        spelled = [self._spelled(0, ids[0], raws), self._spelled(1, ids[1], raws)]
        counts = [[0, 0, 0, 0] for _ in texts]
        hashes = [None] * len(texts)
        pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
        held: list[tuple[int, tuple]] = []
        size = 0

        def join() -> None:
            links, i, j = self.joiner.run([s for _, s in held])
            at = np.searchsorted(links["seg"], np.arange(len(held) + 1)).tolist()
            keys, many = links["a"].astype(np.int64) << 32 | links["b"].astype(np.int64), links["many"].astype(np.int64)
            groups = np.searchsorted(i, np.concatenate([[0], np.cumsum([len(s[0]) for _, s in held])]), "right").tolist()
            total = np.concatenate([[0], np.cumsum(many)])[at].tolist()
            for k, ((n, _), body) in enumerate(zip(held, self._bodies(held, i, j), strict=True)):
                if hashes[n] is None:
                    hashes[n] = hashlib.sha256()
                else:
                    hashes[n].update(b";")
                hashes[n].update(body)
                counts[n][2] += groups[k + 1] - groups[k]
                counts[n][3] += total[k + 1] - total[k]
                pairs[n].append((keys[at[k] : at[k + 1]], many[at[k] : at[k + 1]]))
            held.clear()

        for n, (raw, a, b) in enumerate(zip(raws, *ids, strict=True)):
            if not raw or not spelled[0][n] or not spelled[1][n]:
                continue
            counts[n][:2] = len(a), len(b)
            la, lb = self.a.tokenizer.lengths[a], self.b.tokenizer.lengths[b]
            for a0, a1, b0, b1 in segments(np.cumsum(la), np.cumsum(lb), self.at_once):
                held.append((n, (a[a0:a1], la[a0:a1], b[b0:b1], lb[b0:b1])))
                size += int(la[a0:a1].sum())
                if size >= 2 * self.at_once:
                    join()
                    size = 0
        if held:
            join()
        linked = []
        for parts in pairs:
            if len(parts) > 1:  # of a text in segments
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                linked.append((keys, np.bincount(place, np.concatenate([m for _, m in parts])).astype(np.int64)))
            else:
                linked.append(parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return [(*c, "" if h is None else h.hexdigest()) for c, h in zip(counts, hashes, strict=True)], linked


def _pack(sizes: np.ndarray, numbers: np.ndarray, many: np.ndarray) -> bytes:
    """A block's links: pairs of each document, their numbers, and how often each is linked."""
    import zstandard

    # In order within a document, numbers are small steps; bytes of one place lie together.
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (sizes, np.diff(numbers, prepend=0), many)]
    return np.array([len(sizes), len(numbers)], "<u8").tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    docs, n = (int(x) for x in np.frombuffer(raw[:16], "<u8"))
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[16:], max_output_size=4 * docs + 8 * n), np.uint8)
    sizes, steps, many = (np.ascontiguousarray(p.reshape(4, -1).T).view("<u4").ravel() for p in np.split(data, [4 * docs, 4 * (docs + n)]))
    # Steps were taken modulo 2**32, from one document's last number to the next one's first.
    return sizes.astype(np.int64), np.cumsum(steps, dtype=np.uint32).astype(np.int64), many.astype(np.int64)


_DOCS = "array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _blocks(docs: DataFrame, files, at_once: int, block: int) -> DataFrame:
    """Documents in blocks: their counts and links, and the block's distinct pairs with the documents that hold each."""

    @frugal
    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, a_json), (b, b_json) = files.value
        aligner = Aligner(coder(a, a_json, True), coder(b, b_json, True), at_once)
        facts: list[dict] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, numbers, held = np.unique(np.concatenate([k for k, _ in links]), return_inverse=True, return_counts=True)
            # Numbered by how many documents hold them, so that common pairs have small numbers.
            order = np.argsort(-held, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sizes = np.array([len(k) for k, _ in links], np.int64)
            numbers, many = place[numbers], np.concatenate([m for _, m in links])
            within = np.lexsort((numbers, np.repeat(np.arange(len(sizes)), sizes)))
            keys, held = keys[order], held[order]
            columns = {"block": ([uuid.uuid4().hex], pa.string()), "docs": ([facts], None), "links": ([_pack(sizes, numbers[within], many[within])], pa.binary())}
            arrays = [pa.array(*c) if c[1] is not None else pa.array(c[0], pa.list_(pa.struct([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]))) for c in columns.values()]
            arrays += [pa.array([x], pa.list_(t)) for x, t in (((keys >> 32).astype(np.int32), pa.int32()), ((keys & 0xFFFFFFFF).astype(np.int32), pa.int32()), (held.astype(np.int64), pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, [*columns, "a", "b", "held"])

        for part in parts:
            ids, texts = part.column(0), part.column(1)
            first = 0
            while first < part.num_rows:
                now, last = 0, first
                run: list[str] = []
                while last < part.num_rows and now < at_once:
                    run.append(texts[last].as_py() or "")
                    now += len(run[-1])
                    last += 1
                counts, linked = aligner.run(run)
                facts += [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (i, *c), strict=True)) for i, c in zip(ids.slice(first, last - first).to_pylist(), counts, strict=True)]
                links += linked
                first, size = last, size + now
                if size >= block:
                    yield out()
                    facts, links, size = [], [], 0
        if facts:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, f"block string, docs {_DOCS}, links binary, a array<int>, b array<int>, held array<long>")


def align(docs: DataFrame, a_path: str, b_path: str, at_once: int = AT_ONCE, block: int = BLOCK) -> DataFrame:
    """Per row of docs(doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The tokenizers' files (a megabyte or two each) are read by the driver and go to the workers with the function.
    """
    loaded = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            loaded.append((f.read(), path.endswith(".json")))
    files = docs.sparkSession.sparkContext.broadcast(loaded)
    blocks = written(_blocks(docs, files, at_once, block))
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "held")).alias("number", "pair")).select("block", "number", "pair.a", "pair.b", "pair.held")
    totals = pairs.groupBy("a", "b").agg(F.sum("held").alias("total"))
    best = totals.groupBy("a").agg(F.max("total").alias("most"))
    rated = totals.join(best, "a").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))
    back = pairs.select("block", "number", "a", "b").join(rated, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("number", "total", "best")).alias("back"))
    ready = blocks.select("block", "docs", "links").join(back, "block", "left").select("docs", "links", F.col("back.number").alias("number"), F.col("back.total").alias("total"), F.col("back.best").alias("best"))

    @frugal
    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                facts, number, count, best = (part.column(c)[r].values for c in (0, 2, 3, 4))
                sizes, numbers, many = _unpack(part.column(1)[r].as_py())
                totals, tops = np.zeros(len(number or ()), np.int64), np.zeros(len(number or ()), bool)
                if len(totals):
                    at = number.to_numpy()
                    totals[at], tops[at] = count.to_numpy(), best.to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums, bests = (np.concatenate([[0], np.cumsum(many * x[numbers])]) for x in (totals, tops))
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
                arrays = [facts.field(n) for n in names] + [pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in (bests, sums)] + [facts.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "n_best", "count_sum", "groups_sha256"])

    return ready.mapInArrow(total, _RESULT)
