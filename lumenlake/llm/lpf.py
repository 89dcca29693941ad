"""Removal of long repeated byte strings by longest-previous-factor arrays.

A string of `length` bytes that starts at two places is found by sorting the strings that start at all places: equal
strings are neighbours in that suffix order, and for every place the previous and the next place in the order that
lie earlier in the text give its longest previous factor.  To do so on many machines:

1. Every string of `length` bytes has a smallest hash among its runs of GRAM bytes.  Neighbouring places with the same
   smallest hash make a chunk.  Equal strings have equal smallest hashes, so only chunks of one key need to be sorted
   together, and a key of one chunk, in which that hash occurs once, has no repeats at all.
2. Chunks of equal bytes repeat as a whole; this is found by their key and a second, independent hash of their bytes,
   and aggregated before the shuffle.  Only chunks that share their key but not their bytes are fetched as text, one of
   each kind.
3. Those are dealt out by key and, where a key has more than KINDS kinds of chunk, also by how far each string starts
   before its smallest hash, which is the same for equal strings; a part gets only the bytes of its own strings.  There
   the places are put into suffix order with their common prefixes (up to `length`, as longer ones decide nothing), and
   the longest previous and next factors come from the previous and next smaller places: a string repeats if a factor
   reaches `length`.  Places whose rolling hash is alone in the part have no such factor and stay out of the order.
4. A key of more than KINDS * PARTS kinds is too much for that: of its strings only two independent hashes, of 128 bits
   together, are shuffled, and counted.  So no task holds more than a fixed number of strings, whatever a key's size.

Equal texts are one text with a count; what holds for it holds for all of its rows.  With keep="none" every byte goes
that lies in a string found elsewhere; with keep="first" the first place of each string, in the order of the texts'
digests and places, stays.

Defined cases: a null text counts as empty; texts shorter than `length` lose nothing; a text of any length is read to
its end; with keep="none" equal texts of at least `length` bytes lose everything, with keep="first" the row with the
smallest doc_id counts as the first; what remains is cut at bytes, so it need not be UTF-8; other columns play no part;
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.lineage import durable
from lumenlake.llm.bytewords import _BYTES, _VALUE, Powers, prefix, span, stretches
from lumenlake.llm.common import frugal
from lumenlake.llm.jaccard import _groups

#: Bytes of a string, bytes of the runs hashed for its key, most places of a chunk, kinds of chunk sorted together, and
#: most parts of a key.
LENGTH, GRAM, MOST, KINDS, PARTS = 400, 48, 512, 512, 16
_OTHER_BYTES, _OTHER_VALUE = Powers(0x9FB21C651E98DF25), np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def window_minima(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    out, k = x, 1
    while 2 * k <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - k : len(x) - k + 1]) if n > k else out


def chunks(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, key, first place, places, fingerprint, whether the key's hash recurs) of the chunks of texts data[at[i]:at[i+1]]."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64, bool))
    gram = min(GRAM, length)
    sums = prefix(_VALUE[data], _BYTES)
    k = np.arange(len(data) - gram + 1)
    grams, width = span(sums, k, k + gram, _BYTES), length - gram + 1
    least = window_minima(grams, width)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    i = np.flatnonzero(np.arange(len(least)) + length <= at[text + 1])
    fresh = np.ones(len(i), bool)
    fresh[1:] = (least[i][1:] != least[i][:-1]) | (i[1:] != i[:-1] + 1) | (text[i][1:] != text[i][:-1])
    run = np.flatnonzero(fresh)
    since = np.arange(len(i)) - np.repeat(run, np.diff(np.concatenate([run, [len(i)]])))
    start = np.flatnonzero(fresh | (since % MOST == 0))
    places = np.diff(np.concatenate([start, [len(i)]]))
    first = i[start]
    raw = data.tobytes()
    prints = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (first + places - 1 + length).tolist(), strict=True)]
    print_ = np.frombuffer(b"".join(prints), np.uint64)
    # Its leftmost place in the first string and its rightmost one in the last: one place, unless it recurs.
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    last = first + places - 1
    left = first + (view[first] == least[first][:, None]).argmax(1)
    right = last + width - 1 - (view[last][:, ::-1] == least[first][:, None]).argmax(1)
    return text[first], least[first], first - at[text[first]], places, print_, left != right


def longest_factors(order: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """(longest previous factor, longest next factor) of every place, by previous and next smaller and greater places.

    order: the places in suffix order; lcp[i]: common prefix of the i-th place in that order and the one before.
    """
    def passes(smaller: bool) -> list[int]:
        best = [0] * len(order)
        for line in (range(len(order)), range(len(order) - 1, -1, -1)):
            stack: list[tuple[int, int]] = []  # (place, least common prefix since the entry below it)
            common, backward = 0, line.step < 0
            for i in line:
                common = lcp[i + 1] if backward and i + 1 < len(order) else lcp[i] if not backward else 0
                place = order[i]
                while stack and (stack[-1][0] > place if smaller else stack[-1][0] < place):
                    common = min(common, stack.pop()[1])
                if stack:
                    best[place] = max(best[place], common)
                stack.append((place, common))
        return best

    return passes(True), passes(False)


def suffix_order(data: np.ndarray, place: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """(places, by number, in the order of the `length` bytes that start there; common prefix of each with the one before)."""
    raw = data.tobytes()
    strings = [raw[p : p + length] for p in place.tolist()]
    order = sorted(range(len(strings)), key=strings.__getitem__)
    lcp = [0] * len(order)
    view, sorted_ = np.lib.stride_tricks.sliding_window_view(data, length), place[order]
    for at in range(1, len(order), 4096):
        differ = view[sorted_[at : at + 4096]] != view[sorted_[at - 1 : at - 1 + len(sorted_[at : at + 4096])]]
        first = differ.argmax(1)
        lcp[at : at + len(first)] = np.where(differ[np.arange(len(first)), first], first, length).tolist()
    return order, lcp


def repeated_strings(kinds: list[tuple[bytes, int]], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of chunks (bytes, places) of one key: whether each place's string occurs (anywhere else, further up) among them."""
    data = np.frombuffer(b"".join(b for b, _ in kinds), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(b) for b, _ in kinds])])
    place = np.concatenate([a + np.arange(n) for a, (_, n) in zip(at, kinds, strict=False)]).astype(np.int64)
    # A string whose rolling hash is alone has no equal; the others are put into suffix order.
    prints = span(prefix(_VALUE[data], _BYTES), place, place + length, _BYTES)
    _, back, count = np.unique(prints, return_inverse=True, return_counts=True)
    own = np.flatnonzero(count[back] > 1)
    earlier, other = np.zeros(len(place), bool), np.zeros(len(place), bool)
    if len(own):
        before, after = longest_factors(*suffix_order(data, place[own], length))
        earlier[own] = np.array(before, np.int64) >= length
        other[own] = np.maximum(before, after) >= length
    ends = np.cumsum([n for _, n in kinds])[:-1]
    return np.split(other, ends), np.split(earlier, ends)


def distances(body: np.ndarray, places: int, key: int, length: int) -> np.ndarray:
    """How far before the next place of its smallest hash (the key) each string of a chunk starts."""
    gram = min(GRAM, length)
    k = np.arange(len(body) - gram + 1)
    smallest = np.flatnonzero(span(prefix(_VALUE[body], _BYTES), k, k + gram, _BYTES) == np.uint64(key % (1 << 64)))
    return smallest[np.searchsorted(smallest, np.arange(places))] - np.arange(places)


def parts_of(kinds: int, length: int) -> int:
    """Into how many parts the strings of a key are dealt; 0 if they are counted by their hashes."""
    needed = -(-kinds // KINDS)
    return 0 if needed > min(PARTS, length - min(GRAM, length) + 1) else needed


def dealt(body: bytes, places: int, key: int, kinds: int, length: int) -> list[tuple[int, int, int, bytes]]:
    """(part, first place, places, bytes) of what the parts of a key get of a chunk: stretches of strings of one part."""
    parts = parts_of(kinds, length)
    if parts == 1:
        return [(0, 0, places, body)]
    part = distances(np.frombuffer(body, np.uint8), places, key, length) * parts // (length - min(GRAM, length) + 1)
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), places]
    return [(int(part[a]), a, b - a, body[a : b - 1 + length]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _chunk_rows(texts: DataFrame, length: int) -> DataFrame:
    """tid, key, start, places, print and recurs of all chunks of texts(tid, body)."""

    @frugal
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tids = part.column(0)
            for first, data, at in stretches(part.column(1)):
                text, key, start, places, print_, recurs = chunks(data, at, length)
                yield pa.RecordBatch.from_arrays([tids.take(pa.array(text + first)), pa.array(key.view(np.int64)), pa.array(start, pa.int64()), pa.array(places, pa.int64()), pa.array(print_.view(np.int64)), pa.array(recurs)], ["tid", "key", "start", "places", "print", "recurs"])

    return texts.mapInArrow(scan, "tid binary, key long, start long, places long, print long, recurs boolean")


def _batch(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _fetch(length: int):
    """From texts with their wanted chunks (tid, body, wanted): what the parts of their keys get of them."""
    names, types = ["key", "part", "multiple", "tid", "start", "places", "bytes"], (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary())

    @frugal
    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, size = [], 0
            for tid, body, wanted in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                for w in wanted:
                    chunk = body[w["start"] : w["start"] + w["places"] - 1 + length]
                    for p, first, places, piece in dealt(chunk, w["places"], w["key"], w["kinds"], length):
                        rows.append((w["key"], p, w["multiple"], tid, w["start"] + first, places, piece))
                        size += len(piece)
                if size > 1 << 22:
                    yield _batch(rows, names, types)
                    rows, size = [], 0
            yield _batch(rows, names, types)

    return fetch


def _strings(length: int):
    """From texts with their wanted chunks: two hashes of every string, with its place."""

    @frugal
    def strings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for tid, body, wanted in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                place = np.unique(np.concatenate([np.arange(w["start"], w["start"] + w["places"]) for w in wanted]))
                data = np.frombuffer(body, np.uint8)
                h = [span(prefix(v[data], powers), place, place + length, powers).view(np.int64) for v, powers in ((_VALUE, _BYTES), (_OTHER_VALUE, _OTHER_BYTES))]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array([tid] * len(place), pa.binary()), pa.array(place, pa.int64())], ["h", "g", "tid", "start"])

    return strings


def _sort(length: int, keep: str):
    """Of what a part gets (key, part, multiple, tid, start, places, bytes): the runs of repeated strings."""

    @frugal
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, int]] = []
        for group in _groups(batches, 2):
            rows = group.to_pylist()
            # The order of the texts' digests and places is the order of the text that keep="first" goes by.
            rows.sort(key=lambda r: (r["tid"], r["start"]))
            other, earlier = repeated_strings([(r["bytes"], r["places"]) for r in rows], length)
            for r, found in zip(rows, other if keep == "none" else earlier, strict=True):
                if r["multiple"] and keep == "none":
                    continue  # already known to repeat as a whole
                edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
                out += [(r["tid"], r["start"] + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            if len(out) > 20_000:
                yield _runs(out)
                out = []
        yield _runs(out)

    return sort


def _runs(out: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], ["tid", "start", "places"])


def covered(size: int, runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The bytes that strings starting in the runs (first place, places) cover, as disjoint spans in order."""
    out: list[list[int]] = []
    for start, places in sorted(runs):
        end = min(size, start + places - 1 + length)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> tuple[DataFrame, DataFrame]:
    """(distinct texts: tid, body, copies, runs; rows: doc_id, tid) where runs hold the places of repeated strings."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.unhex(F.md5(body)).alias("tid"), body.alias("body"))
    texts = rows.groupBy("tid").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    found = _chunk_rows(rows.where(F.octet_length("body") >= length).select("tid", "body"), length)
    found = found.withColumn("place", F.xxhash64("tid", "start"))
    # Written out: each is read several times, and joins whose sides are plain exchanges can be split where a key is frequent.
    keys = durable(found.groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.min("print").alias("p"), F.max("print").alias("q"), F.max("recurs").alias("recurs"))
                   .where("a <> b or recurs").select("key", (~F.col("recurs") & (F.col("p") == F.col("q"))).alias("one_kind")))
    again = durable(found.join(keys, "key").select("key", "print", "tid", "start", "places", "place", "one_kind"))
    kinds = (again.groupBy("key", "print").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.bool_and("one_kind").alias("one_kind")))
    # Chunks whose bytes occur more than once: every place in them repeats.
    whole = (again.select("key", "print", "tid", "start", "places", "place").join(kinds.where("a <> b").select("key", "print", F.col("a").alias("least")), ["key", "print"]))
    if keep == "first":
        order = F.min(F.struct("tid", "start"))
        heads = whole.groupBy("key", "print").agg(order.alias("head"))
        whole = whole.join(heads, ["key", "print"]).where(F.struct("tid", "start") != F.col("head"))
    # One chunk of each kind of the keys that have several.
    several = kinds.where("not one_kind")
    per_key = several.groupBy("key").agg(F.count("*").alias("kinds"))
    chosen = (again.where("not one_kind").groupBy("key", "print").agg(F.min(F.struct("tid", "start", "places")).alias("at"), F.min("place").alias("a"), F.max("place").alias("b"))
              .join(per_key, "key")
              .select(F.col("at.tid").alias("tid"), F.struct("key", "kinds", (F.col("a") != F.col("b")).alias("multiple"), F.col("at.start").alias("start"), F.col("at.places").alias("places")).alias("w")))
    few = F.col("w.kinds") <= KINDS * min(PARTS, length - min(GRAM, length) + 1)
    # All columns of the texts are carried along, so that Spark sees one and the same exchange of them everywhere.
    collected = lambda rows: texts.join(rows.groupBy("tid").agg(F.collect_list("w").alias("wanted")), "tid").select("tid", "body", "wanted", "copies")
    shares = (collected(chosen.where(few)).mapInArrow(_fetch(length), "key long, part long, multiple boolean, tid binary, start long, places long, bytes binary")
              .repartition("key", "part").sortWithinPartitions("key", "part"))
    repeated = whole.select("tid", "start", "places").unionByName(shares.mapInArrow(_sort(length, keep), "tid binary, start long, places long"))
    if not chosen.where(~few).isEmpty():
        strings = collected(chosen.where(~few)).mapInArrow(_strings(length), "h long, g long, tid binary, start long")
        twice = strings.groupBy("h", "g").agg(F.min(F.struct("tid", "start")).alias("head"), F.count("*").alias("n")).where("n > 1")
        found = strings.join(twice.select("h", "g", "head"), ["h", "g"])
        if keep == "first":
            found = found.where(F.struct("tid", "start") != F.col("head"))
        repeated = repeated.unionByName(found.select("tid", "start", F.lit(1).cast("long").alias("places")))
    runs = repeated.groupBy("tid").agg(F.collect_set(F.struct("start", "places")).alias("runs"))
    return texts.join(runs, "tid", "left").select("tid", "body", "copies", "runs"), rows.select("doc_id", "tid")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of every row."""
    texts, rows = repeated_spans(docs, length, keep)

    @frugal
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, copies, runs in batches:
            out = []
            for body, n, found in zip(bodies, copies, runs, strict=True):
                body = bytes(body)
                if keep == "none" and n > 1 and len(body) >= length:
                    spans = [(0, len(body))]
                else:
                    spans = covered(len(body), [(r["start"], r["places"]) for r in found] if found is not None else [], length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(body[at:a])
                    at = b
                left = b"".join([*kept, body[at:]])
                out.append((len(body), len(body) - len(left), len(spans), left, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    done = texts.select("tid", F.pandas_udf(cut, "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")("body", "copies", "runs").alias("r"))
    if keep == "none":
        return rows.join(done, "tid").select("doc_id", "r.*")
    # Of equal texts the row with the smallest doc_id is the first; the others repeat it as a whole if long enough.
    lead = rows.groupBy("tid").agg(F.min("doc_id").alias("lead"))
    empty = F.struct("r.n_bytes", F.col("r.n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    return (rows.join(done, "tid").join(lead, "tid")
            .select("doc_id", F.when((F.col("doc_id") > F.col("lead")) & (F.col("r.n_bytes") >= length), empty).otherwise(F.col("r")).alias("r")).select("doc_id", "r.*"))
