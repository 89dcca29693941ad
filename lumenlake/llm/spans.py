"""Substring dedup by sliding sentence spans.

From every sentence of a text the shortest run of sentences that has at least `least_sentences` of them and
`least_words` words is hashed, and so is the shortest one up to every sentence, so that a repeated passage is covered
to both its ends.  Equal runs meet in a join over all documents; the first one, by doc_id, text and then by
place, stays, and every word that another one covers is removed from its text.  Words are compared without case
and punctuation.  A sentence ends at a line's end or at one of . ! ? before white space; a sentence of more than
LONG words is also cut at words that their hash picks.

Sentences may be cut differently in two copies, and a passage may begin and end inside of them.  So runs of GRAM words
are hashed as well wherever they start, if their hash is the least of PICK starts in a row.  That depends on the words
alone: two stretches of GRAM + PICK - 1 equal words have a run in common, and runs follow each other without a gap.
Of a passage that ends inside a sentence up to PICK - 1 words may stay at that end.

Runs are known by 64 and 32 bits of two independent hashes.  Texts are read twice.  The first time only hashes go to
the shuffle, counted before it; those that occur more than once set bits of a filter of fixed size.  The second time
runs that the filter passes are written out with their places, aggregated (before the shuffle) to the first and last
(doc_id, text) of each, so a passage that a third of all documents share is one row per task, and joined with that
first place; Spark can split that join where a run is frequent.  Only texts that are cut are shuffled, once, by
document, told by a second filter.  What the filters let pass in excess, and be it all, costs time but changes nothing.

Defined cases: null texts stay null and empty ones empty; a text of any length is read to its end; a text of which all
is removed becomes empty; equal rows (same doc_id and text) count as one and are treated alike; different texts of one
doc_id remove from each other in the order of their hashes, as do texts without a doc_id, which come first of all; a
run of words that overlaps its first place in the text is no copy of it; all other columns are passed on, whatever
their names (but those of the two counts, which are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.lineage import durable, written
from lumenlake.llm.bytewords import Batch, arrow_batches
from lumenlake.llm.common import frugal
from lumenlake.llm.lpf import window_minima

#: Least sentences and words of a run; words after which a sentence counts as long.
LEAST_SENTENCES, LEAST_WORDS, LONG = 2, 16, 30
#: Words of a run that is picked by its hash, starts in a row of which one is picked.
GRAM, PICK = 25, 25
#: Bits, as powers of two, of the filters of runs that recur and of documents of which something is cut.
RUN_BITS, BITS = 27, 26
_LOWEST = -(1 << 63)


class Sentences:
    """The sentences of a batch: first word, word after the last, text, first byte, byte after the last."""

    def __init__(self, batch: Batch):
        data, n = batch.data, len(batch.word)
        self.batch = batch
        if not n:
            self.first = self.last = self.text = self.start = self.end = np.zeros(0, np.int64)
            return
        following = np.empty(len(data), np.uint8)
        following[:-1], following[-1] = data[1:], 32
        ends = batch.at[1:][np.diff(batch.at) > 0]
        following[ends - 1] = 32
        stop = ((data == 46) | (data == 33) | (data == 63)) & (following <= 32) | (data == 10)
        count = np.concatenate([[0], np.cumsum(stop)])
        opens = np.zeros(n, bool)  # the word opens a sentence
        opens[1:] = count[batch.start[1:]] > count[batch.end[:-1]]
        opens[batch.first[:-1][np.diff(batch.first) > 0]] = True
        at = np.flatnonzero(opens)
        size = np.diff(np.concatenate([at, [n]]))
        if (size > LONG).any():
            long = np.repeat(size > LONG, size)
            opens[1:] |= long[1:] & (batch.word[:-1] % np.uint64(4) == 0)
            at = np.flatnonzero(opens)
        self.first, self.last = at, np.concatenate([at[1:], [n]])
        self.text = np.searchsorted(batch.first, at, side="right") - 1
        opening = np.concatenate([[True], self.text[1:] != self.text[:-1]])
        closing = np.concatenate([opening[1:], [True]])
        self.start = np.where(opening, batch.at[self.text], batch.start[at])
        self.end = np.concatenate([self.start[1:], [0]])
        self.end[closing] = batch.at[self.text[closing] + 1]

    def runs(self, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the first sentence, of the last one, hash) of every run."""
        k = np.arange(len(self.first))
        to = np.maximum(np.searchsorted(self.last, self.first + least_words, "left"), k + least_sentences - 1)
        back = np.maximum(np.minimum(np.searchsorted(self.first, self.last - least_words, "right"), k - least_sentences + 2) - 1, -1)
        ok = to < len(k)
        reached = np.full(len(k), -1)
        reached[ok] = to[ok]
        only = (back >= 0) & (reached[back] != k)  # a run that is the shortest one from its first sentence is there already
        i, j = np.concatenate([k[ok], back[only]]), np.concatenate([to[ok], k[only]])
        ok = self.text[i] == self.text[j]
        i, j = i[ok], j[ok]
        return i, j, self.batch.runs(self.first[i], self.last[j])


def picked(batch: Batch, n: int, window: int = PICK) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs of n words whose hash is the least of some `window` starts in a row of a text."""
    k, h = batch.grams(n)
    if len(k) < window:
        return k[:0], h[:0]
    text = np.searchsorted(batch.first, k, side="right") - 1
    least = window_minima(h, window)
    least[text[: len(least)] != text[window - 1 :]] = 0  # starts of two texts
    edge = np.zeros(window - 1, np.uint64)
    chosen = ~window_minima(~np.concatenate([edge, least, edge]), window) == h
    return k[chosen], h[chosen]


def _runs(batch: Batch, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, hash, whether it is one of sentences) of the runs of a batch."""
    s, n = Sentences(batch), max(GRAM, least_words)
    i, j, h = s.runs(least_sentences, least_words)
    k, g = picked(batch, n)
    h = np.concatenate([h, g])
    return np.concatenate([s.first[i], k]), np.concatenate([s.last[j], k + n]), h, np.arange(len(h)) < len(i)


def _hashes(docs: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """The hash of every run."""

    @frugal
    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, batch in arrow_batches(part.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_runs(batch, least_sentences, least_words)[2].view(np.int64))], ["hash"])

    return docs.select("body").mapInArrow(hashes, "hash long")


def _spans(docs: DataFrame, least_sentences: int, least_words: int, wanted) -> DataFrame:
    """doc, mark, run (first word << 24 | words), its two hashes and whether the same text has it further up.

    wanted: a broadcast filter of hashes; others are left out.
    """

    @frugal
    def spans(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.int64)
        for part in parts:
            doc, mark = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, batch in arrow_batches(part.column(2)):
                start, end, h, sentences = _runs(batch, least_sentences, least_words)
                at = (h & np.uint64((1 << RUN_BITS) - 1)).astype(np.int64)
                known = (bits[at >> 6] >> (at & 63)) & 1 == 1
                start, end, h, sentences = start[known], end[known], h[known], sentences[known]
                text = np.searchsorted(batch.first, start, side="right") - 1
                order = np.lexsort((start, h, text))
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
                opening = end[order][np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))]  # the end of the run's first place
                again = np.ones(len(h), bool)
                again[order] = ~fresh & (sentences[order] | (start[order] >= opening))
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc[first + text], pa.int64()), pa.array(mark[first + text], pa.int64()), pa.array(((start - batch.first[text]) << 24) | (end - start), pa.int64()),
                    pa.array(h.view(np.int64)), pa.array(batch.checks(start, end).view(np.int64)), pa.array(again)], ["doc", "mark", "run", "hash", "check", "again"])

    return docs.mapInArrow(spans, "doc long, mark long, run long, hash long, check long, again boolean")


@frugal
def _cut(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, runs in columns:
        out = []
        for text, covered in zip(texts, runs, strict=True):
            if not isinstance(text, str) or covered is None or not len(covered):
                out.append((text, 0, 0))
                continue
            batch = Batch([text.encode()])
            covered = np.asarray(covered, np.int64)
            gone = np.zeros(len(batch.start) + 1, np.int64)
            np.add.at(gone, covered >> 24, 1)
            np.add.at(gone, (covered >> 24) + (covered & 0xFFFFFF), -1)
            gone = np.concatenate([[False], np.cumsum(gone[:-1]) > 0, [False]])
            raw = batch.data.tobytes()
            # A word goes with what follows it, the first one also with what comes before.
            place = np.concatenate([[0], batch.start[1:], [len(raw)]])
            opens, closes = place[np.flatnonzero(gone[1:] & ~gone[:-1])].tolist(), place[np.flatnonzero(gone[:-1] & ~gone[1:])].tolist()
            kept = b"".join(raw[a:b] for a, b in zip([0, *closes], [*opens, len(raw)], strict=True))
            out.append((kept.decode(), len(raw) - len(kept), len(opens)))
        yield pd.DataFrame(out, columns=["kept", "removed", "spans"])


def _filter(places: DataFrame, size: int):
    """A broadcast filter of 2**size bits, of which those numbered in the column `at` are set."""
    # At most 2**(size - 6) rows reach the driver.
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return places.sparkSession.sparkContext.broadcast(bits.tobytes())


def _passes(known, at: Column) -> Column:
    @F.pandas_udf("boolean")
    def passes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.frombuffer(known.value, np.int64)
        for part in parts:
            part = part.to_numpy()
            yield pd.Series((bits[part >> 6] >> (part & 63)) & 1 == 1)

    return passes(at)


def remove_repeated(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, removed: str = "__removed", spans: str = "__spans") -> DataFrame:
    """docs with the text cut, and `removed` (bytes) and `spans` (maximal runs of removed sentences)."""
    names = [c for c in docs.columns if c.lower() not in (removed.lower(), spans.lower())]
    body = F.col("text").cast("string")
    # The row is packed, so that no column's name can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(body).alias("mark"), body.alias("body"))
    texts = rows.select("doc", "mark", "body").where("body is not null")
    here = F.struct("doc", "mark")
    again = _hashes(texts, least_sentences, least_words).groupBy("hash").count().where("count > 1")
    wanted = _filter(again.select(F.col("hash").bitwiseAND(F.lit((1 << RUN_BITS) - 1)).alias("at")), RUN_BITS)
    # Written out, so that the join's two sides are both plain exchanges: only those can Spark split where a run is frequent.
    found = written(_spans(texts, least_sentences, least_words, wanted))
    first = durable(found.groupBy("hash", "check").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.max("again").alias("twice")).where("first < last or twice").select("hash", "check", "first"))
    later = durable(found.join(first, ["hash", "check"]).where((here > F.col("first")) | F.col("again")).groupBy("doc", "mark").agg(F.collect_set("run").alias("runs")))
    place = F.pmod(F.xxhash64("doc", "mark"), F.lit(1 << BITS))
    rows = rows.withColumn("some", _passes(_filter(later.select(place.alias("at")), BITS), place))
    cut = (rows.where("some").join(later, ["doc", "mark"], "left")
           .select("row", F.col("body").alias("kept"), F.when(F.col("runs").isNotNull(), F.pandas_udf(_cut, "kept string, removed long, spans long")("body", "runs")).alias("cut")))
    whole = rows.where("not some").select("row", F.col("body").alias("kept"), F.lit(None).cast("struct<kept: string, removed: bigint, spans: bigint>").alias("cut"))
    return whole.unionByName(cut).select(
        *(F.coalesce("cut.kept", "kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names),
        F.coalesce("cut.removed", F.lit(0)).cast("long").alias(removed), F.coalesce("cut.spans", F.lit(0)).cast("long").alias(spans))
