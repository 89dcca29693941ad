"""Token counts by overlap resynchronisation.

A huge text is cut into chunks that overlap, each is encoded alone, and the encodings are spliced where they provably
agree with the encoding of the whole.  Two facts give the proof:

* The pretokenizer's matches depend on what follows their start alone (and look two characters ahead).  Where two
  encodings both part words at a place, and the left one saw a little beyond it, the right one goes on from there as
  the whole text's would.
* A sequence of BPE tokens is the encoding of its word exactly if every two neighbours are the encoding of what they
  spell together: the first merge across a border would also be made in the pair alone.  Where both encodings hold the
  same token at the same place, inside of one word that runs through the overlap, each neighbourhood of the spliced
  sequence occurs in one of the two.

Where an overlap has neither, it is widened, twice as far each time, in the end over the whole chunk and further ones.
A byte-level tokenizer's file (.json) has words; a piece model (.model) has none, so its splices rest on the second
fact.  Under a file of another kind, texts are encoded as a whole.

Texts up to `spread` bytes are spliced in the task where they lie.  Longer ones are cut into pieces of that size, which
overlap too and are dealt over all tasks; of a piece only its count and the tokens of its two overlaps go on, and the
pieces of a text are spliced by the same rule.  Equal long texts are counted once.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a text of any length is counted to its end; the text of
a special token is what the library makes of it by default; repeated rows give repeated results; an empty table gives
an empty one; other columns are handed on, but n_bytes, n_tokens and over_limit are replaced.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.lineage import written
from lumenlake.llm.common import frugal, text_bytes
from lumenlake.llm.tokens import _PLAIN, _bytes_of_letters, parts_at_blanks, ranked

#: Bytes of a chunk and of an overlap; bytes from which a text is dealt over tasks, in pieces with a wider overlap.
CHUNK, OVERLAP, SPREAD, PIECE_OVERLAP = 16384, 512, 1 << 20, 4096
#: Bytes of text that a worker encodes at once.
AT_ONCE = 1 << 19


@dataclass
class Stretch:
    """The encoding of a stretch of a text.

    Token i has ids[i] and the bytes places[i] to places[i+1] of the text; parts tells where words part.  Of a piece's
    edge, the arrays hold a run of its tokens only, and index is the number of the first of them.
    """

    start: int
    end: int
    ids: np.ndarray
    places: np.ndarray
    parts: np.ndarray
    first_word_end: int
    last_word_start: int
    n: int
    index: int = 0

    @classmethod
    def of(cls, start: int, ids: np.ndarray, places: np.ndarray, parts: np.ndarray) -> "Stretch":
        inner, before = np.flatnonzero(parts[1:]), np.flatnonzero(parts[:-1])
        end = int(places[-1])
        return cls(start, end, ids, places, parts, int(places[inner[0] + 1]) if len(inner) else end, int(places[before[-1]]) if len(before) else start, len(ids))

    def edge(self, low: int, high: int) -> "Stretch":
        """What it tells of the bytes from low to high."""
        a, b = int(np.searchsorted(self.places, low)), int(np.searchsorted(self.places, high, "right"))
        b = max(b, a + 1)
        return Stretch(self.start, self.end, self.ids[a : b - 1], self.places[a:b], self.parts[a:b], self.first_word_end, self.last_word_start, self.n, self.index + a)


def common(left: Stretch, right: Stretch, margin: int, least: int = 0) -> tuple[int, int] | None:
    """The numbers, in either, of the first token after a place where both provably agree with the whole; None without.

    least is the number of the left one's first token that is known to be the whole text's.
    """
    at, i, j = np.intersect1d(left.places, right.places, assume_unique=True, return_indices=True)
    known = i + left.index >= least
    at, i, j = at[known], i[known], j[known]
    fit = np.flatnonzero(left.parts[i] & right.parts[j] & (at <= left.end - margin) & (at >= right.start))
    if len(fit):
        return int(i[fit[0]]) + left.index, int(j[fit[0]]) + right.index
    if left.last_word_start > right.start or right.first_word_end < left.end or len(at) < 2:
        return None
    # One word runs through the whole overlap: a token of both, beyond what the right one put before its text, and not in
    # what may be the beginning of a special token that the left one has not seen whole.
    shared = np.flatnonzero((np.diff(i) == 1) & (np.diff(j) == 1) & (at[:-1] > right.start) & (at[1:] <= left.end - margin) & (left.ids[i[:-1]] == right.ids[j[:-1]]))
    return (int(i[shared[0] + 1]) + left.index, int(j[shared[0] + 1]) + right.index) if len(shared) else None


class Words:
    """A byte-level BPE with a pretokenizer, as the tokenizers library encodes it."""

    prefix = 0

    def __init__(self, spec: str, plain: bool):
        from tokenizers import Tokenizer

        self.library, parsed = Tokenizer.from_str(spec), json.loads(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        letters, size = _bytes_of_letters(), self.library.get_vocab_size(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = token.encode() if i in added else bytes(letters.get(c, 0) for c in token)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        by_words = parts_at_blanks(parsed)
        self.in_chunks = by_words and not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        self.margin = 16 + max((len(a.encode()) for a in self.added), default=0)
        self.fast, self.plain = ranked(parsed) if by_words else None, plain

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        # What all Unicode versions say the same of goes to the faster library.
        fast = [self.fast is not None and _PLAIN.match(t) is not None and (self.plain or not any(a in t for a in self.added)) for t in texts]
        rest = iter(self.library.encode_batch_fast([t for t, f in zip(texts, fast, strict=True) if not f], add_special_tokens=False))
        return [self.fast.encode_to_numpy(t, disallowed_special=()).astype(np.int32) if f else np.array(next(rest).ids, np.int32) for t, f in zip(texts, fast, strict=True)]

    def stretches(self, starts: list[int], texts: list[str]) -> list[Stretch]:
        out = []
        for start, e in zip(starts, self.library.encode_batch(texts, add_special_tokens=False), strict=True):
            ids, word = np.array(e.ids, np.int32), np.array(e.word_ids, np.int64)
            parts = np.ones(len(ids) + 1, bool)
            parts[1:-1] = np.diff(word) != 0
            out.append(Stretch.of(start, ids, start + np.concatenate([[0], np.cumsum(self.lengths[ids])]), parts))
        return out


class Pieces:
    """A BPE over whole texts, as the sentencepiece library encodes it; it puts a space before a text.

    Places count that space: a stretch's first byte is the one before its text.
    """

    prefix, margin = 1, 0

    def __init__(self, model: bytes, plain: bool):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        rule, trainer = spec.normalizer_spec, spec.trainer_spec
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace("▁", " ").encode() for p in spec.pieces]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.in_chunks = (trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix and rule.add_dummy_prefix and not rule.remove_extra_whitespaces
                          and not rule.precompiled_charsmap and not any(p.type == p.USER_DEFINED for p in spec.pieces))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(i, np.int32) for i in self.library.encode(texts, num_threads=1)] if texts else []

    def stretches(self, starts: list[int], texts: list[str]) -> list[Stretch]:
        out = []
        for start, ids in zip(starts, self.ids(texts), strict=True):
            out.append(Stretch.of(start, ids, start + np.concatenate([[0], np.cumsum(self.lengths[ids])]), np.zeros(len(ids) + 1, bool)))
        return out


@lru_cache(maxsize=2)
def coder(file: bytes, is_json: bool, plain: bool = False) -> "Words | Pieces":
    """The tokenizer of a file's bytes; plain: the texts of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(file.decode(), plain) if is_json else Pieces(file, plain)


def _whole(raw: bytes, at: int) -> int:
    """at, or the first place after it that is not inside a character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


class Resync:
    """Encodes huge texts chunk by chunk."""

    def __init__(self, tokenizer: "Words | Pieces", chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        #: Splices, overlaps that had to be widened, texts that had to be encoded as a whole.
        self.splices = self.widened = self.whole = 0

    def _encode(self, raw: bytes, spans: list[tuple[int, int]]) -> list[Stretch] | None:
        done: list[Stretch] = []
        a = 0
        while a < len(spans):
            b, size = a, 0
            while b < len(spans) and (b == a or size < AT_ONCE):
                size += spans[b][1] - spans[b][0]
                b += 1
            done += self.tokenizer.stretches([s for s, _ in spans[a:b]], [raw[s:e].decode() for s, e in spans[a:b]])
            a = b
        # A text whose tokens do not spell it has no places.
        return done if all(d.end == e + self.tokenizer.prefix for d, (_, e) in zip(done, spans, strict=True)) else None

    def stretch(self, raw: bytes) -> Stretch | None:
        """The encoding of a text, spliced from its chunks; None if it has to be encoded as a whole."""
        starts = [0]
        while starts[-1] + self.chunk + self.overlap < len(raw) and (at := _whole(raw, starts[-1] + self.chunk)) < len(raw):
            starts.append(at)
        ends = [*(_whole(raw, min(len(raw), s + self.overlap)) for s in starts[1:]), len(raw)]
        if not self.tokenizer.in_chunks or (done := self._encode(raw, list(zip(starts, ends, strict=True)))) is None:
            return None
        kept: list[tuple[Stretch, int, int]] = []
        left, low, k = done[0], 0, 1
        while k < len(starts):
            right, wide = done[k], self.overlap
            while (found := common(left, right, self.tokenizer.margin, low + 1 if low else 0)) is None:
                self.widened += 1
                wide *= 2
                if starts[k] + wide < (starts[k + 1] if k + 1 < len(starts) else len(raw)):
                    end = _whole(raw, starts[k] + wide)
                else:  # nothing is left of the right chunk: go on twice as far as before
                    reach = 2 * (starts[k] - left.start)
                    while k < len(starts) and starts[k] - left.start < reach:
                        k += 1
                    end, wide = (_whole(raw, min(len(raw), starts[k] + self.overlap)) if k < len(starts) else len(raw)), self.overlap
                again = self._encode(raw, [(left.start, end)])
                if again is None or not np.array_equal(again[0].ids[: low + 1], left.ids[: low + 1]):
                    return None  # what has been spliced before does not hold any more
                left = again[0]
                if k == len(starts):
                    break
                right = done[k]
            if k == len(starts):
                break
            self.splices += 1
            i, j = found
            kept.append((left, low, i))
            left, low, k = right, j, k + 1
        kept.append((left, low, left.n))
        ids, places, parts = (np.concatenate([getattr(s, name)[a:b] for s, a, b in kept]) for name in ("ids", "places", "parts"))
        return Stretch.of(0, ids, np.append(places, left.places[-1]), np.append(parts, left.parts[-1]))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of texts, each as the library gives them for the whole."""
        short: list[tuple[int, str]] = []
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                if (s := self.stretch(t.encode())) is not None:
                    out[i] = s.ids
                    continue
                self.whole += 1
            short.append((i, t))
        for (i, _), ids in zip(short, self.tokenizer.ids([t for _, t in short]), strict=True):
            out[i] = ids
        return iter(out)


def _texts(column: pd.Series) -> Iterator[list[str]]:
    """The texts in lists of about AT_ONCE characters."""
    out, size = [], 0
    for t in column:
        out.append(t or "")
        size += len(out[-1])
        if size >= AT_ONCE:
            yield out
            out, size = [], 0
    yield out


_EDGE = "struct<start: long, end: long, first_word_end: long, last_word_start: long, n: long, index: long, ids: binary, places: binary, parts: binary>"
_SUMMARY = f"text_key string, piece long, sound boolean, total long, head {_EDGE}, tail {_EDGE}"


def _packed(s: Stretch) -> dict:
    numbers = {k: getattr(s, k) for k in ("start", "end", "first_word_end", "last_word_start", "n", "index")}
    return numbers | {"ids": s.ids.astype(np.int32).tobytes(), "places": s.places.astype(np.int64).tobytes(), "parts": s.parts.tobytes()}


def _unpacked(d: dict) -> Stretch:
    return Stretch(d["start"], d["end"], np.frombuffer(d["ids"], np.int32), np.frombuffer(d["places"], np.int64), np.frombuffer(d["parts"], bool), d["first_word_end"], d["last_word_start"], d["n"], d["index"])


def _moved(s: Stretch, by: int) -> Stretch:
    return Stretch(s.start + by, s.end + by, s.ids, s.places + by, s.parts, s.first_word_end + by, s.last_word_start + by, s.n, s.index)


def spliced(pieces: list[tuple[Stretch, Stretch]], margin: int) -> int | None:
    """The tokens of a text, from the two edges of its pieces in order; None if a splice is not proven."""
    n, low = 0, 0
    for (_, tail), (head, _) in zip(pieces, pieces[1:], strict=False):
        if (found := common(tail, head, margin, low + 1 if low else 0)) is None:
            return None
        n += found[0] - low
        low = found[1]
    return n + pieces[-1][0].n - low


def _long_counts(long: DataFrame, file, is_json: bool, spread: int, overlap: int) -> DataFrame:
    """(text_key, n) of the texts of long(text_key, raw): pieces are counted in tasks of their own, then spliced."""
    spark = long.sparkSession
    texts = written(long.groupBy("text_key").agg(F.first("raw").alias("raw")))
    tasks = max(8, spark.sparkContext.defaultParallelism * 2)
    found: list[DataFrame] = []
    while not texts.isEmpty():
        wide = overlap

        def cut(parts: Iterator[pa.RecordBatch], wide: int = wide) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for key, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw, start, k = raw.as_py(), 0, 0
                    while start < len(raw) or not k:
                        stop = _whole(raw, min(len(raw), start + spread))
                        last = stop + wide >= len(raw)
                        end = len(raw) if last else _whole(raw, stop + wide)
                        yield pa.RecordBatch.from_pydict({"text_key": [key], "piece": [k], "at": [start], "last": [last], "raw": [raw[start:end]]})
                        if last:
                            break
                        start, k = stop, k + 1

        @frugal
        def count(parts: Iterator[pd.DataFrame], wide: int = wide) -> Iterator[pd.DataFrame]:
            resync = Resync(coder(file.value, is_json))
            for part in parts:
                rows = []
                for r in part.itertuples():
                    s = resync.stretch(r.raw)
                    if s is None:
                        n = len(resync.tokenizer.ids([r.raw.decode()])[0]) if r.last and not r.piece else None
                        rows.append((r.text_key, r.piece, False, n, None, None))
                        continue
                    s = _moved(s, r.at)
                    head, tail = s.edge(s.start, s.start + wide + 64), s.edge(s.end - wide - 64, s.end)
                    rows.append((r.text_key, r.piece, True, s.n, _packed(head), _packed(tail)))
                yield pd.DataFrame(rows, columns=["text_key", "piece", "sound", "total", "head", "tail"]).astype({"total": "Int64"})

        def splice(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("piece")
            if len(pdf) == 1:  # in one piece: counted as a whole
                n = int(pdf.total.iloc[0])
            elif pdf.sound.all():
                n = spliced([(_unpacked(h), _unpacked(t)) for h, t in zip(pdf["head"], pdf["tail"], strict=True)], coder(file.value, is_json).margin)
            else:
                n = None
            return pd.DataFrame({"text_key": [pdf.text_key.iloc[0]], "n": pd.array([n], "Int64")})

        pieces = texts.mapInArrow(cut, "text_key string, piece long, at long, last boolean, raw binary").repartition(tasks, "text_key", "piece")
        counts = written(pieces.mapInPandas(count, _SUMMARY).groupBy("text_key").applyInPandas(splice, "text_key string, n long"))
        found.append(counts.where("n IS NOT NULL"))
        # Where an overlap was too narrow, the next round has pieces and overlaps that are wider, in the end one piece.
        texts = written(texts.join(counts.where("n IS NULL").select("text_key"), "text_key", "left_semi"))
        spread, overlap = 16 * spread, 16 * overlap
    if not found:
        return texts.select("text_key", F.lit(None).cast("long").alias("n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, piece_overlap: int = PIECE_OVERLAP) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more tokens than `limit`), by the tokenizer's file at `path`.

    The file (a megabyte or two) is read by the driver and goes to the workers with the function.
    """
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    is_json = path.endswith(".json")

    @F.pandas_udf("long")
    @frugal
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        resync = Resync(coder(file.value, is_json), chunk, overlap)
        for column in batches:
            yield pd.Series([len(i) for texts in _texts(column) for i in resync.ids(texts)], dtype="int64")

    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    # The row is packed, so that no column's name can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.octet_length(text_bytes(F.col("text"))).cast("long").alias("bytes"), F.col("text").cast("string").alias("body"))
    counted = rows.where(F.col("bytes") <= spread).withColumn("n", count("body")).select("row", "bytes", "n")
    long = rows.where(F.col("bytes") > spread).withColumn("text_key", F.sha2(text_bytes(F.col("body")), 256))
    if not long.isEmpty():
        totals = _long_counts(long.select("text_key", text_bytes(F.col("body")).alias("raw")), file, is_json, spread, piece_overlap)
        counted = counted.unionByName(long.join(totals, "text_key").select("row", "bytes", "n"))
    return counted.select(*(F.col("row")[c].alias(c) for c in names), F.col("bytes").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
