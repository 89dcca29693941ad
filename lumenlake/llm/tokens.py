"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over its bytes says so; equal passages of different documents thus fall into equal
chunks, and a worker encodes each chunk once.  Encoding chunk by chunk differs from encoding the whole text near the
cuts, so every join is repaired: what lies around a cut is encoded again together with the next word of the chunk on
either side, and the ids are compared: those words must come out with the ids that they have alone and inside of their
chunks.  Until they do the join is widened, by whole chunks in which no place to compare is found, and to the whole
text in the end.  A chunk's reusable inside begins and ends where the pretokenizer always parts: before a blank
between two visible characters (of a plain set), and before the punctuation that follows a letter of scripts without
blanks.  Merges never cross the pretokenizer's pieces, so ids that agree there agree for good.

That holds for byte-level BPE with the byte-level pretokenizer's pattern and without a normalizer, which the
tokenizer's file is checked for; under any other file texts are encoded as a whole.  So is a text that holds the text
of an added token, since added tokens are found before pretokenization.

Stretches of plain characters (ASCII and Latin-1, of which all Unicode versions say the same) are encoded and decoded
by the faster of two public libraries, from the same file's vocabulary, if its merges are ranked by their ids; all
others by the tokenizers library.  Their ids are the same.

The table of a task is emptied when it exceeds a fixed size; nothing is shuffled, and only the two libraries' objects
outlive a task, so a lost executor costs only its own tasks.

Defined cases: a null text counts as empty (0 tokens); a text of any length is encoded to its end; repeated rows give
repeated results; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import frugal

#: Mean, least and greatest bytes of a chunk, and bytes under the rolling hash.
MEAN, LEAST, MOST, WINDOW = 2048, 256, 16384, 24
#: Bytes of text, ids and decoded text that a worker keeps for reuse.
REUSE_BYTES = 48 << 20

_SYNC = re.compile(r"(?<=[!-~À-ÖØ-öø-ÿ])(?= [!-~À-ÖØ-öø-ÿ])|(?<=[ぁ-ゖァ-ヺ一-龥가-힣])(?=[、。，！？；：])")
#: Characters of plain stretches, and the pretokenizer's fixed pattern.
_PLAIN = re.compile(r"[\t\n\r -~¡-ÿ]*\Z")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def cuts(data: np.ndarray, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Where the bytes are cut, by their content alone: never within a character."""
    n = len(data)
    if n <= least:
        return []
    mixed = (data.astype(np.uint64) + 1) * np.uint64(_MULTIPLIER)
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    rolling = total[WINDOW:] - total[:-WINDOW]
    rolling = (rolling ^ (rolling >> np.uint64(31))) * np.uint64(_MULTIPLIER)
    found = np.flatnonzero((rolling >> np.uint64(40)) % np.uint64(mean) == 0) + WINDOW
    out, last = [], 0
    for at in [*found.tolist(), n]:
        while at - last > most:
            last = _whole(data, last + most)
            out.append(last)
        if at < n and at - last >= least and (whole := _whole(data, at)) < n:
            last = whole
            out.append(last)
    return out


def _whole(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def pieces(text: str, **sizes: int) -> list[tuple[bool, str]]:
    """(is it a chunk's reusable inside, text) in order; the others are the re-encoded joins."""
    raw = text.encode()
    ends = [*cuts(np.frombuffer(raw, np.uint8), **sizes), len(raw)]
    out, pending, start = [], "", 0
    for end in ends:
        chunk, start = raw[start:end].decode(), end
        first = _SYNC.search(chunk)
        last = _last(chunk) if first else -1
        if first is None or last <= first.start():
            pending += chunk  # no agreement inside this chunk: the join takes it whole
            continue
        out += [(False, pending + chunk[: first.start()]), (True, chunk[first.start() : last])]
        pending = chunk[last:]
    return [p for p in [*out, (False, pending)] if p[1]]


def parts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer's file is of the kind for which encodings agree at the places of _SYNC."""
    before, after, model = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}, spec.get("model") or {}
    return (model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and not spec.get("normalizer")
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and after.get("type") == "ByteLevel")


def ends(inside: str) -> tuple[str, str]:
    """The first and the last word of a chunk's inside."""
    first = _SYNC.search(inside, 1)
    if first is None:
        return inside, inside
    return inside[: first.start()], inside[_last(inside) :]


def _last(text: str) -> int:
    """The last place of _SYNC, sought from the end; -1 without any."""
    reach = 64
    while True:
        start = max(0, len(text) - reach)
        at = [m.start() for m in _SYNC.finditer(text, start)]
        if at or not start:
            return at[-1] if at else -1
        reach *= 8


@dataclass(frozen=True)
class Coded:
    """An encoded stretch: number of ids, ids as text, decoded text; of an inside also the ids of its first and last word,
    None if they are not what it begins and ends with."""

    n: int
    ids: bytes
    back: bytes
    first: list[int] | None = None
    last: list[int] | None = None
    words: tuple[str, str] = ("", "")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 characters stand for themselves,
    the others follow from U+0100 on in their order."""
    shown = [b for b in range(256) if 33 <= b < 127 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranked(spec: dict):
    """The faster library's encoder of the same vocabulary; None if the file's merges are not ranked by their ids."""
    import tiktoken

    vocab, letters = spec["model"]["vocab"], _bytes_of_letters()
    added = {t["content"] for t in spec.get("added_tokens", ())}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
    single = [vocab.get(c) for c in letters]
    if None in single or any(vocab.get(m) != len(letters) + k for k, m in enumerate(merged)) or set(single) != set(range(len(letters))) or len(vocab) != len(letters) + len(merged) + len(added & vocab.keys()):
        return None
    ranks = {bytes(letters[c] for c in t): vocab[t] for t in (*letters, *merged)}
    return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _libraries(spec: str) -> tuple:
    """(the tokenizer, whether encodings agree at the places of _SYNC, the faster encoder or None) of a file's text."""
    from tokenizers import Tokenizer

    tokenizer, parsed = Tokenizer.from_str(spec), json.loads(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    in_chunks = parts_at_blanks(parsed)
    return tokenizer, in_chunks, ranked(parsed) if in_chunks else None


class Codec:
    """A tokenizer with its reuse table."""

    def __init__(self, spec: str):
        self.tokenizer, self.in_chunks, self.fast = _libraries(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.digits = [str(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.known: dict[str, Coded] = {}
        self.held = 0
        #: Chunks encoded and taken from the table, joins encoded, texts that had to be encoded as a whole.
        self.encoded = self.reused = self.joins = self.whole = 0

    def _ids(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """The ids of texts, and whether they are plain ones."""
        plain = [self.fast is not None and _PLAIN.match(t) is not None and not any(a in t for a in self.added) for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [(self.fast.encode_ordinary(t) if p else next(rest).ids, p) for t, p in zip(texts, plain, strict=True)]

    def _coded(self, ids: list[tuple[list[int], bool]]) -> list[Coded]:
        rest = iter(self.tokenizer.decode_batch([i for i, p in ids if not p], skip_special_tokens=False))
        back = [self.fast.decode_bytes(i) if p else next(rest).encode() for i, p in ids]
        return [Coded(len(i), ",".join([self.digits[k] for k in i]).encode(), b) for (i, _), b in zip(ids, back, strict=True)]

    def _insides(self, texts: list[str]) -> dict[str, Coded]:
        words = [ends(t) for t in texts]
        ids, edge = self._ids(texts), [i for i, _ in self._ids([w for pair in words for w in pair])]
        out = {}
        for t, (i, _), w, first, last, c in zip(texts, ids, words, edge[::2], edge[1::2], self._coded(ids), strict=True):
            agrees = i[: len(first)] == first and i[len(i) - len(last) :] == last
            out[t] = replace(c, first=first if agrees else None, last=last if agrees else None, words=w)
        return out

    def run(self, texts: list[str], **sizes: int) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text) of each text."""
        plans = [pieces(t, **sizes) if self.in_chunks and not any(a in t for a in self.added) else [(False, t)] for t in texts]
        insides = list(dict.fromkeys(p for plan in plans for inside, p in plan if inside))
        new = self._insides([p for p in insides if p not in self.known])
        self.encoded += len(new)
        known = {p: new.get(p) or self.known[p] for p in insides}
        # The joins with a word of either neighbour.
        around: list[tuple[list[int], list[int]] | None] = []
        asked: list[str] = []
        for plan in plans:
            for k, (inside, p) in enumerate(plan):
                if inside:
                    continue
                left, right = known[plan[k - 1][1]] if k else None, known[plan[k + 1][1]] if k + 1 < len(plan) else None
                first, last = left.last if left else [], right.first if right else []
                around.append(None if first is None or last is None else (first, last))
                asked.append((left.words[1] if left else "") + p + (right.words[0] if right else ""))
        joined: list[tuple[list[int], bool] | None] = []
        for (ids, plain), side in zip(self._ids(asked), around, strict=True):
            before, after = side or ([], [])
            end = len(ids) - len(after)
            agrees = side is not None and end >= len(before) and ids[: len(before)] == before and ids[end:] == after
            joined.append((ids[len(before) : end], plain) if agrees else None)
        self.joins += len(joined)
        joins = iter(zip(joined, self._coded([i or ([], False) for i in joined]), strict=True))
        out: list[tuple[int, str, str] | None] = []
        for plan in plans:
            n, ids, back, agrees = 0, hashlib.sha256(), hashlib.sha256(), True
            for inside, p in plan:
                if inside:
                    got = known[p]
                    self.reused += p not in new
                else:
                    found, got = next(joins)
                    agrees = agrees and found is not None
                if n and got.n:
                    ids.update(b",")
                n += got.n
                ids.update(got.ids)
                back.update(got.back)
            out.append((n, ids.hexdigest(), back.hexdigest()) if agrees else None)
        if wide := [i for i, o in enumerate(out) if o is None]:
            self.whole += len(wide)
            for i, c in zip(wide, self._coded(self._ids([texts[i] for i in wide])), strict=True):
                out[i] = (c.n, hashlib.sha256(c.ids).hexdigest(), hashlib.sha256(c.back).hexdigest())
        if self.held > REUSE_BYTES:
            self.known, self.held = {}, 0
        for p, got in new.items():
            self.known[p] = got
            self.held += 2 * len(p) + len(got.ids) + len(got.back) + 1000
        return out


def _texts(column: pd.Series, most: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in lists of about `most` characters."""
    out, size = [], 0
    for t in column:
        out.append(t or "")
        size += len(out[-1])
        if size >= most:
            yield out
            out, size = [], 0
    yield out


def encode_documents(docs: DataFrame, spec_path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; columns of these names are replaced.

    The tokenizer's file (a megabyte or two) is read by the driver and goes to the workers with the function.
    """
    with open(spec_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    @frugal
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = Codec(spec.value)
        for column in batches:
            rows = [r for texts in _texts(column) for r in codec.run(texts)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = [c for c in docs.columns if c.lower() not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    # The row is packed, so that no column's name can clash.
    coded = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), encode(F.col("text").cast("string")).alias("coded"))
    return coded.select(*(F.col("row")[c].alias(c) for c in names), "coded.n_tokens", "coded.ids_sha256", "coded.decoded_sha256")
