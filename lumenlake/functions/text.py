"""Query texts and the hash text encoder."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prompts of the prompt ensemble, and what known queries are expanded to, in this order.
PROMPTS = ("a photo of {}", "a photograph of {}", "an image showing {}", "a picture of {}", "a photo depicting {}")
EXPANSIONS = {
    "海边": ["a beach", "people at the beach", "a seaside landscape", "ocean and beach"],
    "beach": ["a beach", "a seaside landscape", "ocean and beach"],
    "火锅": ["hotpot dinner with friends", "people eating hotpot at night", "group dining in a restaurant"],
    "hotpot": ["hotpot dinner", "people eating hotpot", "a restaurant meal"],
    "旅行": ["a travel photo", "vacation", "a tourist attraction", "a trip landscape"],
    "travel": ["a travel photo", "vacation", "a tourist attraction", "a trip landscape"],
    "生日": ["a birthday party", "a birthday dinner", "people celebrating"],
    "birthday": ["a birthday party", "a birthday dinner", "people celebrating"],
    "狗": ["a dog", "a puppy", "a pet dog"],
    "dog": ["a dog", "a puppy", "a pet dog"],
    "猫": ["a cat", "a kitten", "a pet cat"],
    "cat": ["a cat", "a kitten", "a pet cat"],
    "小动物": ["a small animal", "a cute pet", "a cat or dog", "a small furry animal"],
    "small animals": ["a small animal", "a cute pet", "a cat or dog"],
    "食物": ["food", "a meal", "a plate of food", "fruit and food"],
    "美食": ["delicious food", "a restaurant meal", "a plate of food"],
    "food": ["food", "a meal", "a plate of food", "fruit and food"],
}
QUERY_STRATEGIES = ("raw_clip", "prompt_ensemble", "query_enhancement")
#: Dimensions of the hash encoder and slots per token.
DIM, SLOTS = 256, 12
_BLANKS = re.compile("[ \\t\\n\\x0b\\f\\r]+")


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def expand_query(query: Column) -> Column:
    """The texts a query is expanded to: itself, then its own entry, or those of all entries it contains, or prompts."""
    none = F.array().cast("array<string>")

    def expanded(both: Column) -> Column:
        q, low = both["q"], both["low"]
        exact = F.coalesce(*(F.when(low == k, _strings(v)) for k, v in EXPANSIONS.items()))
        inside = F.concat(*(F.when(F.contains(low, F.lit(k)), _strings(v)).otherwise(none) for k, v in EXPANSIONS.items()))
        words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
        plain = F.concat(F.array(q, F.concat(F.lit("a photo of "), q)), F.when(F.size(words) > 1, F.array(F.concat(F.lit("a photo showing "), F.array_join(words, " ")))).otherwise(none))
        return F.array_distinct(F.concat(F.array(q), F.when(exact.isNotNull(), exact).when(F.size(inside) > 0, inside).otherwise(plain)))

    # Bound to a name, so that a text is trimmed and lower-cased once and not for each entry.
    q = F.trim(query)
    return F.transform(F.array(F.struct(q.alias("q"), F.lower(q).alias("low"))), expanded)[0]


def query_texts(query: Column, strategy: str = "query_enhancement") -> Column:
    """The texts that stand for a query: itself, its expansions, or (any other strategy) the prompts around it."""
    q = F.trim(query)
    if strategy == "raw_clip":
        return F.array(q)
    if strategy == "query_enhancement":
        return expand_query(query)
    return F.array(*(F.concat(F.lit(p.split("{}")[0]), q, F.lit(p.split("{}")[1])) for p in PROMPTS))


def _tokens(text: str) -> list[str]:
    low = text.lower()
    return [t for t in _BLANKS.split(low.replace("_", " ").replace("-", " ")) if t] or [low]


def _slots(tokens: Iterable[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, signs) of every token, a row each: two bytes of its digest are a slot, the first one's parity the sign."""
    digests = b"".join(hashlib.sha256(t.encode()).digest()[: 2 * SLOTS] for t in tokens)
    pairs = np.frombuffer(digests, ">u2").reshape(-1, SLOTS).astype(np.int64)
    return pairs % dim, np.where(pairs >> 8 & 1, 1.0, -1.0)


class _Encoder:
    """Vectors of whole batches: a token is hashed once as long as it is known, and slots are added up for many texts at
    once.  What is known is forgotten when it grows beyond KNOWN tokens."""

    KNOWN, AT_ONCE = 1 << 17, 1 << 16

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}
        self.slots, self.signs = np.zeros((0, SLOTS), np.int32), np.zeros((0, SLOTS), np.int8)

    def _codes(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of every token, and of the text it is in."""
        if len(self.known) > self.KNOWN:
            self.__init__(self.dim)
        new = [t for t in dict.fromkeys(t for ts in tokens for t in ts) if t not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            slots, signs = _slots(new, self.dim)
            self.slots, self.signs = np.concatenate([self.slots, slots.astype(np.int32)]), np.concatenate([self.signs, signs.astype(np.int8)])
        codes = np.fromiter((c for ts in tokens for c in map(self.known.__getitem__, ts)), np.int64)
        return codes, np.repeat(np.arange(len(tokens)), [len(ts) for ts in tokens])

    def run(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The vector of every text, in order."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(_tokens(text))
            size += len(held[-1])
            if size >= self.AT_ONCE:
                yield from self._vectors(held)
                held, size = [], 0
        if held:
            yield from self._vectors(held)

    def _vectors(self, tokens: list[list[str]]) -> np.ndarray:
        codes, text = self._codes(tokens)
        at = (text[:, None] * self.dim + self.slots[codes]).ravel()
        v = np.bincount(at, self.signs[codes].ravel(), len(tokens) * self.dim).reshape(len(tokens), self.dim)
        n = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(n > 0, n, 1.0)


def hash_encode(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, embedding) of texts(id, text): signed hash slots of the tokens, at unit length; null texts are left out.

    A text without tokens is hashed as a whole.  One pass in Arrow batches, without a shuffle.
    """
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _Encoder(dim)
        for batch in batches:
            yield pd.Series(list(encoder.run(batch)), dtype=object)

    # Not called deterministic, or Spark would encode twice where it filters by what is in a vector.
    coded = F.pandas_udf(encode, "array<double>").asNondeterministic()
    return texts.where("text is not null").select("id", coded(F.col("text").cast("string")).alias("embedding"))


def hash_vector(text: str, dim: int = DIM) -> list[float]:
    """The same encoding of one text, on the driver."""
    return next(_Encoder(dim).run([text])).tolist()


def encode_query(texts: list[str], encode=hash_vector) -> list[float]:
    """The mean of the texts' vectors, at unit length."""
    vectors = [encode(t) for t in texts]
    mean = [sum(x) / len(vectors) for x in zip(*vectors, strict=True)]
    n = math.sqrt(sum(x * x for x in mean))
    return [x / n for x in mean] if n > 0 else mean
