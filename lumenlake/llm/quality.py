"""Quality scores from a byte-level convolutional network in numpy.

Learned filters of four bytes run over the whole text in overlapping chunks (each shares half of its bytes with the
next); every chunk is max-pooled per filter.  A document's features are the largest and the mean chunk response of
each filter; a small hidden layer combines them into one probability.  A filter's response is the sum of two looked-up
rows, one for each pair of its bytes, so scoring costs two table reads per byte.

Only text is an input.  The network is trained on the driver from at most `fit_rows` labelled rows (a documented
bound), each with its whole text, with a fixed seed; a few hundred kilobytes of weights go to the workers.  Scoring is
one pass without a shuffle and works through a long text block by block.

Defined cases: a null or empty text is scored as one chunk of blanks; without training rows of both labels every score
is 0.5; equal texts get equal scores, whatever batch or partition they are in; a text of any length is read to its end;
null labels are not learned from; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import frugal
from lumenlake.llm.toxicity import training_rows

#: Most labelled rows to learn from, and passes over them.
FIT_ROWS, EPOCHS = 2400, 14
#: Bytes of a block (a chunk is two neighbouring blocks), filters, hidden units.
BLOCK, FILTERS, HIDDEN = 256, 12, 16
#: Documents need this score to count as good.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Network:
    """Filters as (4, 256, FILTERS); then the two dense layers."""

    filters: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    trained: bool = True


def blocks(text: str | None) -> np.ndarray:
    """The bytes of a text in rows of BLOCK and three more that the last filter positions read; padded with blanks."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-len(raw) // BLOCK))
    padded = np.full(n * BLOCK + 3, 32, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, (n, BLOCK + 3), (BLOCK, 1))


def _tables(filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responses to the first and to the last two bytes of a filter's four."""
    pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
    return pair(filters[0], filters[1]), pair(filters[2], filters[3])


def _responses(rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    pairs = (rows[:, :-1].astype(np.uint16) << 8) | rows[:, 1:]
    out = tables[0].take(pairs[:, :BLOCK], axis=0)
    out += tables[1].take(pairs[:, 2 : BLOCK + 2], axis=0)
    return out


def _halves(top: np.ndarray) -> np.ndarray:
    """Chunk maxima from block maxima: chunk i is blocks i and i + 1."""
    return np.maximum(top[:-1], top[1:]) if len(top) > 1 else top


def _combine(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities of rows of pooled features.

    Summed feature by feature in double precision: a matrix product would round a row by its place in the batch.
    """
    hidden = np.broadcast_to(net.dense_bias.astype(np.float64), (len(x), len(net.dense_bias))).copy()
    for k, weights in enumerate(net.dense.astype(np.float64)):
        hidden += x[:, k, None].astype(np.float64) * weights
    z = np.full(len(x), float(net.out_bias))
    for k, weight in enumerate(net.out.tolist()):
        z += np.maximum(hidden[:, k], 0) * weight
    return np.array([1 / (1 + math.exp(-min(30.0, max(-30.0, v)))) for v in z.tolist()])


class Scorer:
    """Scores texts with a network, many blocks at a time."""

    #: Blocks whose responses are held at once.
    AT_ONCE = 512

    def __init__(self, net: Network):
        self.net, self.tables = net, _tables(net.filters)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.net.trained:
            return np.full(len(texts), 0.5)
        x = np.zeros((len(texts), 2 * FILTERS), np.float32)
        for first, group in self._groups(texts):
            rows = np.concatenate([blocks(t) for t in group])
            top = np.concatenate([_responses(rows[i : i + self.AT_ONCE], self.tables).max(axis=1) for i in range(0, len(rows), self.AT_ONCE)])
            at = 0
            for k, t in enumerate(group):
                n = max(1, -(-len((t or "").encode()) // BLOCK))
                chunk = np.maximum(_halves(top[at : at + n]), 0)
                x[first + k, :FILTERS], x[first + k, FILTERS:] = chunk.max(0), chunk.mean(0)
                at += n
        return _combine(self.net, x)

    @staticmethod
    def _groups(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= most or i + 1 == len(texts):
                yield first, texts[first : i + 1]
                first, size = i + 1, 0


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """A network trained by Adam on (text, label) rows."""
    rng = np.random.default_rng(seed)
    y = np.array([v for _, v in rows], np.float32)
    w = {"f": rng.normal(0, 0.3, (4, 256, FILTERS)).astype(np.float32), "d": rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32),
         "db": np.zeros(HIDDEN, np.float32), "o": rng.normal(0, 0.3, HIDDEN).astype(np.float32), "ob": np.zeros(1, np.float32)}
    if len(set(y.tolist())) < 2:
        return Network(w["f"], w["d"], w["db"], w["o"], 0.0, trained=False)
    docs = [blocks(t) for t, _ in rows]
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step, size = 0, 32
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(docs))
        for at in range(0, len(order), size):
            batch = order[at : at + size]
            grad = _gradients(w, [docs[i] for i in batch], y[batch])
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return Network(w["f"], w["d"], w["db"], w["o"], float(w["ob"][0]))


def _gradients(w: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    tables = _tables(w["f"])
    rows = np.concatenate(docs)
    where = np.concatenate([_responses(rows[i : i + 512], tables).argmax(axis=1) for i in range(0, len(rows), 512)])
    window = np.stack([np.take_along_axis(rows, where + k, axis=1) for k in range(4)])
    unit = np.arange(FILTERS)
    top = sum(w["f"][k][window[k], unit] for k in range(4))
    x, back, at = np.zeros((len(docs), 2 * FILTERS), np.float32), [], 0
    for i, d in enumerate(docs):
        t = top[at : at + len(d)]
        chosen = (t[:-1] < t[1:]) + np.arange(len(t) - 1)[:, None] if len(t) > 1 else np.zeros((1, FILTERS), np.int64)
        chunk = np.maximum(t[chosen, unit], 0)
        best = chunk.argmax(0)
        x[i, :FILTERS], x[i, FILTERS:] = chunk[best, unit], chunk.mean(0)
        back.append((at + chosen, best, chunk > 0))
        at += len(d)
    z = x @ w["d"] + w["db"]
    hidden = np.maximum(z, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ w["o"] + w["ob"][0], -30, 30)))
    err = (p - y) / len(y)
    dz = np.outer(err, w["o"]) * (z > 0)
    dx = dz @ w["d"].T
    dtop = np.zeros_like(top)
    for i, (chosen, best, alive) in enumerate(back):
        g = np.broadcast_to(dx[i, FILTERS:] / len(chosen), chosen.shape).copy()
        g[best, unit] += dx[i, :FILTERS]
        np.add.at(dtop, (chosen, unit), g * alive)
    df = np.zeros_like(w["f"])
    for k in range(4):
        np.add.at(df[k], (window[k], unit), dtop)
    return {"f": df, "d": x.T @ dz + 1e-4 * w["d"], "db": dz.sum(0), "o": hidden.T @ err + 1e-4 * w["o"], "ob": np.array([err.sum()], np.float32)}


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Network:
    return fit(training_rows(docs, labels, "quality", fit_rows))


def score_documents(docs: DataFrame, net: Network, into: str = "score") -> DataFrame:
    """docs with a double column `into` (replaced if there): the quality of the whole text, from 0 to 1."""

    @F.pandas_udf("double")
    @frugal
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for texts in batches:
            yield pd.Series(scorer.score(list(texts)), dtype="float64")

    return docs.withColumn(into, score(F.col("text").cast("string")))
