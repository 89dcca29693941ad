"""Toxicity scores from a lexicon trie intersected with Levenshtein automata.

The lexicon is learned from labelled documents: whole words, and stems that start a word, which are far commoner in
toxic than in other documents.  It is kept as a trie.  A term is matched by running the Levenshtein automaton of
"at most one edit" over the trie: a state is the set of (trie node, edits so far) pairs that the letters read so far
can reach, and states are built as they are met, so a term costs one step per letter.  A stem may have one edit
before its last letter.  Words and stems of four letters count with an edit too, but as a kind of match of their own,
whose weight is learned; shorter ones only match exactly.  Digits and signs that stand for letters count as those
letters, in texts and in learned terms; a sign at an end of a term is read as a letter and as none, and the surer match
counts.

Around each match a window of words is read: a match between quotation marks, one near a word of reporting and one
near a word of direct address are counted apart.  How much less quoted and reported matches weigh is learned with the
weights of a logistic model over the counts of the whole text, which gives the score.

Only text is an input.  The model is fitted on the driver from at most `fit_rows` labelled rows (a documented bound);
it is a few hundred terms and two dozen numbers, and goes to the workers with the function.  Scoring is one pass
without a shuffle.

Defined cases: a null or empty text has no match and gets the model's score for that; a text of any length is read to
its end, in time that grows with its length; without toxic or without other training rows every score is 0; equal
texts get equal scores; null labels are not learned from; a document counts once for each label that its label rows
give it, and texts that share a doc_id count each; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import frugal, held_out

#: Most labelled rows to learn from.
FIT_ROWS = 6000
#: Words on either side of a match that tell quotation from abuse.
CONTEXT = 6
#: Documents need this score to count as toxic.
THRESHOLD = 0.7

#: Signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_PLAIN = str.maketrans(LOOKALIKES)
#: Letters of a term that matches with an edit, and of one that does so as a kind of its own.
TOLERANT, SHORT = 5, 4
#: Words of reporting and of direct address.
REPORTING = frozenset("said says wrote writes quoted quote called claimed reported according dijo escribió citó sagte schrieb zitierte écrit cité disait".split())
ADDRESS = frozenset("you your yourself u ur tú usted eres du dich dir dein sie ihr tu toi vous ton".split())

#: Signs that look like letters are part of a term between its characters, and at its ends where they touch a letter.
_TERM = re.compile(r"(?:[@$]+(?=[^\W\d_]))?\w+(?:[@$]+\w+)*(?:(?<=[^\W\d_])[@$]+)?")
_QUOTE = re.compile("[\"“”„«»]")


def readings(term: str) -> tuple[str, ...]:
    """A term with the signs at its ends as letters, and without them: '$hit' is one, '@name' may be an address."""
    bare = term.strip("@$")
    return (term,) if bare == term or not bare else (term, bare)


class Lexicon:
    """A trie of words and stems with the lazily built automaton of at most one edit over it."""

    #: Built states are dropped beyond this number.
    MOST_STATES = 50_000

    def __init__(self, words: Iterable[str], stems: Iterable[str], short: bool = False):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[bool] = [False]
        self.stem: list[bool] = [False]
        #: The kind of match with one edit of a node's word or stem: 2, 4 if it is short, 0 for none.
        self.near_word: list[int] = [0]
        self.near_stem: list[int] = [0]
        kind = lambda term: 2 if len(term) >= TOLERANT else 4 if short and len(term) >= SHORT else 0
        for term in words:
            node = self._add(term)
            self.word[node], self.near_word[node] = True, kind(term)
        for term in stems:
            node = self._add(term)
            self.stem[node], self.near_stem[node] = True, kind(term)
        self._clear()

    def _add(self, term: str) -> int:
        node = 0
        for c in term.translate(_PLAIN):
            if c not in self.child[node]:
                self.child.append({})
                self.word.append(False)
                self.stem.append(False)
                self.near_word.append(0)
                self.near_stem.append(0)
                self.child[node][c] = len(self.child) - 1
            node = self.child[node][c]
        return node

    def _clear(self) -> None:
        self.ids: dict[tuple[frozenset, int], int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.passed: list[int] = []
        self.start = self._state(self._closure({(0, 0)}), 0)

    def _closure(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the trie letters that the term may lack."""
        return frozenset(pairs | {(n, 1) for node, edits in pairs if edits == 0 for n in self.child[node].values()})

    def _state(self, pairs: frozenset, passed: int) -> int:
        """`passed` is the kind of stem that has been completed with an edit by the letters so far."""
        if (pairs, passed) not in self.ids:
            self.ids[pairs, passed] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
            self.passed.append(passed)
            exact = any(self.word[n] for n, e in pairs if e == 0)
            near = {self.near_word[n] for n, e in pairs if e == 1 and self.word[n]}
            self.ends.append(1 if exact else min((near | {passed}) - {0}, default=0))
        return self.ids[pairs, passed]

    def _step(self, state: int, letter: str) -> int:
        """-1: no entry can match any more; -2: a stem is complete."""
        letter = LOOKALIKES.get(letter, letter)
        out, near = set(), {self.passed[state]}
        for node, edits in self.sets[state]:
            if letter in self.child[node]:
                to = self.child[node][letter]
                out.add((to, edits))
                if edits == 1:
                    near.add(self.near_stem[to])
            if edits == 0:
                out.add((node, 1))
                out.update((n, 1) for c, n in self.child[node].items() if c != letter)
        if any(e == 0 and self.stem[n] for n, e in out):
            return -2
        passed = min(near - {0}, default=0)
        return self._state(self._closure(out), passed) if out or passed else -1

    def match(self, term: str) -> int:
        """0: no match; 1: a word; 2: a word or starts with a stem, but for one edit; 3: starts with a stem; 4: as 2, by a short one."""
        if len(self.sets) > self.MOST_STATES:
            self._clear()
        state = self.start
        for letter in term:
            step = self.steps[state].get(letter)
            if step is None:
                step = self.steps[state][letter] = self._step(state, letter)
            if step == -1:
                return 0
            if step == -2:
                return 3
            state = step
        return self.ends[state]


#: Kinds of match, the surest first.
_SUREST = (1, 3, 2, 4, 0)
#: Kinds of match in the order of their features; contexts: neither quoted nor reported, quoted, reported, both.
KINDS, CONTEXTS = (1, 2, 3, 4), 4
#: What a quoted and what a reported match weigh until that is learned, and the weights that are tried.
DISCOUNTS, TRIED = (0.4, 0.5), (1.0, 0.7, 0.4, 0.2)


@dataclass(frozen=True)
class Counts:
    """What a text holds: its number of terms, per kind of match how many in each context and how many different
    terms, and how many near words of address in each context."""

    terms: int
    matches: tuple[tuple[int, ...], ...] = ((0,) * CONTEXTS,) * len(KINDS)
    distinct: tuple[int, ...] = (0,) * len(KINDS)
    addressed: tuple[int, ...] = (0,) * CONTEXTS

    def features(self, discounts: tuple[float, float] = DISCOUNTS) -> list[float]:
        quoted, reported = discounts
        worth = (1.0, quoted, reported, quoted * reported)
        out = []
        for found, different in zip(self.matches, self.distinct, strict=True):
            weight = sum(w * n for w, n in zip(worth, found, strict=True))
            out += [math.log1p(weight), math.log1p(different), 100 * weight / (self.terms + 20)]
        apart = [math.log1p(sum(found[k] for found in self.matches)) for k in range(1, CONTEXTS)]
        return [*out, math.log1p(self.terms), *apart, math.log1p(sum(w * n for w, n in zip(worth, self.addressed, strict=True)))]


class Scanner:
    """Counts of texts under a lexicon; remembers what it has found out about terms."""

    MOST_TERMS = 200_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.clean: set[str] = set()
        self.hits: dict[str, int] = {}

    def features(self, text: str | None, discounts: tuple[float, float] = DISCOUNTS) -> list[float]:
        return self.counts(text).features(discounts)

    def counts(self, text: str | None) -> Counts:
        # What is remembered is dropped between texts only, so a single text may hold any number of terms.
        if len(self.clean) > self.MOST_TERMS:
            self.clean = set()
        if len(self.hits) > self.MOST_TERMS:
            self.hits = {}
        low = (text or "").lower()
        terms = _TERM.findall(low)
        found = []
        for t in set(terms):
            if t in self.clean:
                continue
            if t not in self.hits:
                if not (kind := min(map(self.lexicon.match, readings(t)), key=_SUREST.index)):
                    self.clean.add(t)
                    continue
                self.hits[t] = kind
            found.append(t)
        if not found:
            return Counts(len(terms))
        matches, addressed = [[0] * CONTEXTS for _ in KINDS], [0] * CONTEXTS
        quotes = [m.start() for m in _QUOTE.finditer(low)]
        spans = [m.span() for m in _TERM.finditer(low)] if quotes else []
        wanted = set(found)
        for i, t in enumerate(terms):
            if t in wanted:
                around = terms[max(0, i - CONTEXT) : i + CONTEXT + 1]
                context = int(bool(quotes) and _between(quotes, spans, i)) + 2 * int(not REPORTING.isdisjoint(around))
                matches[self.hits[t] - 1][context] += 1
                addressed[context] += not ADDRESS.isdisjoint(around)
        kinds = Counter(self.hits[t] for t in found)
        return Counts(len(terms), tuple(map(tuple, matches)), tuple(kinds[k] for k in KINDS), tuple(addressed))


def _between(quotes: list[int], spans: list[tuple[int, int]], i: int) -> bool:
    """Whether the window around word i has one of the quotation marks (in order) on either side of the word."""
    first, last = spans[max(0, i - CONTEXT)][0], spans[min(len(spans) - 1, i + CONTEXT)][1]
    a, b = spans[i]
    return bisect_left(quotes, first - 2) < bisect_left(quotes, a) and bisect_left(quotes, b) < bisect_right(quotes, last + 2)


@dataclass(frozen=True)
class Model:
    """What scoring needs: the lexicon's terms, what quoted and reported matches weigh, and the logistic model."""

    words: tuple[str, ...]
    stems: tuple[str, ...]
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    discounts: tuple[float, float] = DISCOUNTS

    def score(self, features: list[list[float]]) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        # Row by row in one order: a matrix product would round a row by its place in the batch.
        out = []
        for row in features:
            z = self.weights[-1] + sum((x - m) / s * w for x, m, s, w in zip(row, self.mean, self.scale, self.weights, strict=False))
            out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
        return np.array(out)


def learn_lexicon(texts: list[str], toxic: list[int]) -> tuple[list[str], list[str]]:
    """(words, stems) that mark toxic documents, from how many documents have words and starts of words.

    Texts whose words share the least hash count as one document, or near copies would make their words look typical.
    """
    groups: dict[tuple[int, int], set[str]] = {}
    for text, y in zip(texts, toxic, strict=True):
        if words := {r.translate(_PLAIN) for t in _TERM.findall(text.lower()) for r in readings(t) if len(r) >= 3}:
            groups.setdefault((y, min(zlib.crc32(w.encode()) for w in words)), set()).update(words)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0, 0]
    for (y, _), words in groups.items():
        total[y] += 1
        seen[y].update({t[:k] for t in words for k in range(4, min(9, len(t)))} | {t + "$" for t in words})
    least = max(4, 0.004 * total[1])
    rate = lambda t: (seen[1][t] + 0.1) / (total[1] + 1) / ((seen[0][t] + 0.5) / (total[0] + 1))
    words = [t[:-1] for t, n in seen[1].items() if t[-1] == "$" and n >= least and rate(t) >= 30]
    starts = sorted((t for t, n in seen[1].items() if t[-1] != "$" and n >= 2 * least and rate(t) >= 15), key=len)
    stems: list[str] = []
    for t in starts:
        # A stem that only one word of the lexicon accounts for says no more than that word.
        own = max((seen[1][w + "$"] for w in words if w.startswith(t)), default=0)
        if own < 0.8 * seen[1][t] and not any(t.startswith(s) for s in stems):
            stems.append(t)
    return sorted(words), sorted(stems)  # words below a stem stay: they match with an edit anywhere


def fit(rows: list[tuple[str, int]]) -> Model:
    """The model of (text, toxic) rows."""
    texts, y = [t or "" for t, _ in rows], np.array([int(v) for _, v in rows])
    if len(set(y.tolist())) < 2:
        return Model((), ())
    # Each half is read with the lexicon of the other one, or else chance terms would get weight.
    half = np.arange(len(y)) % 2 == 0
    counts: list[Counts] = [Counts(0)] * len(y)
    for part in (half, ~half):
        scanner = Scanner(Lexicon(*learn_lexicon([t for t, h in zip(texts, part, strict=True) if h], y[part].tolist()), short=True))
        for i in np.flatnonzero(~part).tolist():
            counts[i] = scanner.counts(texts[i])
    words, stems = learn_lexicon(texts, y.tolist())

    def inputs(discounts: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.array([c.features(discounts) for c in counts])
        return x, x.mean(0), np.maximum(x.std(0), 0.25)  # a feature that hardly varies must not be stretched

    def loss(discounts: tuple[float, float]) -> float:
        """How badly weights from one half of the rows tell the labels of the other, both ways."""
        x, mean, scale = inputs(discounts)
        x, out = (x - mean) / scale, 0.0
        for part in (half, ~half):
            if len(set(y[part].tolist())) == 2:
                w = _logistic(x[part], y[part])
                z = np.clip((x[~part] @ w[:-1] + w[-1]) * np.where(y[~part] == 1, 1, -1), -30, 30)
                out += float(np.log1p(np.exp(-z)).sum())
        return round(out, 6)

    discounts = min([DISCOUNTS, *((q, r) for q in TRIED for r in TRIED)], key=loss)  # the first of equals
    x, mean, scale = inputs(discounts)
    return Model(tuple(words), tuple(stems), tuple(mean.tolist()), tuple(scale.tolist()), tuple(_logistic((x - mean) / scale, y).tolist()), discounts)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton's method with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w * (np.arange(len(w)) < len(w) - 1)
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[str, int]]:
    """At most `most` (text, label) rows outside the evaluation fold, chosen by a hash of doc_id.

    Labels are chosen among the texts that are there, by ids and hashes of texts only; texts follow for the chosen
    rows, one of each, so that neither repeated rows nor labels without a document change how many there are.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(~held_out(F.col("id")) & F.col("y").isin(0, 1) & F.col("id").isNotNull()).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t")).where("id is not null").withColumn("mark", F.xxhash64("t"))
    chosen = (texts.select("id", "mark").join(known, "id").distinct()
              .orderBy(F.crc32(F.concat(F.lit("fit:"), F.col("id").cast("string")).cast("binary")), "id", "y", "mark").limit(most)).collect()
    if not chosen:
        return []
    # Bounded by `most`, as is what comes back.
    wanted = docs.sparkSession.createDataFrame(list({(r.id, r.mark) for r in chosen}), texts.select("id", "mark").schema)
    found = texts.join(F.broadcast(wanted), ["id", "mark"]).groupBy("id", "mark").agg(F.first("t").alias("t")).collect()
    text = {(r.id, r.mark): r.t or "" for r in found}
    return [(text[r.id, r.mark], r.y) for r in sorted(chosen, key=lambda r: (r.id, r.y, text[r.id, r.mark]))]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    return fit(training_rows(docs, labels, "toxic", fit_rows))


def score_documents(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with a double column `into` (replaced if there): the toxicity of the whole text, from 0 to 1."""

    @F.pandas_udf("double")
    @frugal
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(Lexicon(model.words, model.stems, short=True))
        for texts in batches:
            yield pd.Series(model.score([scanner.features(t, model.discounts) for t in texts]) if len(texts) else [], dtype="float64")

    return docs.withColumn(into, score(F.col("text").cast("string")))
