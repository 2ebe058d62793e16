"""Toxicity scores: a lexicon trie met with Levenshtein automata, and the context of each hit.

Lexicon and weights are learned from labelled documents. A term is a word, or an open stem, that
toxic documents hold far more often than others do.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automata as au
from . import textvec as tv
from .common import small_batches

#: Labelled documents of each class that are learned from, those of the smallest hashes, and terms that share an automaton.
TRAIN_DOCS, TERMS_TOGETHER = 1200, 120
#: Chance, over all prefixes, that a term is taken which toxic documents don't hold more often than others.
CHANCE = 0.05
#: Words on each side of a hit that make its context.
WINDOW = 8
QUOTES = "\"“”„«»‹›‘’`"
#: Words that report speech or name a word as a word.
REPORT = frozenset("said says wrote writes called quote quoted quotes quoting term word phrase insult slur dijo escribió palabra sagte schrieb wort dit écrit mot".split())
#: Words that address a person.
ADDRESS = frozenset("you your youre u ur du dich dein ihr tu te toi votre vous usted tú".split())
FEATURES = 12
_TRIM = re.compile(r"^\W+|\W+$")


def edits(term: str) -> int:
    """Most errors for a misspelling of a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, bool], ...]
    weights: tuple[float, ...]


def lexicon(docs: list[tuple[str, int]]) -> tuple[tuple[str, bool], ...]:
    """(term, open) pairs from (text, label) pairs.

    Words are kept in a trie with the toxic and other documents below each prefix. The shallowest
    prefixes that hardly any other document has, and enough toxic ones do (so many that chance would hardly
    give one such term, see CHANCE), are drawn out as far as all their words agree: to a word, or to an
    open stem of several. All terms found are kept.
    """
    bags = [({w for w in (_TRIM.sub("", x) for x in t.lower().split()) if w}, y) for t, y in docs]
    toxic = sum(y for _, y in bags)
    if not toxic or toxic == len(bags):
        return ()
    # documents of a term that none but toxic ones have by chance alone, among as many terms as there are
    kinds = len(set().union(*(bag for bag, _ in bags)))
    need = max(4, math.ceil(math.log(max(kinds, 1) / CHANCE) / math.log(len(bags) / toxic)))
    count: dict[str, list[int]] = {}
    below: dict[str, set[str]] = defaultdict(set)
    live = [(bag, y) for bag, y in bags]
    k = 0
    while any(bag for bag, _ in live):  # one letter more at a time, and only below prefixes that enough toxic documents have
        k += 1
        level: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for bag, y in live:
            for p in {w[:k] for w in bag}:
                level[p][y] += 1
        count |= level
        live = [({w for w in bag if len(w) > k and level[w[:k]][1] >= need}, y) for bag, y in live]
    pure = {p for p, (a, b) in count.items() if len(p) >= 3 and b >= need and a * toxic * 25 <= b * (len(bags) - toxic)}
    top = {p for p in pure if p[:-1] not in pure}
    for bag, y in bags:
        if y:
            for w in bag:
                for k in range(3, len(w) + 1):
                    if w[:k] not in count:
                        break
                    if w[:k] in top:
                        below[w[:k]].add(w)
    found = []
    for p in top:
        words = sorted(below[p], key=lambda w: (-count.get(w, (0, 0))[1], w))
        if count.get(words[0], (0, 0))[1] * 5 >= count[p][1] * 4:
            found.append((count[words[0]][1], words[0], False))
            continue
        common = [w for w in words if count.get(w, (0, 0))[1] * 50 >= count[p][1]]
        core = common or words
        stem = core[0]
        for w in core:
            while not w.startswith(stem):
                stem = stem[:-1]
        found.append((count[p][1], stem, len(words) > max(3, len(common)) or stem not in below[p]))
    found = [f for f in found if f[0] >= need]
    found.sort(key=lambda x: (-x[0], x[1]))
    return tuple((stem, is_open) for _, stem, is_open in found)


class Scorer:
    def __init__(self, terms: tuple[tuple[str, bool], ...], weights: tuple[float, ...] = ()):
        self.terms, self.weights = terms, np.array(weights)
        letters = sorted({ch for term, _ in terms for ch in term})
        classes = {ch: k + 1 for k, ch in enumerate(letters)}
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(ch) for ch in letters]] = range(1, len(letters) + 1)
        # terms that are next to each other share an automaton; a word runs through all of them at once
        order = sorted(range(len(terms)), key=lambda k: terms[k])
        tables, outcomes, starts, base = [], [], [], 0
        for a in range(0, len(order), TERMS_TOGETHER):
            some = order[a : a + TERMS_TOGETHER]
            table, outcome = au.fuzzy_lexicon([terms[k] for k in some], edits, classes)
            tables.append(table + base)
            outcomes.append(np.where(outcome >= 0, 4 * np.array(some)[outcome >> 2] + (outcome & 3), -1))
            starts.append(base)
            base += len(table)
        self.table, self.outcome, self.starts = np.concatenate(tables), np.concatenate(outcomes), np.array(starts)

    def outcomes(self, words: list[str]) -> np.ndarray:
        """4 * term + errors of the closest term of each word (the first of equals), or -1."""
        size = np.array([len(w) for w in words], np.int64)
        codes = self.class_of[au.code_points("".join(words))]
        state, _ = au.run(self.table, self.starts, codes, np.cumsum(size) - size, size)
        got = self.outcome[state]
        rank = np.where(got >= 0, (got & 3) * (len(self.terms) + 1) + (got >> 2), 1 << 40)
        return np.take_along_axis(got, rank.argmin(0)[None], 0)[0]

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Documents with hits, and their features; all others have zeros."""
        docs, rows = [], []
        for first, some in tv.slices(pc.utf8_lower(texts)):
            data, at = tv.raw(some)
            begin, end, of = tv.words(data, at)
            _, one, inverse = np.unique(tv.span_hashes(data, begin, end), return_index=True, return_inverse=True)
            raw = data.tobytes()
            word = lambda i: raw[begin[i] : end[i]].decode()
            got = self.outcomes([_TRIM.sub("", word(i)) for i in one.tolist()])[inverse] if len(one) else np.zeros(0, np.int64)
            hits = np.flatnonzero(got >= 0)
            own = np.searchsorted(of, hits, "right") - 1
            for d in np.unique(own):
                mine = hits[own == d] if len(hits) < 1000 else hits[np.searchsorted(own, d) : np.searchsorted(own, d, "right")]
                docs.append(first + int(d))
                rows.append(self._context(mine, got, word, int(of[d]), int(of[d + 1])))
        return np.array(docs, np.int64), np.array(rows).reshape(-1, FEATURES)

    def _context(self, hits: np.ndarray, got: np.ndarray, word, low: int, high: int) -> list[float]:
        by_errors, opened, quoted, reported, addressed, crowded = [0, 0, 0], 0, 0, 0, 0, 0
        near = np.diff(hits) <= WINDOW
        for i in hits.tolist():
            own = word(i)
            exact = _TRIM.sub("", own)
            by_errors[got[i] & 3] += 1
            opened += self.terms[got[i] >> 2][1]
            around = [word(j) for j in range(max(low, i - WINDOW), min(high, i + WINDOW + 1)) if j != i]
            before = "".join(word(j) for j in range(max(low, i - WINDOW), i)) + own[: own.find(exact)]
            after = own[own.find(exact) + len(exact) :] + "".join(word(j) for j in range(i + 1, min(high, i + WINDOW + 1)))
            quoted += any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            plain = {_TRIM.sub("", w) for w in around}
            reported += bool(plain & REPORT)
            addressed += bool(plain & ADDRESS)
        crowded = int(near.sum())
        n, kinds = len(hits), len({int(x) >> 2 for x in got[hits]})
        share = n / (high - low)
        return [1.0, *np.log1p(by_errors), np.log1p(opened), np.log1p(kinds), min(1.0, 20 * share), quoted / n, reported / n, addressed / n, np.log1p(crowded), float(n - opened > 0)]

    def scores(self, docs: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.weights[0])
        z[docs] += rows @ self.weights[1:]
        return 1 / (1 + np.exp(-z))


def _logistic(x: np.ndarray, y: np.ndarray, sample: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights by Newton's method with a ridge; the first column is the constant and isn't held back."""
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x.T * (sample * p * (1 - p))) @ x + np.diag(hold), x.T @ (sample * (y - p)) - hold * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(pairs: list[tuple[str, int]], share: float) -> Model:
    """Lexicon and weights from (text, label) pairs; share: of label 1 among all labelled documents."""
    ones = sum(y for _, y in pairs)
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if 0 < share < 1 else (-6.0 if share <= 0 else 6.0)
    terms = lexicon(pairs)
    if not terms:
        return Model((), (base, *[0.0] * FEATURES))
    scorer = Scorer(terms)
    docs, rows = scorer.features(tv.strings(pa.array([t for t, _ in pairs])))
    x = np.zeros((len(pairs), FEATURES + 1))
    x[:, 0] = 1
    x[docs, 1:] = rows
    y = np.array([y for _, y in pairs], float)
    sample = np.where(y == 1, share * len(y) / max(ones, 1), (1 - share) * len(y) / max(len(y) - ones, 1))
    return Model(terms, tuple(_logistic(x, y, sample).tolist()))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column) -> Model:
    """A model from the labels (doc_id, toxic) of learnable rows; TRAIN_DOCS documents of each class, all labels counted."""
    own = labels.where(learnable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked: dict[int, int] = {}
    for y in total:
        picked |= {r["doc_id"]: y for r in own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).collect()}
    if not picked:
        return Model((), (-6.0, *[0.0] * FEATURES))
    texts = docs.where(F.col("doc_id").isin(list(picked))).select("doc_id", "text").collect()
    pairs = sorted((r["doc_id"], r["text"] or "", picked[r["doc_id"]]) for r in texts)
    return fit([(t, y) for _, t, y in pairs], total.get(1, 0) / sum(total.values()))


@functools.lru_cache(maxsize=1)
def _scorer(model: Model) -> Scorer:
    return Scorer(model.terms, model.weights)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs' columns other than text, with score, predicted and n_hits, one row for each row of docs.

    A word counts as a term with up to edits(term) errors, of insertion, deletion or exchange; the trimmed lower-case word is
    compared, whole texts always. Null and empty texts, and all texts if no term was learned, get
    the score of a text without a hit.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("text", "score", "predicted", "n_hits")]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            if model.terms:
                scorer = _scorer(model)
                at, rows = scorer.features(tv.strings(batch.column("text")))
                s = scorer.scores(at, rows, len(batch))
            else:
                at, rows, s = np.zeros(0, np.int64), np.zeros((0, FEATURES)), np.full(len(batch), 1 / (1 + np.exp(-model.weights[0])))
            hits = np.zeros(len(batch), np.int64)
            hits[at] = np.expm1(rows[:, 1:4]).sum(1).round()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(hits)], [*others, "score", "predicted", "n_hits"])

    kinds = dict(docs.dtypes)
    return docs.select(*others, "text").mapInArrow(rate, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "score double", "predicted int", "n_hits long"]))
