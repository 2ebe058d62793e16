"""Language identification by cross-parsing: how many phrases of a language's sample text make up a text."""

from __future__ import annotations

import functools
import math
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

#: Bounds of what is learned: documents and bytes a language; windows that a longer document gives, evenly spread over it.
TRAIN_DOCS, TRAIN_BYTES, WINDOWS = 64, 40_000, 5
#: Bytes of a text that are parsed beside others at once.
BLOCK = 512


@dataclass(frozen=True)
class Samples:
    """A sample text for each language, of lower-case letters and single blanks."""

    texts: tuple[tuple[str, str], ...]


def _clean(text: str) -> str:
    points = au.code_points(text.lower())
    return " ".join("".join(chr(p) if au.LETTER[p] else " " for p in points).split()) + " "


def learn(docs: DataFrame, learnable: Column) -> Samples:
    """Samples of the texts of learnable rows with a lang.

    For each language, TRAIN_DOCS hash slots each give the document of the smallest hash; a document gives all of its text, or
    WINDOWS windows of it, evenly spread, if it is longer than twice an equal part of TRAIN_BYTES.
    """
    h = F.xxhash64("doc_id")
    slots = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", h.alias("h"))
    picked = slots.groupBy("lang", F.pmod("h", F.lit(TRAIN_DOCS)).alias("slot")).agg(F.min_by("doc_id", "h").alias("doc_id")).collect()
    ids = sorted(r["doc_id"] for r in picked)
    if not ids:
        return Samples(())
    of = {lang: max(1, sum(r["lang"] == lang for r in picked)) for lang in {r["lang"] for r in picked}}
    part = F.create_map(*[F.lit(v) for lang, n in of.items() for v in (lang, max(2 * TRAIN_BYTES // n, 1000))])[F.col("lang")]
    n, size = F.length("text"), F.floor(part / WINDOWS).cast("int")
    windows = F.concat_ws(" ", *[F.substr("text", F.floor((n - size) * k / (WINDOWS - 1)).cast("int") + 1, size) for k in range(WINDOWS)])
    rows = docs.where(F.col("doc_id").isin(ids) & learnable & F.col("lang").isNotNull()).select("doc_id", "lang", F.when(n > part, windows).otherwise(F.col("text")).alias("text")).collect()
    texts: dict[str, str] = {}
    for lang in sorted(of):
        own = sorted((r["doc_id"], _clean(r["text"] or "")) for r in rows if r["lang"] == lang)
        texts[lang] = "".join(t for _, t in own)
    return Samples(tuple((k, v) for k, v in texts.items() if v.strip()))


class Parser:
    """A suffix automaton of the UTF-8 bytes of each sample; byte classes are its own (0: any byte that it lacks)."""

    def __init__(self, samples: Samples):
        self.langs = [k for k, _ in samples.texts]
        self.classes, self.tables, self.bits = [], [], []
        for _, text in samples.texts:
            data = np.frombuffer(text.encode(), np.uint8)
            own = np.unique(data)
            classes = np.zeros(256, np.int32)
            classes[own] = np.arange(1, len(own) + 1)
            self.classes.append(classes)
            self.tables.append(au.suffix_automaton(classes[data].tolist(), len(own) + 1, 0))
            self.bits.append(math.log2(max(len(data), 2)))

    def _phrases(self, lang: int, data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Phrases of each of n texts, whose blocks (of text `doc`, in order) begin at `begin`.

        Blocks are parsed side by side from the root, and then again from the state in which the one before
        ended, until no state changes: the phrases are those of whole texts.
        """
        codes, root = self.classes[lang][data], np.zeros(1, np.int64)
        state, ends = (x[0] for x in au.run(self.tables[lang], root, codes, begin, size))
        follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        entered = np.zeros(len(doc), np.int64)
        while len(follows):
            follows = follows[state[follows - 1] != entered[follows]]
            if not len(follows):
                break
            entered[follows] = state[follows - 1]
            after, ends[follows] = (x[0] for x in au.run(self.tables[lang], root, codes, begin[follows], size[follows], entered[follows][None]))
            moved = follows[after != state[follows]]
            state[follows] = after
            follows = moved[(moved + 1 < len(doc)) & (doc[np.minimum(moved + 1, len(doc) - 1)] == doc[moved])] + 1
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        return np.bincount(doc, weights=ends + (last & (state != 0)), minlength=n)

    def costs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits a byte for each text (in lower case) and language, and the letters of each text."""
        points = [au.code_points(t) for t in texts.to_pylist()]
        of = np.repeat(np.arange(len(points)), [len(p) for p in points])
        codes = np.concatenate(points) if len(points) else np.zeros(0, np.uint32)
        letter = au.LETTER[codes]
        letters = np.bincount(of[letter], minlength=len(points))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one blank after each run of letters
        codes, of = np.where(letter, codes, 32)[keep].astype("<u4"), of[keep]
        wide = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        data = np.frombuffer(codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        size = np.bincount(of, weights=wide, minlength=len(points)).astype(np.int64)
        blocks = -(-size // BLOCK)
        doc = np.repeat(np.arange(len(points)), blocks)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(size) - size)[doc] + k * BLOCK
        length = np.minimum(size[doc] - k * BLOCK, BLOCK)
        phrases = np.stack([self._phrases(lang, data, begin, length, doc, len(points)) for lang in range(len(self.langs))], 1)
        return phrases * np.array(self.bits) / np.maximum(size, 1)[:, None], letters


@functools.lru_cache(maxsize=1)
def _parser(samples: Samples) -> Parser:
    return Parser(samples)


def identify(docs: DataFrame, samples: Samples) -> DataFrame:
    """docs' columns other than text, with lang_pred and score, one row for each row of docs.

    The phrases of a text are the longest matches, one after the other, with a language's sample
    over the whole text; phrases times the bits of a position in the sample, a byte, is its
    cost, and the cheapest language wins (the first of equals). A language's sample has about TRAIN_BYTES to twice that.
    score = second cost / (first + second), 1 if only one language was learned. A text that is null or
    has no letter, and any text if nothing was learned, is `und` with score 0.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(samples)
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(known.value) if known.value.texts else None
        for batch in batches:
            pred, score = ["und"] * len(batch), np.zeros(len(batch))
            for first, some in tv.slices(pc.utf8_lower(tv.strings(batch.column("text"))), 1 << 22) if parser else ():
                cost, letters = parser.costs(some)
                best = cost.argmin(1)
                ranked = np.sort(cost, 1)
                sure = ranked[:, 1] / np.maximum(ranked[:, 0] + ranked[:, 1], 1e-12) if cost.shape[1] > 1 else np.ones(len(cost))
                for i in np.flatnonzero(letters):
                    pred[first + i], score[first + i] = parser.langs[best[i]], sure[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(pred), pa.array(score)], [*others, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*others, "text").mapInArrow(parse, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "lang_pred string", "score double"]))
