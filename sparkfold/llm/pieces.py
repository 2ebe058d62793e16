"""SentencePiece encoding by batched searches in numpy, and decoding.

Texts are cut into units before each blank that doesn't follow one; no piece of the model may hold the
blank mark elsewhere than at its beginning, so units can be encoded one by one. Distinct units of equal length advance together: hashes of their
substrings probe the sorted hashes of the pieces. For a unigram model a Viterbi search keeps the maxima over
the lengths of the last piece with their back-pointers. A BPE model's segmentation isn't a
best path of its scores, so there each unit of a batch merges its best neighbours, one merge a step.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Longer units merge by a heap: a step of a batch copies all its symbols.
LONG_UNIT = 256
#: Code points of units that advance together; a step holds about ten arrays of 8 bytes for each.
TOGETHER = 250_000


@dataclass(frozen=True)
class PieceModel:
    """Pieces, scores and kinds of a model file; a dummy blank is put before each text if `prefix`."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    prefix: bool
    kind: int = UNIGRAM

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are can be used: no character map, no blank removal, blanks as prefixes")
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be used")
        return cls(tuple(p.piece for p in proto.pieces), tuple(p.score for p in proto.pieces), tuple(p.type for p in proto.pieces), spec.add_dummy_prefix, proto.trainer_spec.model_type)


class Segmenter:
    """Segmentations of units into pieces.

    Unigram: the best sum of scores; among equals the earliest begin of the last piece wins. BPE: the
    neighbours whose union has the best score merge first, the leftmost of equals. A character that is no piece costs UNKNOWN_PENALTY more than the worst piece and becomes its UTF-8
    byte pieces, or the unknown piece if the model has none. Units are known by 64-bit hashes; `most` bounds the ids remembered.
    """

    def __init__(self, model: PieceModel, most: int = 3_000_000):
        self.most, self.prefix, self.kind = most, model.prefix, model.kind
        kinds = np.array(model.kinds)
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        usable = [i for i in range(len(kinds)) if kinds[i] in (NORMAL, USER) and model.pieces[i]]
        if any(MARK in model.pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece holds the blank mark after another character")
        normal = [model.scores[i] for i in usable if kinds[i] == NORMAL]
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        scores = [len(model.pieces[i]) * max(normal, default=0.0) - 0.1 if kinds[i] == USER else model.scores[i] for i in usable]
        points = [np.frombuffer(model.pieces[i].encode("utf-32-le"), np.uint32) for i in usable]
        self.longest = max(map(len, points))
        keys = np.array([self._hash(p[None])[0, -1] for p in points])
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(usable, np.int32)[order], np.array(scores)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys & np.uint64((1 << 22) - 1)] = True
        self.bytes = np.full(256, -1, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.bytes[int(model.pieces[i][3:5], 16)] = i
        raw = [b"" if kinds[i] == CONTROL else " ⁇ ".encode() if kinds[i] == UNKNOWN else bytes([int(p[3:5], 16)]) if kinds[i] == BYTE else p.replace(MARK, " ").encode() for i, p in enumerate(model.pieces)]
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_at, self.raw = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(raw), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.size = np.zeros(1 << 16, np.int32), 0

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        """Hashes of all beginnings of each row."""
        up = tv._power("up", tv._BASE, points.shape[1])
        return np.cumsum(tv.mix(points.astype(np.uint64) + np.uint64(1)) * up, axis=1)

    def viterbi(self, points: np.ndarray) -> list[list[int]]:
        """Ids for rows of equally many code points."""
        rows, n = points.shape
        total = np.concatenate([np.zeros((rows, 1), np.uint64), self._hash(points)], 1)
        down = tv._power("down", tv._INVERSE, n + 1)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int32)
        low = np.uint64((1 << 22) - 1)
        for end in range(1, n + 1):
            for size in range(min(self.longest, end), 0, -1):
                h = (total[:, end] - total[:, end - size]) * down[end - size]
                r = np.flatnonzero(self.maybe[h & low])
                if len(r):
                    at = np.searchsorted(self.keys, h[r]).clip(0, len(self.keys) - 1)
                    hit = self.keys[at] == h[r]
                    r, at = r[hit], at[hit]
                    value = best[r, end - size] + self.scores[at]
                    up = value > best[r, end]
                    r, at, value = r[up], at[up], value[up]
                    best[r, end], back[r, end], piece[r, end] = value, end - size, self.ids[at]
                if size == 1:
                    value = best[:, end - 1] + self.unknown_score
                    r = np.flatnonzero(value > best[:, end])
                    single = (total[r, end] - total[r, end - 1]) * down[end - 1]
                    at = np.searchsorted(self.keys, single).clip(0, len(self.keys) - 1)
                    r = r[self.keys[at] != single]
                    best[r, end], back[r, end], piece[r, end] = value[r], end - 1, -1
        out: list[list[int]] = [[] for _ in range(rows)]
        at = np.full(rows, n)
        live = np.arange(rows)
        while len(live):
            for i, p, e in zip(live.tolist(), piece[live, at[live]].tolist(), at[live].tolist(), strict=True):
                if p >= 0:
                    out[i].append(p)
                else:
                    out[i] += self._fallback(int(points[i, e - 1]))[::-1]
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
        return [ids[::-1] for ids in out]

    def _piece(self, total: np.ndarray, down: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Position among the sorted pieces of points[begin:end] of each row, or -1."""
        h = (total[rows, end] - total[rows, begin]) * down[begin]
        at = np.searchsorted(self.keys, h).clip(0, len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def _fallback(self, point: int) -> list[int]:
        own = self.bytes[list(chr(point).encode())]
        return own.tolist() if (own >= 0).all() else [self.unknown]

    def merges(self, points: np.ndarray) -> list[list[int]]:
        """Ids for rows of equally many code points, by merges."""
        rows, n = points.shape
        total = np.concatenate([np.zeros((rows, 1), np.uint64), self._hash(points)], 1)
        down = tv._power("down", tv._INVERSE, n + 1)
        scores = np.append(self.scores, -np.inf)
        out: list[list[int]] = [[] for _ in range(rows)]

        def finish(some: np.ndarray, bounds: np.ndarray) -> None:
            width = bounds.shape[1] - 1
            r = np.repeat(some, width)
            at = self._piece(total, down, r, bounds[:, :-1].ravel(), bounds[:, 1:].ravel())
            ids = np.append(self.ids, -1)[at].reshape(-1, width)
            for i, own, b in zip(some.tolist(), ids.tolist(), bounds, strict=True):
                out[i] = own if -1 not in own else [x for k, p in enumerate(own) for x in ([p] if p >= 0 else self._fallback(int(points[i, b[k]])))]

        live = np.arange(rows)
        bounds = np.broadcast_to(np.arange(n + 1), (rows, n + 1)).copy()
        pair = np.stack([scores[self._piece(total, down, live, np.full(rows, k), np.full(rows, k + 2))] for k in range(n - 1)], 1) if n > 1 else np.zeros((rows, 0))
        while len(live):
            if pair.shape[1]:
                k = pair.argmax(1)
                more = pair[np.arange(len(live)), k] > -np.inf
            else:
                more = np.zeros(len(live), bool)
            if not more.all():
                finish(live[~more], bounds[~more])
                live, bounds, pair = live[more], bounds[more], pair[more]
                if not len(live):
                    break
                k = k[more]
            r = np.arange(len(live))
            keep = np.ones(bounds.shape, bool)
            keep[r, k + 1] = False
            bounds = bounds[keep].reshape(len(live), -1)
            keep = np.ones(pair.shape, bool)
            keep[r, k] = False
            pair = pair[keep].reshape(len(live), -1)
            for at in (k - 1, k):  # the pairs that the merged symbol now makes
                ok = np.flatnonzero((at >= 0) & (at < pair.shape[1]))
                pair[ok, at[ok]] = scores[self._piece(total, down, live[ok], bounds[ok, at[ok]], bounds[ok, at[ok] + 2])]
        return out

    def merge_long(self, unit: str) -> list[int]:
        """Ids of one long unit, by merges from a heap."""
        points = np.frombuffer(unit.encode("utf-32-le"), np.uint32)[None]
        n = points.shape[1]
        total = np.concatenate([np.zeros((1, 1), np.uint64), self._hash(points)], 1)
        down = tv._power("down", tv._INVERSE, n + 1)
        one = np.zeros(1, np.int64)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins here
        alive = [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and end[b] - a <= self.longest:
                at = int(self._piece(total, down, one, np.array([a]), np.array([end[b]]))[0])
                if at >= 0:
                    heapq.heappush(heap, (-self.scores[at], a, b, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if not (alive[a] and alive[b] and end[a] == b and end[b] == e):
                continue
            end[a], alive[b] = e, False
            if e < n:
                before[e] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out: list[int] = []
        a = 0
        while a < n:
            at = int(self._piece(total, down, one, np.array([a]), np.array([end[a]]))[0])
            out += [int(self.ids[at])] if at >= 0 else self._fallback(int(points[0, a]))
            a = end[a]
        return out

    def learn(self, keys: np.ndarray, units: list[str]) -> None:
        """Encodes units that aren't known, with their hashes in ascending order."""
        found: list[list[int]] = [[]] * len(units)
        by_size: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_size.setdefault(len(u), []).append(i)
        for size, own in by_size.items():
            if self.kind == BPE and size > LONG_UNIT:
                for i in own:
                    found[i] = self.merge_long(units[i])
                continue
            step = max(1, TOGETHER // size)
            for a in range(0, len(own), step):
                some = own[a : a + step]
                points = np.frombuffer("".join(units[i] for i in some).encode("utf-32-le"), np.uint32).reshape(-1, size)
                for i, ids in zip(some, (self.merges if self.kind == BPE else self.viterbi)(points), strict=True):
                    found[i] = ids
        n = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(n.sum()))
        while self.size + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, 0 * self.flat])
        self.flat[self.size : self.size + len(new)] = new
        at = np.searchsorted(self.known, keys)
        self.known, self.n = np.insert(self.known, at, keys), np.insert(self.n, at, n)
        self.begin = np.insert(self.begin, at, self.size + np.cumsum(n) - n)
        self.size += len(new)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pieces of the texts, and all their ids."""
        data, at = tv.raw(texts)
        blank = data == 32
        before = np.concatenate([[False], blank[:-1]])
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        begin = np.flatnonzero((blank & ~before) | edge[:-1])
        end = np.append(begin[1:], len(data))
        of = np.searchsorted(begin, at)
        head = np.zeros(len(begin), bool)
        head[of[:-1][np.diff(at) > 0]] = self.prefix  # units that begin a text: the dummy blank stands before them
        keys = tv.span_hashes(data, begin, end)
        keys[head] = tv.mix(keys[head])
        keys, one, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.size > self.most:
            self.reset()
        rows = np.searchsorted(self.known, keys)
        new = np.flatnonzero(self.known[rows.clip(0, len(self.known) - 1)] != keys) if len(self.known) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            first = one[new]
            units = [(" " if h else "") + raw[a:b].decode() for a, b, h in zip(begin[first].tolist(), end[first].tolist(), head[first].tolist(), strict=True)]
            self.learn(keys[new], [u.replace(" ", MARK) for u in units])
            rows = np.searchsorted(self.known, keys)
        rows = rows[inverse]
        n = self.n[rows].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        return np.diff(ends[of]), self.flat[np.repeat(self.begin[rows] - ends[:-1], n) + np.arange(ends[-1])]

    def decode(self, n: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of runs of n ids; bytes that aren't UTF-8 become replacement characters."""
        size = self.raw_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.raw_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[np.concatenate([[0], np.cumsum(n)])]
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text[:1] == " " else text)
        return out

    def same(self, n: np.ndarray, ids: np.ndarray, texts: pa.Array) -> list[bool]:
        """Whether each run of n ids gives its text back."""
        return [a == b for a, b in zip(self.decode(n, ids), texts.to_pylist(), strict=True)]


@functools.lru_cache(maxsize=2)
def segmenter(path: str) -> Segmenter:
    """One a worker process, so that tasks share what it remembers."""
    return Segmenter(PieceModel.load(path))


def encode(docs: DataFrame, model_path: str, column: str = "text", check: bool = False) -> DataFrame:
    """docs with `ids`, the pieces of the text, an array of ints (a null or empty text has none); rows stay as they are.

    With `check`, also `same`, whether the ids give the text back (a null one counts as empty), and `n_pieces`; the same worker
    tells, so that ids and texts don't go through a second one. Columns of docs with the names of new ones are replaced.
    """
    small_batches(docs.sparkSession)
    added = {"ids": "array<int>"} | ({"same": "boolean", "n_pieces": "int"} if check else {})
    others = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = segmenter(model_path)
        for batch in batches:
            for first, some in tv.slices(tv.strings(batch.column(column))):
                n, ids = search.encode(some)
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                new = [pa.ListArray.from_arrays(at, pa.array(ids))]
                if check:
                    new += [pa.array(search.same(n, ids, some)), pa.array(n.astype(np.int32))]
                part = batch.slice(first, len(some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *new], [*others, *added])

    kinds = dict(docs.dtypes)
    return docs.select(others).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), *(f"{c} {kind}" for c, kind in added.items())]))


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """coded (with ids) with `decoded`, the text of the ids; null ids count as none."""
    others = [c for c in coded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = segmenter(model_path)
        for batch in batches:
            lists = batch.column("ids")
            n = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            texts = search.decode(n, lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts)], [*others, "decoded"])

    kinds = dict(coded.dtypes)
    return coded.select(others).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "decoded string"]))


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, same for each row of docs: whole texts encoded, and decoded again from their ids.

    ids_crc32: of the ids as little-endian 32-bit integers; same: whether the decoded text equals the
    text (a null one counts as empty). A text that holds the blank mark itself gets a blank back.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = segmenter(model_path)
        for batch in batches:
            for first, some in tv.slices(tv.strings(batch.column("text"))):
                n, ids = search.encode(some)
                ends = np.concatenate([[0], np.cumsum(n)]).tolist()
                raw = memoryview(ids.astype("<i4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                same = pa.array(search.same(n, ids, some))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(some)), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), same], ["doc_id", "n_pieces", "ids_crc32", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, same boolean")
