"""Words, hashes and shingles of whole Arrow batches in numpy, without a Python step a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def strings(column: pa.Array) -> pa.Array:
    """Nulls as empty texts, one chunk, 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each one begins; one offset more than texts."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about `most` bytes, with the position of the first; a text is never cut."""
    _, at = raw(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text the number of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin, end = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:n]
    end[:-1] &= ~ink[1:] | edge[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(begin, at)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[begin:end] for each span: equal bytes, equal hash."""
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTES[data] * _power("up", _BASE, n), out=total[1:])
    part = (total[end] - total[begin]) * _power("down", _INVERSE, n + 1)[begin]
    return mix(part ^ (U(0xA0761D6478BD642F) * (end - begin).astype(U)))


_STEPS = mix(np.arange(1, 9, dtype=U)) | U(1)


def shingles(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(position of the text, sorted distinct hashes of its k-word shingles, A-Z lowered).

    A text of fewer words has its whole word sequence as one shingle; one without words has none.
    """
    for first, some in slices(texts):
        data, at = raw(some)
        data = LOWER[data]
        begin, end, of = words(data, at)
        w = span_hashes(data, begin, end)
        rolled = np.zeros(max(len(w) - k + 1, 0), U)
        for j in range(k):
            rolled += w[j : j + len(rolled)] * _STEPS[j]
        rolled = mix(rolled)
        for i in range(len(some)):
            a, b = of[i], of[i + 1]
            if b - a >= k:
                yield first + i, np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = (w[a:b] * _STEPS[: b - a]).sum(dtype=U)
                yield first + i, mix(np.array([short], U) ^ _BYTES[b - a : b - a + 1])
            else:
                yield first + i, np.zeros(0, U)
