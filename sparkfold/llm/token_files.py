"""Token-id files: patched frame-of-reference blocks, and the operator that writes and reads them.

A segment is a byte string that can be read alone::

    header   magic "PFR1", n_docs u32, n_tokens u64, local_start u64, n_blocks u32
    docs     doc_id i64, n_tokens u32 and whether doc_id is null u8 of each document, in order
    index    byte offset u32 of each block, and one more for the end of the last
    block    minimum u32, width u8, n_values u16, n_exceptions u16,
             values less the minimum, packed at that width (little-endian bits),
             exception positions u16, exception values u32

The width of a block is one of those that hold PERCENTILES of its values, the one that takes the
fewest bytes; values beyond it are in the exception list. Segments are rows of a Parquet table, so
that Spark's commit protocol covers lost executors and any store that Spark can write to will do.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, lookup_join, shared_folder, small_batches

BLOCK = 512
PERCENTILES = (90, 95, 98, 100)
SEGMENT_TOKENS = 1 << 20
HEAD = struct.Struct("<4sIQQI")
BLOCK_HEAD = struct.Struct("<IBHH")
#: Sentence marks, and what may stand before a run of them that is a pre-token of its own.
MARKS, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
MARKS[list(b".,;:!?|%$#&*")] = True
PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_DOCS = np.dtype("<i8,<u4,u1")
#: The steps before the model in those tokenizer files whose words can be coded apart.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
SEGMENTS = "part int, seq int, payload binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as rows of bytes, `width` bits a value."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view(np.uint8)
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(*values.shape, 4), axis=2, count=width, bitorder="little")
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """Inverse of _pack for rows of n values."""
    if width in (8, 16, 32):
        return packed.view(f"<u{width // 8}").astype(np.uint32)
    if not width:
        return np.zeros((len(packed), n), np.uint32)
    bits = np.unpackbits(packed, axis=1, count=n * width, bitorder="little").reshape(-1, width)
    whole = np.zeros((len(bits), 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(len(packed), n)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Patched frame-of-reference blocks of BLOCK ids; the last may be shorter."""
    whole = len(ids) // BLOCK
    out: list[bytes] = []
    for rows in (ids[: whole * BLOCK].reshape(-1, BLOCK), ids[whole * BLOCK :].reshape(1, -1)):
        if not rows.size:
            continue
        m, n = rows.shape
        low = rows.min(1)
        rest = (rows - low[:, None]).astype(np.uint32)
        fit = np.bincount((_widths(rest) + 33 * np.arange(m)[:, None]).ravel(), minlength=33 * m).reshape(m, 33).cumsum(1)  # values of at most so many bits
        widths = np.stack([(fit * 100 < n * p).sum(1) for p in PERCENTILES], 1)
        cost = (n * widths + 7) // 8 + 6 * (n - np.take_along_axis(fit, widths, 1))
        width = widths[np.arange(m), cost.argmin(1)]
        made: list[bytes] = [b""] * m
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            mask = np.uint32((1 << int(w)) - 1)
            packed = _pack(rest[own] & mask, int(w))
            for k, i in enumerate(own):
                odd = np.flatnonzero(rest[i] > mask) if fit[i, w] < n else low[:0]
                made[i] = b"".join((BLOCK_HEAD.pack(int(low[i]), int(w), n, len(odd)), packed[k].tobytes(), odd.astype("<u2").tobytes(), rest[i][odd].astype("<u4").tobytes()))
        out += made
    return out


def decode_blocks(payload: bytes, index: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at index[:-1] and end at index[-1]; blocks of one shape are unpacked together."""
    shapes: dict[tuple[int, int], list[int]] = {}
    heads = [BLOCK_HEAD.unpack_from(payload, p) for p in index[:-1]]
    for k, (_, w, n, _) in enumerate(heads):
        shapes.setdefault((w, n), []).append(k)
    parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(heads)
    data = np.frombuffer(payload, np.uint8)
    for (w, n), own in shapes.items():
        size = (n * w + 7) // 8
        rows = np.stack([data[index[k] + BLOCK_HEAD.size : index[k] + BLOCK_HEAD.size + size] for k in own])
        for k, row in zip(own, _unpack(rows, w, n), strict=True):
            low, _, _, odd = heads[k]
            if odd:
                p = index[k] + BLOCK_HEAD.size + size
                row[data[p : p + 2 * odd].view("<u2")] = data[p + 2 * odd : p + 6 * odd].copy().view("<u4")
            parts[k] = row + np.uint32(low)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_segment(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray, local_start: int) -> bytes:
    blocks = encode_blocks(ids)
    docs = np.zeros(len(doc_ids), _DOCS)
    docs["f0"], docs["f1"], docs["f2"] = doc_ids.fill_null(0).to_numpy(), lengths, doc_ids.is_null().to_numpy(zero_copy_only=False)
    first = HEAD.size + docs.nbytes + 4 * (len(blocks) + 1)
    index = np.cumsum([first, *map(len, blocks)]).astype("<u4")
    return b"".join((HEAD.pack(b"PFR1", len(docs), len(ids), local_start, len(blocks)), docs.tobytes(), index.tobytes(), *blocks))


def read_segment(payload: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """Document ids, token counts, all ids and the position of the first one in its part."""
    magic, n_docs, n_tokens, local_start, n_blocks = HEAD.unpack_from(payload)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    docs = np.frombuffer(payload, _DOCS, n_docs, HEAD.size)
    index = np.frombuffer(payload, "<u4", n_blocks + 1, HEAD.size + docs.nbytes).astype(np.int64)
    ids = decode_blocks(payload, index)
    if len(ids) != n_tokens:
        raise ValueError("a token segment is damaged")
    return pa.array(docs["f0"].astype(np.int64), mask=docs["f2"] == 1), docs["f1"].astype(np.int64), ids, local_start


class WordCoder:
    """Ids of words by a tokenizers file, each distinct piece of a word once.

    Exact for tokenizers that lower-case, split at blanks and drop them, which is read from the file; with any other file
    whole texts are encoded. A word's trailing run of
    sentence marks after a letter or digit is a pre-token of its own there, so the word is cut in
    two pieces there. Pieces are known by 64-bit hashes; `most` bounds those remembered, and beyond it
    the memory starts anew.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        split = (head.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        self.by_words = head.get("normalizer") == WORD_NORMALIZER and split[0] == WORD_SPLIT and all(t["content"].startswith("<|") for t in head.get("added_tokens") or [])
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.size = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Adds pieces that aren't known, with their hashes in ascending order."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter(itertools.chain.from_iterable(found), self.flat.dtype, int(n.sum()))
        while self.size + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, 0 * self.flat])
        self.flat[self.size : self.size + len(new)] = new
        at = np.searchsorted(self.keys, keys)
        self.keys, self.n = np.insert(self.keys, at, keys), np.insert(self.n, at, n)
        self.begin = np.insert(self.begin, at, self.size + np.cumsum(n) - n)
        self.size += len(new)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the texts and all their ids, the end id after each."""
        if not self.by_words:
            lists = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([len(x) for x in lists], np.int64), np.fromiter(itertools.chain.from_iterable(lists), np.uint32)
        cased, at = tv.raw(texts)
        data = tv.LOWER[cased]
        begin, end, of = tv.words(data, at)
        cut = end.copy()
        while len(more := np.flatnonzero((cut > begin) & MARKS[data[cut - 1]])):
            cut[more] -= 1
        cut[(cut == begin) | ~PLAIN[data[np.maximum(cut - 1, 0)]]] = -1
        for p in np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))):  # may be a special token, which keeps its case
            w = np.searchsorted(begin, p, "right") - 1
            data[begin[w] : end[w]], cut[w] = cased[begin[w] : end[w]], -1
        two = (cut >= 0) & (cut < end)
        first = np.arange(len(begin)) + np.cumsum(two) - two  # of each word among the pieces
        b, e = np.empty(len(begin) + two.sum(), np.int64), np.empty(len(begin) + two.sum(), np.int64)
        b[first], e[first] = begin, np.where(two, cut, end)
        b[first[two] + 1], e[first[two] + 1] = cut[two], end[two]
        of = np.append(first, len(b))[of]
        keys, one, inverse = np.unique(tv.span_hashes(data, b, e), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.reset()
        rows = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(rows == len(self.keys)) if not len(self.keys) else np.flatnonzero(self.keys[np.minimum(rows, len(self.keys) - 1)] != keys)
        if len(new):
            raw = data.tobytes()
            self.learn(keys[new], [raw[x:y].decode() for x, y in zip(b[one[new]].tolist(), e[one[new]].tolist(), strict=True)])
            rows = np.searchsorted(self.keys, keys)
        rows = rows[inverse]
        n = self.n[rows].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        doc_n = np.diff(ends[of]) + 1
        out = np.empty(int(doc_n.sum()), np.uint32)
        body = np.ones(len(out), bool)
        last = np.cumsum(doc_n) - 1
        body[last] = False
        out[body] = self.flat[np.repeat(self.begin[rows] - ends[:-1], n) + np.arange(ends[-1])]
        out[last] = end_id
        return doc_n, out


@functools.lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    """One a worker process, so that tasks share what it remembers."""
    return WordCoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encodes text of every row of docs and writes segments, in ascending doc_id order, to `path`.

    Each row is one document: repeated doc_ids stay apart (ordered by text), a null text is empty,
    a null doc_id sorts first and stays null. Documents are dealt by
    doc_id ranges, so part k holds smaller ids than part k + 1; a task streams its part and
    holds one segment of about SEGMENT_TOKENS ids at a time.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, some in tv.slices(tv.strings(batch.column("text")), 1 << 22):
                doc_n, ids = words.encode(some, end_id)
                ends = np.concatenate([[0], np.cumsum(doc_n)])
                i = 0
                while i < len(doc_n):
                    j = max(i + 1, int(np.searchsorted(ends, ends[i] + SEGMENT_TOKENS, "right")) - 1)
                    blob = write_segment(doc_ids.slice(first + i, j - i), doc_n[i:j], ids[ends[i] : ends[j]], start)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([blob], pa.binary())], ["part", "seq", "payload"])
                    start += int(ends[j] - ends[i])
                    seq, i = seq + 1, j

    ordered.mapInArrow(encode, SEGMENTS).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the written segments.

    Where a part begins is the sum over the parts before it: one number a part meets in one task.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, n, ids, start = read_segment(payload.as_py())
                ends = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), doc_ids, pa.array(start + ends[:-1]), pa.array(n), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = cut(segments.mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long"))
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return lookup_join(docs, cut(before), ["part"], F.col("start"), "inner").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the token files of docs (see write_tokens) and returns what reading them gives.

    An empty table gives no rows; a document without tokens has its end id alone. Without a path
    the files go to a new folder under the shared checkpoint folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if path is None:
        path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark.read.schema(SEGMENTS).parquet(path))
