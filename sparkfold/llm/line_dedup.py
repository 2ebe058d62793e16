"""Line deduplication by an edit-distance join of the lines of all documents.

Lines within TAU edits share a segment: a line of length l is cut into TAU + 1 segments, and a line that
is at most TAU longer has one of them at a place that the multi-match rule allows. Each distinct
line names the segments of every length it could meet; names that two lines share make a bucket, and
a bucket's lines are verified with a banded bit-parallel edit distance, many pairs at once. Lines that are too
short to be cut share one more name with all lines that they could be near.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import automata as au
from . import textvec as tv
from .common import BLANK, cut, lookup_join, small_batches

TAU = 2
#: The pipeline takes out near lines only if they are this long: two edits make another word of a shorter one. Equal ones always go.
REMOVED_CHARS = 20
#: Lines that a task holds before it names their segments, and lines of a bucket that are verified together.
FLUSH, BLOCK = 60_000, 1024
#: Pairs that are verified at once.
PAIRS = 1 << 16
#: The name that the shortest lines share.
SHORT = 0x53484F5254


def segments(n: np.ndarray, tau: int = TAU) -> list[tuple[np.ndarray, np.ndarray]]:
    """Begin and length of each of tau + 1 segments of lines of length n; the last ones are one longer where need be."""
    size, more = n // (tau + 1), n % (tau + 1)
    out, at = [], np.zeros_like(n)
    for i in range(tau + 1):
        own = size + (i >= tau + 1 - more)
        out.append((at, own))
        at = at + own
    return out


def probes(n: np.ndarray, tau: int = TAU) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, difference, begin, size): parts of lines of length n that may equal segment i of a line shorter by the difference.

    Shifts that only more than tau edits, or another segment's match, could make are left out; a
    line's own segments are those of difference 0 and no shift.
    """
    for d in range(tau + 1):
        for i, (at, size) in enumerate(segments(n - d, tau)):
            for shift in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                yield i, d, at + shift, size


def edit_within(codes: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, tau: int = TAU) -> np.ndarray:
    """Whether codes[a : a + na] and codes[b : b + nb] are within tau edits, pair by pair; all lengths above tau.

    Bit k of a vector stands for row column - tau + k of the distance matrix, 2 tau + 1 rows around the
    diagonal. The distance is followed down the band's lower edge to the last row, then along it.
    """
    swap = na > nb
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    na, nb = np.where(swap, nb, na), np.where(swap, na, nb)
    good = nb - na <= tau
    order = np.flatnonzero(good)
    order = order[np.argsort(-nb[order], kind="stable")]
    a, b, m, n = a[order], b[order], na[order], nb[order]  # rows: the shorter a; columns: b
    w = 2 * tau + 1
    full = (1 << w) - 1
    vp = np.full(len(order), full & ~((1 << tau) - 1), np.int64)
    vn = np.zeros(len(order), np.int64)
    dist = np.full(len(order), tau, np.int64)
    top = len(codes) - 1
    out = np.zeros(len(good), bool)
    for j in range(1, int(n.max(initial=0)) + 1):
        if j % 16 == 0:  # pairs whose band is above tau everywhere, and finished ones, go
            k = int(np.searchsorted(-n, -j, "right"))
            out[order[k:]] = dist[k:] <= tau
            value = dist[:k].copy()
            least = value.copy()
            for bit in range(w - 2, -1, -1):
                value += ((vn[:k] >> bit) & 1) - ((vp[:k] >> bit) & 1)
                np.minimum(least, value, out=least)
            live = np.flatnonzero((least <= tau) | (j - 1 + tau > m[:k]))
            order, a, b, m, n, vp, vn, dist = (x[live] for x in (order, a, b, m, n, vp, vn, dist))
            if not len(order):
                return out
        k = int(np.searchsorted(-n, -j, "right"))  # pairs with a column j
        eq = np.zeros(k, np.int64)
        ch = codes[b[:k] + j - 1]
        for bit in range(w):
            row = j - tau + bit
            if row >= 1:
                eq |= ((row <= m[:k]) & (codes[np.minimum(a[:k] + row - 1, top)] == ch)).astype(np.int64) << bit
        p, q = vp[:k], vn[:k]
        d0 = ((((eq & p) + p) ^ p) | eq | q) & full
        hp = (q | ~(d0 | p)) & full
        hn = d0 & p
        down = j + tau <= m[:k]
        last = np.clip(m[:k] - j + tau, 0, w)
        dist[:k] += np.where(down, 1 - (d0 >> (w - 1)), ((hp >> last) & 1) - ((hn >> last) & 1))
        vp[:k], vn[:k] = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    out[order] = dist <= tau
    return out


def stripped(codes: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, ...]:
    """The pairs without what they share at both ends, which no distance depends on; tau + 1 characters stay at least.

    Ends are found by bisection on hashes, so long lines cost no more than short ones.
    """
    spans = Spans(codes)
    most = np.maximum(np.minimum(na, nb) - tau - 1, 0)

    def shared(most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = equal(middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    head = shared(most, lambda k: spans(a, a + k) == spans(b, b + k))
    tail = shared(most - head, lambda k: spans(a + na - k, a + na) == spans(b + nb - k, b + nb))
    return a + head, na - head - tail, b + head, nb - head - tail


def edit_small(codes: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, tau: int = TAU) -> np.ndarray:
    """edit_within for lines of 2 tau characters at most, by the whole distance table."""
    most = 2 * tau
    top = len(codes) - 1
    table = np.minimum(np.arange(most + 1)[:, None] + np.arange(most + 1)[None], 3 * tau)[:, :, None].repeat(len(a), 2)
    for i in range(1, most + 1):
        for j in range(1, most + 1):
            differ = codes[np.minimum(a + i - 1, top)] != codes[np.minimum(b + j - 1, top)]
            table[i, j] = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + differ)
    return table[na, nb, np.arange(len(a))] <= tau


def _lines(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: first text, code points, and number of text, of line, begin and end of each trimmed line with a word."""
    blank = np.zeros(0x110000, bool)
    blank[np.flatnonzero(tv.SPACE)] = True
    for first, some in tv.slices(text):
        points = [au.code_points(t) for t in some.to_pylist()]
        size = np.array([len(p) for p in points])
        at = np.concatenate([[0], np.cumsum(size)])
        codes = np.concatenate(points) if len(points) else np.zeros(0, np.uint32)
        breaks = np.flatnonzero(codes == 10)
        begin = np.sort(np.concatenate([at[:-1], breaks + 1]))
        begin = begin if len(begin) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(points)), np.bincount(np.searchsorted(at, breaks, "right") - 1, minlength=len(points)) + 1)
        end = np.minimum(np.append(begin[1:], at[-1] + 1) - 1, at[doc + 1]) if len(begin) else begin
        same = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
        end = np.where(same, end, at[doc + 1])
        number = np.arange(len(begin)) - np.searchsorted(doc, doc)
        ink = np.append(~blank[codes], False)
        inked = np.concatenate([[0], np.cumsum(ink[:-1])])
        places = np.flatnonzero(ink)
        full = np.flatnonzero(inked[end] > inked[begin])
        b = places[inked[begin[full]]]
        e = places[inked[end[full]] - 1] + 1
        yield first, codes, doc[full], number[full], b, e


#: Values of the code points below this come from a table.
_TABLED = 1 << 16
_VALUES = tv.mix(np.arange(1, _TABLED + 1, dtype=np.uint64))


def _point_values(codes: np.ndarray) -> np.ndarray:
    if not len(codes) or int(codes.max()) < _TABLED:
        return _VALUES[codes]
    return np.where(codes < _TABLED, _VALUES[np.minimum(codes, _TABLED - 1)], tv.mix(codes.astype(np.uint64) + np.uint64(1)))


class Spans:
    """Hashes of parts of a code-point array."""

    def __init__(self, codes: np.ndarray):
        self.down = tv._power("down", tv._INVERSE, len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_point_values(codes) * tv._power("up", tv._BASE, len(codes)), out=self.total[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        own = (self.total[end] - self.total[begin]) * self.down[begin]
        return tv.mix(own ^ tv.mix((end - begin).astype(np.uint64) + (np.asarray(salt).astype(np.uint64) << np.uint64(32))))


def _salted(codes: np.ndarray) -> np.ndarray:
    return codes ^ np.uint32(0x5A5A)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, t1, line_no, h1, h2, n for docs (doc_id, t1, text): each line with a word, by 128 bits of its trimmed text and its length."""
    small_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, codes, doc, number, b, e in _lines(tv.strings(batch.column("text"))):
                own = codes[: e[-1]] if len(e) else codes[:0]
                h1, h2 = Spans(own)(b, e).view(np.int64), Spans(_salted(own))(b, e).view(np.int64)
                at = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("t1").take(at), pa.array(number.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array((e - b).astype(np.int32))], ["doc_id", "t1", "line_no", "h1", "h2", "n"])

    return docs.select("doc_id", "t1", "text").mapInArrow(read, "doc_id long, t1 long, line_no int, h1 long, h2 long, n int")


def segment_names(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """name, h1: the segment names of all lines with a word; a line that repeats within a run of texts once."""
    small_batches(docs.sparkSession)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, codes, _, _, b, e in _lines(tv.strings(batch.column("text"))):
                spans = Spans(codes)
                h1, one = np.unique(spans(b, e), return_index=True)
                fresh = np.array([x not in seen for x in h1.tolist()], bool)
                if len(seen) > FLUSH:
                    seen.clear()
                seen.update(h1.tolist())
                h1, begin, n = h1[fresh], b[one][fresh], (e - b)[one][fresh]
                names, owners = named(spans, h1, begin, n, tau)
                if len(names):
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(owners.view(np.int64))], ["name", "h1"])

    return docs.select("text").mapInArrow(name, "name long, h1 long")


def named(spans: Spans, h1: np.ndarray, begin: np.ndarray, n: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Names of the lines that begin at `begin`, and the line that each belongs to."""
    tiny = n <= 2 * tau
    names, owners = [np.full(int(tiny.sum()), SHORT, np.uint64)], [h1[tiny]]
    for i, d, at, size in probes(n, tau):
        ok = (n - d > tau) & (at >= 0) & (at + size <= n)
        names.append(spans(begin[ok] + at[ok], begin[ok] + at[ok] + size[ok], (n[ok] - d) * 8 + i))
        owners.append(h1[ok])
    return np.concatenate(names), np.concatenate(owners)


def _letters(codes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each line, 64 bits of which characters it has an odd number of times: an edit changes two at most."""
    bits = np.uint64(1) << (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bits, at) if len(at) else np.zeros(0, np.uint64)


def verify(lines: list[str], h1: np.ndarray, side: np.ndarray, cuts: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of h1 within tau edits, of the buckets that begin at cuts[:-1]; each pair once.

    In a bucket, lines of side 0 meet those of side 1, or each other if one side alone is there; none is
    empty. All buckets' pairs are verified together.
    """
    n = np.array([len(x) for x in lines])
    at = np.cumsum(n) - n
    codes = au.code_points("".join(lines))
    odd = _letters(codes, at, n)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        left, right = np.flatnonzero(side[lo:hi] == 0) + lo, np.flatnonzero(side[lo:hi] == 1) + lo
        if len(left) and len(right):
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            i, j = np.triu_indices(hi - lo, 1)
            i, j = i + lo, j + lo
        if len(i) > 16:
            near = np.flatnonzero((np.abs(n[i] - n[j]) <= tau) & (np.bitwise_count(odd[i] ^ odd[j]) <= 2 * tau))
            i, j = i[near], j[near]
        first.append(i)
        second.append(j)
    a, b = np.concatenate(first), np.concatenate(second)
    near = (np.abs(n[a] - n[b]) <= tau) & (np.bitwise_count(odd[a] ^ odd[b]) <= 2 * tau) & (h1[a] != h1[b])
    a, b = a[near], b[near]
    low, high = np.minimum(h1[a], h1[b]), np.maximum(h1[a], h1[b])
    _, once = np.unique(np.stack([low, high], 1), axis=0, return_index=True)
    a, b = a[once], b[once]
    good = np.zeros(len(a), bool)
    small = np.minimum(n[a], n[b]) <= tau
    good[small] = edit_small(codes, at[a[small]], n[a[small]], at[b[small]], n[b[small]], tau)
    large = np.flatnonzero(~small)
    for k in range(0, len(large), PAIRS):
        some = large[k : k + PAIRS]
        x, y = a[some], b[some]
        good[some] = edit_within(codes, *stripped(codes, at[x], n[x], at[y], n[y], tau), tau)
    return np.minimum(h1[a], h1[b])[good], np.maximum(h1[a], h1[b])[good]


def wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, line for docs (doc_id, text) and wanted (k: doc_id or 0, h1s): lines of the texts whose own hash is asked for; a text is split once."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("h1s").to_pylist()
            for first, codes, doc, _, b, e in _lines(tv.strings(batch.column("text"))):
                h1 = Spans(codes)(b, e).view(np.int64)
                if not len(h1):
                    continue
                cuts = np.searchsorted(doc, np.arange(int(doc[-1]) + 2))
                hits = [lo + np.flatnonzero(np.isin(h1[lo:hi], asked[first + d])) for d, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                hits = np.concatenate(hits)
                _, one = np.unique(h1[hits], return_index=True)
                hits = hits[one]
                lines = ["".join(map(chr, codes[b[k] : e[k]].tolist())) if e[k] - b[k] < 64 else codes[b[k] : e[k]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for k in hits.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(h1[hits]), pa.array(lines, pa.string())], ["h1", "line"])

    joined = lookup_join(docs.withColumn("k", F.coalesce("doc_id", F.lit(0))), wanted, ["k"], F.col("text"), "inner")
    return joined.select("h1s", "text").mapInArrow(pick, "h1 long, line string").dropDuplicates(["h1"])


def near_links(docs: DataFrame, lines: DataFrame, tau: int = TAU) -> DataFrame:
    """a, b: h1 of different lines within tau edits, both ways round."""
    each = Window.partitionBy("name")
    names = segment_names(docs, tau).withColumn("lo", F.min("h1").over(each)).withColumn("hi", F.max("h1").over(each))
    buckets = cut(names.where("lo <> hi").select("name", "h1").distinct())
    needed = buckets.select("h1").distinct()
    places = lines.groupBy("h1").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("k")).join(needed, "h1", "left_semi")
    texts = wanted_lines(docs, cut(places.groupBy("k").agg(F.collect_list("h1").alias("h1s"))))
    counts = buckets.groupBy("name").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = lookup_join(buckets, counts.where("blocks > 1"), ["name"], F.col("h1")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("h1", F.lit(3)), F.col("blocks")).cast("int"))
    spread = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("name", "h1", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("side"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = pa.Table.from_batches([batch])
                held = rows if held is None else pa.concat_tables([held, rows])
            if held is None or not len(held):
                continue
            key = np.stack([held.column(c).to_numpy() for c in ("name", "i", "j")], 1)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            last = starts[-1] if batch is not None else len(held)  # the last bucket may go on in the next batch
            done, held = held.slice(0, last), held.slice(last)
            if len(done):
                a, b = verify(done.column("line").to_pylist(), done.column("h1").to_numpy(), done.column("side").to_numpy(), np.append(starts[starts < last], last), tau)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    loaded = spread.join(texts, "h1").select("name", "i", "j", "side", "h1", "line")
    found = cut(loaded.repartition("name", "i", "j").sortWithinPartitions("name", "i", "j").mapInArrow(check, "a long, b long").distinct())
    return found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _placed(docs: DataFrame, tau: int) -> DataFrame:
    """doc_id, t1, line_no, n, here, rep, first, n_links of each line with a word; here, rep, first: places (no, doc_id, t1, line_no) of the line, of the first equal one and of the first one near that."""
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1"), "text")
    lines = cut(line_table(own))
    links = near_links(own.select("doc_id", "text"), lines, tau)
    here = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t1", "line_no")
    classes = cut(lines.groupBy("h1", "h2").agg(F.min(here).alias("rep")))
    linked = links.join(classes.select(F.col("h1").alias("b"), F.col("rep").alias("other")), "b").groupBy(F.col("a").alias("h1")).agg(F.count("*").alias("n_links"), F.min("other").alias("first"))
    classes = cut(classes.join(linked, "h1", "left"))
    return lookup_join(lines, classes, ["h1", "h2"], F.struct("doc_id", "line_no")).withColumn("here", here).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("bigint")))


def _before(first: str, here: str) -> Column:
    return F.coalesce(F.col(first) < F.col(here), F.lit(False))


def line_classes(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, line_no, rep_doc_id, rep_line_no, n_links, kept: a row for each line with a word.

    Lines are trimmed of ASCII blanks. Equal lines are a class, and its first line by (doc_id, line_no)
    stands for it; n_links counts other classes within tau edits, whatever their lengths. A line is kept if no line before it
    is equal or within tau edits. Null and empty texts have no lines; a null doc_id stays null and comes last; rows that
    share a doc_id are texts of their own, the one of the smaller hash first; rows that are equal in both have the same places.
    """
    kept = (F.col("here") == F.col("rep")) & ~_before("first", "rep")
    return _placed(docs, tau).select("doc_id", "line_no", F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.line_no").alias("rep_line_no"), "n_links", F.coalesce(kept, F.lit(True)).alias("kept"))


def without_repeats(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """The columns of docs with texts less the lines that have an equal one before them, or if they have REMOVED_CHARS characters a near one; n_chars, where there is one, follows.

    A document goes only when it lost lines and has no word left; documents that lose no line stay as they are.
    """
    repeats = ~F.col("here").eqNullSafe(F.col("rep")) | ((F.col("n") >= REMOVED_CHARS) & _before("first", "rep"))
    gone = _placed(docs, tau).where(repeats).groupBy(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1")).agg(F.collect_set("line_no").alias("_gone"))
    keyed = docs.withColumn("_t1", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_id"]) & (keyed["_t1"] == gone["_t1"]), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    out = joined.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    out = out.where(F.col("_gone").isNull() | (F.regexp_replace("_left", BLANK, "") != "")).withColumn("text", F.col("_left"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return out.select(docs.columns)
