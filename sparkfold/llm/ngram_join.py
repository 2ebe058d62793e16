"""Exact Jaccard join of n-gram sets, and the components of its links.

1. Every text's shingle set is hashed. Texts of equal sets form a class, and one stands for it.
2. A text needs ceil(0.75 n) of its n shingles in a partner. Shingles that no other text has are counted
   away first: all hashes are dealt to shards in packed blocks, each shard answers which ones occur
   elsewhere, and only texts with enough of those stay.
3. Among these, shingles are ordered globally by the number of texts that have them, then by hash.
   Two linked texts share one of the first n - ceil(0.75 n) + 1 in that order (their prefixes); texts that
   meet in such a shingle, however indirectly, are a group.
4. A group's ordered sets meet in prefix-tree joins: they are stored in a trie, and a text walks it once for all of them,
   sharing overlaps of common beginnings and leaving subtrees where what remains is too short to reach
   the threshold, or where all texts are in its own component. Most groups are one block of BLOCK_SHINGLES.
5. A group of many blocks joins each block with itself, then the leaders of what was found, so that a
   crowd falls together in work that grows with its size. Only texts that still share a prefix shingle
   with another component then meet block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import BROADCAST_ROWS, cut, hot_join, lookup_join, small_batches, swept
from .components import components

NUM, DEN = 75, 100
#: Shingles that a task holds before it deals them out, those of a trie's texts, and bytes of input that a shard of hashes stands for.
FLUSH, BLOCK_SHINGLES, SHARD_BYTES = 1_500_000, 200_000, 16 << 20
NO_ID = -(1 << 63)
#: Classes whose keys (four longs, about 80 bytes in memory) are broadcast; for more, all texts are dealt out by a shuffle.
BROADCAST_CLASSES = 500_000

_PARCEL = "dest int, uid long, what int, body binary, extra binary"
_DOC = np.dtype([("id", "<i8"), ("t1", "<i8"), ("t2", "<i8"), ("n", "<i8"), ("sig", "<i8"), ("sig2", "<i8"), ("shared", "<u4"), ("null", "?")])


def need(n: Column) -> Column:
    """Fewest shingles that a partner must share with a set of n."""
    return F.ceil(n * NUM / DEN).cast("bigint")


def _parcels(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["dest", "uid", "what", "body", "extra"])


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    return tuple(int(tv.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (7, 0x5851F42D4C957F2D))


def _answer(parcels: pa.Table) -> pa.Table:
    """What a shard answers: of each parcel's texts how many hashes occur again. One sort of the shard's hashes serves all parcels, which grow in number with the input."""
    body, owner = parcels.column("body").to_pylist(), parcels.column("extra").to_pylist()
    uids, what = parcels.column("uid").to_pylist(), parcels.column("what").to_pylist()
    rows = [(0, u, 1, b, b"") for u, w, b in zip(uids, what, body, strict=True) if w == 1]
    asked = [k for k, w in enumerate(what) if w == 0]
    if asked:
        h = np.frombuffer(b"".join([body[k] for k in asked]), "<u4")
        to = np.frombuffer(b"".join([owner[k] for k in asked]), "<u2")
        parcel = np.repeat(np.arange(len(asked)), [len(body[k]) // 4 for k in asked])
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        again &= to != 0xFFFF
        found, n = np.unique(parcel[again] << 16 | to[again], return_counts=True)
        text, n = (found & 0xFFFF).astype("<u2"), n.astype("<u4")
        cuts = np.searchsorted(found >> 16, np.arange(len(asked) + 1)).tolist()
        rows += [(0, uids[k], 0, text[a:b].tobytes(), n[a:b].tobytes()) for k, a, b in zip(asked, cuts[:-1], cuts[1:], strict=True) if b > a]
    return pa.Table.from_batches([_parcels(rows)]) if rows else pa.Table.from_batches([], _parcels([(0, 0, 0, b"", b"")]).schema)


def shared_counts(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, t1, t2, n, sig, sig2, shared for each row of docs (doc_id, t1, t2, text).

    t1, t2: 128 bits of the text; n: size of its shingle set; sig, sig2: 128 bits of the set; shared: its shingles that another row has
    as well. Shards follow the size of the input. Shards keep 32 bits of a hash besides their own number, so shared may be slightly too high,
    never too low. A task packs up to FLUSH shingles (one longer text is packed whole), answers for those that
    meet within it, and sends each other one once: 6 bytes.
    """
    small_batches(docs.sparkSession)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = size if size < 1 << 60 else 0  # a plan without known size
    shards = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, sets, held = [], [], 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(s) for s in sets])
            h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            of = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            table = np.zeros(len(sets), _DOC)
            table["id"], table["t1"], table["t2"], table["null"] = zip(*ids, strict=True)
            table["n"] = n
            table["sig"], table["sig2"] = zip(*map(signature, sets), strict=True)
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            same = h[1:] == h[:-1]
            again = np.zeros(len(h), bool)
            again[1:] |= same
            again[:-1] |= same
            table["shared"] = np.bincount(of[again], minlength=len(sets))
            first = ~again
            first[1:] |= again[1:] & ~same
            first[:1] = True
            owner = np.where(again, 0xFFFF, of)[first].astype("<u2")  # 0xFFFF: answered here already
            h = h[first]
            shard = ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            uid = (part << 24) + number
            low = h.astype(np.uint32).astype("<u4")
            rows = [(s, uid, 0, low[a:b].tobytes(), owner[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return _parcels([*rows, (shards + uid % shards, uid, 1, table.tobytes(), b"")])

        for batch in batches:
            none = batch.column("doc_id").is_null().to_pylist()
            own = list(zip(batch.column("doc_id").fill_null(0).to_pylist(), batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), none, strict=True))
            for i, s in tv.shingles(tv.strings(batch.column("text")), k):
                if sets and (held + len(s) > FLUSH or len(sets) == 0xFFFE):
                    yield flush()
                    ids, sets, held, number = [], [], 0, number + 1
                ids.append(own[i])
                sets.append(s)
                held += len(s)
        if sets:
            yield flush()

    def total(parcels: pa.Table) -> pa.Table:
        what, body, extra = (parcels.column(c).to_pylist() for c in ("what", "body", "extra"))
        table = np.frombuffer(next(b for w, b in zip(what, body, strict=True) if w == 1), _DOC).copy()
        for w, b, e in zip(what, body, extra, strict=True):
            if w == 0:
                table["shared"][np.frombuffer(b, "<u2")] += np.frombuffer(e, "<u4")
        names = ("t1", "t2", "n", "sig", "sig2", "shared")
        return pa.table([pa.array(table["id"], mask=table["null"]), *(pa.array(table[c].astype(np.int64)) for c in names)], ["doc_id", *names])

    dealt = docs.select("doc_id", "t1", "t2", "text").mapInArrow(deal, _PARCEL)
    answered = dealt.groupBy("dest").applyInArrow(_answer, _PARCEL)
    return answered.groupBy("uid").applyInArrow(total, "doc_id long, t1 long, t2 long, n long, sig long, sig2 long, shared long")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """cid and its sorted shingle hashes as `h`, an array of longs."""
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for _, s in tv.shingles(tv.strings(batch.column("text")), k)]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["cid", "h"])

    return docs.select("cid", "text").mapInArrow(hashed, "cid long, h array<bigint>")


@dataclass
class Node:
    """A stretch of ordered shingles that all texts below share."""

    items: np.ndarray
    children: dict[int, Node] = field(default_factory=dict)
    texts: list[int] = field(default_factory=list)
    fewest: int = 1 << 60  # smallest set below
    longest: int = 0  # most ordered shingles from here to the end of a text below
    owner: int = -1  # the one component of all texts below, or -2


class Trie:
    """Ordered sets with common beginnings stored once; texts are numbered as added."""

    def __init__(self) -> None:
        self.root = Node(np.zeros(0, np.int64))

    def add(self, text: int, items: np.ndarray, n: int, owner: int) -> None:
        node, left = self.root, items
        while True:
            node.fewest, node.longest = min(node.fewest, n), max(node.longest, len(left))
            node.owner = owner if node.owner in (-1, owner) else -2
            left = left[len(node.items) :]
            if not len(left):
                node.texts.append(text)
                return
            child = node.children.get(int(left[0]))
            if child is None:
                node.children[int(left[0])] = Node(left, {}, [text], n, len(left), owner)
                return
            m = min(len(left), len(child.items))
            differ = np.flatnonzero(child.items[:m] != left[:m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.items):
                upper = Node(child.items[:same], {int(child.items[same]): child}, [], child.fewest, child.longest, child.owner)
                child.items, child.longest = child.items[same:], child.longest - same
                node.children[int(left[0])] = upper
                child = upper
            node = child

    def probe(self, items: np.ndarray, inside: np.ndarray, n: int, skip) -> Iterator[tuple[int, int]]:
        """(text, overlap) of texts that may reach the threshold; inside[x]: whether the probe has x.

        skip(owner) leaves out a subtree of one component.
        """
        todo = [(self.root, 0)]
        while todo:
            node, got = todo.pop()
            if node.owner != -2 and skip(node.owner):
                continue
            least = -(-NUM * (n + node.fewest) // (NUM + DEN))
            if len(node.items):
                rest = len(items) - int(np.searchsorted(items, node.items[0]))
                if got + min(rest, node.longest) < least:
                    continue
                got += int(inside[node.items].sum())
            for text in node.texts:
                yield text, got
            todo += [(child, got) for child in node.children.values()]


def trie_links(n: np.ndarray, comp: np.ndarray, side: np.ndarray, lists: list[np.ndarray], freqs: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect components: texts of two blocks (`side` 0 and 1, or 0 alone) of one group.

    n: whole size of a set; lists, freqs: its shingles that others have too, and how many have each. Returns pairs of
    comps with a verified pair of texts, without those that follow from earlier ones.
    """
    h, f = np.concatenate(lists), np.concatenate(freqs)
    values, first, of = np.unique(h, return_index=True, return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, f[first]))] = np.arange(len(values))  # the global order, numbered within these texts
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    ordered = [np.sort(x) for x in np.split(rank[of], cuts)]
    parent: dict[int, int] = {int(c): int(c) for c in comp}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    one = not (side == 1).any() or not (side == 0).any()
    trie, links = Trie(), []
    if not one:
        for t in np.flatnonzero(side == 0):
            trie.add(int(t), ordered[t], int(n[t]), int(comp[t]))
    inside = np.zeros(len(values), bool)
    for t in range(len(n)) if one else np.flatnonzero(side == 1):
        inside[ordered[t]] = True
        mine = int(comp[t])
        for other, overlap in trie.probe(ordered[t], inside, int(n[t]), lambda c: c >= 0 and find(c) == find(mine)):
            if find(int(comp[other])) != find(mine) and DEN * overlap >= NUM * (int(n[t]) + int(n[other]) - overlap):
                links.append((mine, int(comp[other])))
                parent[find(mine)] = find(int(comp[other]))
        inside[ordered[t]] = False
        if one:
            trie.add(int(t), ordered[t], int(n[t]), mine)
    return links


def _bin_links(block: pa.Table) -> pa.Table:
    """trie_links of each group of a bin."""
    grp = block.column("grp").to_numpy()
    order = np.argsort(grp, kind="stable")
    grp = grp[order]
    n, comp, side = (block.column(c).to_numpy()[order] for c in ("n", "comp", "side"))
    lists, freqs = (_lists(block.column(c), order) for c in ("h", "df"))
    found: list[tuple[int, int]] = []
    cuts = np.flatnonzero(np.append(True, grp[1:] != grp[:-1])).tolist() + [len(grp)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            found += trie_links(n[a:b], comp[a:b], side[a:b], lists[a:b], freqs[a:b])
    return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _lists(column: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy()
    parts = np.split(column.flatten().to_numpy().astype(np.int64), np.cumsum(size)[:-1])
    return [parts[k] for k in order]


def _joined(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """a, b: links of the texts (cid, comp, grp, i, j, side) of each (bin of groups, i, j)."""
    loaded = texts.join(kept.select("cid", "n", "df", "h"), "cid")
    return cut(loaded.groupBy("bin", "i", "j").applyInArrow(_bin_links, "a long, b long").distinct())


def _blocks(texts: DataFrame) -> DataFrame:
    """texts (cid, comp, grp, weight) with `blocks`, each of about BLOCK_SHINGLES, a block's number, and a bin: a group of many blocks is a bin of its own, small groups share one."""
    sizes = cut(texts.groupBy("grp").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.sum("weight").alias("all"), F.count("*").alias("members")).where("members > 1"))
    small = sizes.where("blocks <= 1").agg(F.ceil(F.coalesce(F.sum("all"), F.lit(0)) / BLOCK_SHINGLES).cast("int").alias("bins")).first()["bins"]
    placed = lookup_join(texts, sizes.select("grp", "blocks"), ["grp"], F.col("cid"), "inner")
    own = F.when(F.col("blocks") > 1, F.concat(F.lit("g"), F.col("grp"))).otherwise(F.pmod(F.xxhash64("grp"), F.lit(max(small, 1))).cast("string"))
    return placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.greatest("blocks", F.lit(1))).cast("int")).withColumn("bin", own)


def _alone(blocks: DataFrame) -> DataFrame:
    """Each block with itself."""
    return blocks.select("cid", "comp", "grp", "bin", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"))


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("comp"), F.col("component"))
    return cut(comp.join(found, "comp", "left").select("cid", F.coalesce("component", "comp").alias("comp")))


def _groups(members: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (cid, key) whose shingle joins several comps, and the group of each such comp."""
    own = cut(members.join(comp, "cid"))
    heads = cut(own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", F.col("lo").alias("b")))
    touch = cut(hot_join(own, heads, ["key"], F.col("cid"), "inner").select("cid", "comp", "b").distinct())
    group = components(touch.select(F.col("comp").alias("a"), "b").distinct()).select(F.col("node").alias("comp"), F.col("component").alias("grp"))
    return touch.select("cid", "comp").distinct(), group


def set_components(sets: DataFrame) -> DataFrame:
    """cid, comp for sets (cid, n, h: distinct hashes, no two sets equal): the smallest cid that links reach."""
    each = sets.select("cid", "n", F.explode("h").alias("x"))
    df = each.groupBy("x").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    # from here on, `h` are the shingles that others have too, in the global order: no other one can be in an overlap
    lists = each.join(df, "x").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("items")).where(F.size("items") >= need(F.col("n")))
    prefix = F.col("n") - need(F.col("n")) + 1 - (F.col("n") - F.size("items"))  # places left after the shingles of no other text
    kept = cut(lists.select("cid", "n", F.col("items.df").alias("df"), F.col("items.x").alias("h"), prefix.cast("int").alias("p")))
    del each, df, lists
    swept(kept)
    members = cut(kept.select("cid", F.explode(F.slice("h", F.lit(1), F.greatest("p", F.lit(0)))).alias("key")))
    weights = kept.select("cid", F.size("h").alias("weight"))
    comp = cut(kept.select("cid", F.col("cid").alias("comp")))
    texts, group = _groups(members, comp)
    blocks = cut(_blocks(texts.join(group, "comp").join(weights, "cid")))
    comp = _merged(comp, _joined(_alone(blocks), kept))
    large = blocks.where("blocks > 1").select("cid", "grp", "block", "weight")
    if not large.limit(1).count():
        return comp
    # the leaders of what each block found, one for each component that has several texts
    own = cut(large.join(comp, "cid"))
    lead = own.groupBy("grp", "block", "comp").agg(F.min(F.struct("cid", "weight")).alias("lead"), F.count("*").alias("texts")).where("texts > 1")
    leaders = cut(_blocks(lead.select("lead.cid", "comp", "grp", "lead.weight")))
    comp = _merged(comp, _joined(_alone(leaders), kept))
    # what still shares a shingle with another component
    texts, group = _groups(members.join(large.select("cid"), "cid", "left_semi"), comp)
    blocks = cut(_blocks(texts.join(group, "comp").join(weights, "cid")))
    spread = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    spread = spread.select("cid", "comp", "grp", "bin", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("side"))
    return _merged(comp, _joined(spread, kept))


def _rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, t1, t2, n, component (a number), low (its smallest doc_id) for each row of docs; texts without links have a null component."""
    own = docs.select("doc_id", *_text_key(), "text")
    sizes = swept(cut(shared_counts(own, k)))  # the packed hashes are the most that is ever dealt out
    live = sizes.where((F.col("n") > 0) & (F.col("shared") >= need(F.col("n"))))
    key = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "t1", "t2")
    classes = cut(live.groupBy("sig", "sig2", "n").agg(F.min(key).alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("rows"))).withColumn("cid", F.monotonically_increasing_id())  # of a written table: the same at each reading
    reps = classes.select("rep.*", "cid")
    if reps.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        reps = F.broadcast(reps)
    texts = own.withColumn("k", F.coalesce("doc_id", F.lit(NO_ID))).join(reps, ["k", "t1", "t2"]).select("cid", "text")
    sets = shingle_sets(texts, k).select("cid", F.size("h").cast("bigint").alias("n"), "h")
    comp = set_components(cut(sets.dropDuplicates(["cid"])))  # a row may be there twice, with the same id and text
    named = cut(classes.join(comp, "cid", "left").withColumn("component", F.coalesce("comp", "cid")))
    lows = named.groupBy("component").agg(F.min("low").alias("low"))
    named = cut(lookup_join(named.select("sig", "sig2", "n", "component", "cid"), lows, ["component"], F.col("cid")).drop("cid"))
    return lookup_join(sizes.drop("shared"), named, ["sig", "sig2", "n"], F.struct("doc_id", "t1"))


def _text_key() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def ngram_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: see the module.

    Texts without words (null, empty) have 0 shingles and component_id = doc_id; texts of fewer than k words
    have one shingle, their word sequence; equal sets are linked. Rows that share a doc_id, or have none, are texts
    of their own; component_id is the smallest doc_id of the component that is not null, and null if none is. An empty table gives no rows.
    """
    return _rows(docs, k).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def without_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs less all but one of each component: that of the smallest doc_id (nulls last) and of these the smallest hash of the text.

    Rows of a doc_id that repeats are judged one by one; rows that repeat whole, id and text, are one.
    """
    found = cut(_rows(docs, k).where(F.col("component").isNotNull()).select("component", F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "t1", "t2"))
    row = F.struct("no", "k", "t1", "t2")
    stays = found.groupBy("component").agg(F.min(row).alias("stays"), F.count("*").alias("rows")).where("rows > 1")
    stays = cut(stays)
    joined = lookup_join(found, stays, ["component"], F.struct("k", "t1"), "inner")
    gone = cut(joined.where(row != F.col("stays")).select("no", "k", "t1", "t2").distinct())
    twice = cut(joined.where(row == F.col("stays")).groupBy("no", "k", "t1", "t2").count().where("count > 1").drop("count"))
    names = {c: f"_{c}" for c in ("no", "k", "t1", "t2")}
    gone, twice = gone.withColumnsRenamed(names), twice.withColumnsRenamed(names)
    t1, t2 = _text_key()
    keyed = docs.withColumns({"_no": F.col("doc_id").isNull(), "_k": F.coalesce("doc_id", F.lit(NO_ID)), "_t1": t1, "_t2": t2})
    on = list(names.values())
    small = lambda t: F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t
    left = keyed.join(small(gone), on, "left_anti")
    if twice.limit(1).count():
        left = left.join(small(twice), on, "left_anti").unionByName(left.join(small(twice), on, "left_semi").dropDuplicates(on))
    return left.select(docs.columns)
