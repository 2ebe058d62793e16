"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard of a label.

Equal vectors are one class with a weight. The classes of a label (and length) are dealt to shards of a
bounded size, and each shard's graph is built once and kept as a row. Shards then meet two by two: the vectors of
each one query the graph of the other with beams that widen until an audit (exact links of a sample of
those very queries) is met, and every pair is verified by cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup_join
from .components import components

COSINE = 0.98
#: Vectors of a shard at most about; neighbours of a node above level 0 (twice that on it); beams.
SHARD, M, BEAM_BUILD, BEAM, BEAM_MOST = 4096, 12, 48, 24, 768
#: Queries of an audit and the share of their exact links that they must find.
AUDIT, RECALL = 256, 0.99
#: Queries that search together, and rows of neighbour lists that are thinned together.
TOGETHER = 256
#: Searches compare in single precision; what is this close to COSINE is verified.
SLACK = 1e-5


def unit(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors in double precision) of the usable rows of each length: not null, of finite numbers, not zero.

    A vector is scaled by its largest component first, so that no square overflows or vanishes.
    """
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    rows = rows.cast(pa.large_list(pa.float64()))
    at = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    values = rows.values
    body = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    size = np.where(rows.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    for n in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == n)
        x = body[at[own][:, None] + np.arange(n)]
        most = np.abs(x).max(1)
        ok = np.isfinite(most) & (most > 0)  # a maximum with a NaN is NaN
        x = np.ldexp(x[ok], -np.frexp(most[ok])[1][:, None])
        yield own[ok], x / np.sqrt((x * x).sum(1))[:, None] + 0.0


def levels(ids: np.ndarray) -> np.ndarray:
    """The highest level of each node: geometric by a hash of its id, so that reruns agree."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((z >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(-np.log(u) / math.log(M), 8).astype(np.int64)


class Graph:
    """A navigable small-world graph; nodes are rows of x."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, near: list[np.ndarray] | None = None):
        self.x = x
        self.y = x.astype(np.float32)
        self.level = levels(ids)
        order = np.lexsort((ids, -self.level))  # upper nodes first: each batch finds all levels above in place
        self.top = int(self.level.max(initial=0))
        self.entry = int(order[0]) if len(x) else -1
        self.near = near or [np.full((len(x), 2 * M if v == 0 else M), -1, np.int32) for v in range(self.top + 1)]
        done = 1 if near is None else len(x)
        while done < len(x):
            size = min(max(done, 8), TOGETHER, len(x) - done)
            self._insert(order[done : done + size])
            done += size

    def packed(self) -> bytes:
        return b"".join(n.astype("<i4").tobytes() for n in self.near)

    @classmethod
    def unpacked(cls, x: np.ndarray, ids: np.ndarray, body: bytes) -> Graph:
        flat, near, at = np.frombuffer(body, "<i4"), [], 0
        while at < len(flat):
            width = M if near else 2 * M
            near.append(flat[at : at + len(x) * width].reshape(len(x), width))
            at += len(x) * width
        return cls(x, ids, near)

    def _descend(self, q: np.ndarray, stop: int) -> np.ndarray:
        """Closest node for each query by greedy steps on the levels above `stop`."""
        at = np.full(len(q), self.entry)
        best = q @ self.y[self.entry]
        for v in range(self.top, stop, -1):
            moving = np.arange(len(q))
            while len(moving):
                around = self.near[v][at[moving]]
                sims = np.einsum("qmd,qd->qm", self.y[around], q[moving])
                sims[around < 0] = -2
                k = sims.argmax(1)
                value = sims[np.arange(len(moving)), k]
                better = value > best[moving] + 1e-6
                moving, k, value, around = moving[better], k[better], value[better], around[better]
                at[moving], best[moving] = around[np.arange(len(moving)), k], value
        return at

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` closest nodes found on level v (or -1) and their cosines, closest first, query by query."""
        n = len(q)
        ids = np.full((n, width), -1, np.int32)
        sims = np.full((n, width), -2, np.float32)
        opened = np.ones((n, width), bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = start, np.einsum("qd,qd->q", self.y[start], q), False
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), start] = True
        live = np.arange(n)
        while True:
            todo = ~opened[live]
            some = todo.any(1)
            live = live[some]
            if not len(live):
                return ids, sims
            first = todo[some].argmax(1)
            opened[live, first] = True
            around = self.near[v][ids[live, first]]
            new = (around >= 0) & ~seen[live[:, None], around]
            r, c = np.nonzero(new)
            to = around[r, c]
            seen[live[r], to] = True
            value = np.full(around.shape, -2, np.float32)
            value[r, c] = np.einsum("pd,pd->p", self.y[to], q[live[r]])
            better = (value > sims[live, -1:]).any(1)
            rows = live[better]
            if not len(rows):
                continue
            every = np.concatenate([sims[rows], value[better]], 1)
            keep = np.argsort(-every, 1, kind="stable")[:, :width]
            sims[rows] = np.take_along_axis(every, keep, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new[better], around[better], -1)], 1), keep, 1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], ~new[better]], 1), keep, 1)

    def _insert(self, batch: np.ndarray) -> None:
        q = self.y[batch]
        mutual = q @ q.T  # of the batch itself, which the graph doesn't hold yet
        np.fill_diagonal(mutual, -2)
        for v in range(int(self.level[batch].max()), -1, -1):
            here = np.flatnonzero(self.level[batch] >= v)
            found, sims = self.beam(q[here], self._descend(q[here], v), BEAM_BUILD, v)
            peers = np.where(self.level[batch][None, :] >= v, mutual[here], -2)
            close = np.argsort(-peers, 1, kind="stable")[:, :BEAM_BUILD]
            peers = np.take_along_axis(peers, close, 1)
            found = np.concatenate([found, np.where(peers > -2, batch[close], -1)], 1)
            sims = np.concatenate([sims, peers], 1)
            order = np.argsort(-sims, 1, kind="stable")[:, : 3 * M]
            found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
            r, c = np.nonzero(self._spread(found, sims, M))
            self._link(v, np.concatenate([batch[here][r], found[r, c]]), np.concatenate([found[r, c], batch[here][r]]))

    def _spread(self, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Which of each row's nodes to keep, closest first: those closer to the row's own node than to one kept before; then the closest others."""
        kept = np.zeros(found.shape, bool)
        for a in range(0, len(found), TOGETHER):
            ids, own, keep = found[a : a + TOGETHER], sims[a : a + TOGETHER], kept[a : a + TOGETHER]
            y = self.y[ids]
            between = y @ y.transpose(0, 2, 1)
            worst = np.full(ids.shape, -2, np.float32)
            n = np.zeros(len(ids), np.int64)
            for i in range(ids.shape[1]):
                take = (ids[:, i] >= 0) & (worst[:, i] < own[:, i]) & (n < most)
                keep[take, i] = True
                n += take
                worst = np.where(take[:, None], np.maximum(worst, between[:, :, i]), worst)
            rest = ~keep & (ids >= 0)
            keep |= rest & (np.cumsum(rest, 1) <= np.maximum(most // 2 - n, 0)[:, None])
        return kept

    def _link(self, v: int, nodes: np.ndarray, others: np.ndarray) -> None:
        """Adds others[k] to the neighbours of nodes[k]; lists that get too long are thinned."""
        near = self.near[v]
        most = near.shape[1]
        touched = np.unique(nodes)
        r, c = np.nonzero(near[touched] >= 0)
        a, b = np.concatenate([touched[r], nodes]), np.concatenate([near[touched[r], c], others])
        pair = np.unique(a.astype(np.int64) * len(self.x) + b)
        a, b = pair // len(self.x), pair % len(self.x)
        sims = np.einsum("pd,pd->p", self.y[a], self.y[b])
        order = np.lexsort((b, -sims, a))
        a, b, sims = a[order], b[order], sims[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        size = np.bincount(a, minlength=len(self.x))[a]
        easy = size <= most
        near[touched] = -1
        near[a[easy], rank[easy]] = b[easy]
        full = np.unique(a[~easy])
        if len(full):
            width = min(3 * most, int(size.max()))
            use = ~easy & (rank < width)
            row = np.searchsorted(full, a[use])
            ids, own = np.full((len(full), width), -1, np.int32), np.full((len(full), width), -2, np.float32)
            ids[row, rank[use]], own[row, rank[use]] = b[use], sims[use]
            keep = self._spread(ids, own, most)
            r, c = np.nonzero(keep)
            near[full[r], np.arange(len(r)) - np.searchsorted(r, r)] = ids[r, c]

    def linked(self, q: np.ndarray, width: int) -> np.ndarray:
        """Which nodes have a verified cosine of COSINE with each query, among those found; width 0: among all.

        A query whose whole beam is linked widens it fourfold; if that one is all linked too, all nodes are compared.
        """
        out = np.zeros((len(q), len(self.x)), bool)
        for a in range(0, len(q), TOGETHER):
            todo = np.arange(a, min(a + TOGETHER, len(q)))
            for wide in (width, 4 * width) if 0 < width < len(self.x) else ():
                part = q[todo].astype(np.float32)
                ids, sims = self.beam(part, self._descend(part, 0), min(wide, len(self.x)), 0)
                crowded = sims[:, -1] >= COSINE - SLACK
                r, c = np.nonzero((sims >= COSINE - SLACK) & ~crowded[:, None])
                out[todo[r], ids[r, c]] = np.einsum("pd,pd->p", self.x[ids[r, c]], q[todo[r]]) >= COSINE
                todo = todo[crowded]
                if not len(todo):
                    break
            if len(todo):
                out[todo] = q[todo] @ self.x.T >= COSINE
        return out

    def audited(self, q: np.ndarray, own: bool) -> tuple[np.ndarray, float, int]:
        """linked(q) at the narrowest beam, doubled from BEAM, at which AUDIT of the queries find RECALL of their exact links.

        Also that share, and the beam's width (0: no beam did, and all nodes were compared). own: the queries are the nodes, and
        links to themselves don't count.
        """
        some = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64))
        exact = q[some] @ self.x.T >= COSINE
        if own:
            exact[np.arange(len(some)), some] = False
        width, wanted = BEAM, exact.sum()
        while width <= BEAM_MOST and width < len(self.x):
            met = float((self.linked(q[some], width) & exact).sum() / wanted) if wanted else 1.0
            if met >= RECALL:
                return self.linked(q, width), met, width
            width *= 2
        return self.linked(q, 0), 1.0, 0


_SHARD_FIELDS = "shard int, shards int, n int, ids binary, weights binary, unit binary, near binary"
_FOUND = pa.schema([("what", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("recall", pa.float64())])


def shard_row(block: pa.Table) -> dict:
    """A shard's classes and graph."""
    ids = block.column("cid").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    x = np.frombuffer(b"".join(block.column("unit").to_pylist()), "<f8").reshape(len(ids), -1)[order]
    weights = block.column("weight").to_numpy()[order]
    near = Graph(x, ids).packed()
    first = block.slice(0, 1).to_pylist()[0]
    return {"shard": first["shard"], "shards": first["shards"], "n": len(ids), "ids": ids.astype("<i8").tobytes(), "weights": weights.astype("<i8").tobytes(), "unit": x.astype("<f8").tobytes(), "near": near}


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, Graph]:
    ids, weights = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["weights"], "<i8")
    x = np.frombuffer(row["unit"], "<f8").reshape(len(ids), -1)
    return ids, weights, Graph.unpacked(x, ids, row["near"])


def _stars(met: np.ndarray, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each component of a table of links; one: rows and columns are the same nodes."""
    seen = np.zeros(met.shape[0], bool)
    for r in np.flatnonzero(met.any(1)).tolist():
        if seen[r]:
            continue
        rows, columns = np.zeros(met.shape[0], bool), np.zeros(met.shape[1], bool)
        edge = np.array([r])
        while len(edge):
            rows[edge] = True
            fresh = met[edge].any(0) & ~(rows if one else columns)
            columns |= fresh
            edge = np.flatnonzero(fresh if one else met[:, fresh].any(1) & ~rows)
        seen |= rows
        yield np.flatnonzero(rows), np.flatnonzero(columns) if not one else np.zeros(0, np.int64)


def pair_links(left: dict, right: dict | None) -> pa.Table:
    """Links of two shards, or of one with itself, found from either end.

    what 0: a = class, b = weight of the classes it is linked with here, recall = the lower one of the two
    audits; what 1: a and b are joined.
    """
    ids, weights, graph = _opened(left)
    if right is None:
        met, recall, _ = graph.audited(graph.x, True)
        met |= met.T
        np.fill_diagonal(met, False)
        ends = [(ids, met, weights)]
    else:
        ids2, weights2, graph2 = _opened(right)
        met, recall, _ = graph2.audited(graph.x, False)
        back, recall2, _ = graph.audited(graph2.x, False)
        met |= back.T
        recall = min(recall, recall2)
        ends = [(ids, met, weights2), (ids2, met.T, weights)]
    what, a, b = [], [], []
    for own, rows, other in ends:
        n = np.array([int(other[row].sum()) for row in rows], np.int64)
        what.append(np.zeros(len(own), np.int32))
        a.append(own)
        b.append(n)
    for rows, columns in _stars(met, right is None):
        nodes = np.concatenate([ids[rows], ids2[columns]]) if right is not None else ids[rows]
        what.append(np.ones(len(nodes), np.int32))
        a.append(nodes)
        b.append(np.full(len(nodes), nodes.min()))
    what, a, b = (np.concatenate(v) if v else np.zeros(0) for v in (what, a, b))
    return pa.table([pa.array(what, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), recall))], schema=_FOUND)


def near_vectors(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for each row of vectors (vec_id, embedding, label).

    Vectors of one length link within a label at a cosine of COSINE and more. Null labels, and null, empty, zero or
    non-finite vectors, link with nothing. Each row is a vector of its own, whether its vec_id is
    null or repeats; component_id is the smallest vec_id that is not null, and kept tells whether it is the row's own (null
    equals null). recall: the lowest audit of the searches that the row took part in, 1 where it took part in none.

    Shards hold about `shard` distinct vectors; each graph is built once, and the shards of a label meet two by
    two, so a hot label is many tasks of a bounded size. An empty table gives no rows.
    """
    kind = dict(vectors.dtypes)["label"]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in unit(batch.column("embedding")):
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("label").take(take), pa.array([v.astype("<f8").tobytes() for v in x], pa.binary())], ["vec_id", "label", "unit"])

    rows = vectors.where(F.col("label").isNotNull()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = rows.mapInArrow(clean, f"vec_id long, label {kind}, unit binary")
    usable = cut(usable.select("vec_id", "label", "unit", F.xxhash64(F.lit(1), "unit").alias("h1"), F.xxhash64(F.lit(2), "unit").alias("h2")))
    grouped = usable.groupBy("label", "unit", "h1", "h2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    classes = cut(grouped.withColumn("width", F.length("unit"))).withColumn("cid", F.monotonically_increasing_id())  # of a written table: the same at each reading
    counts = classes.groupBy("label", "width").agg(F.greatest(F.lit(1), F.round(F.count("*") / shard)).cast("int").alias("shards"))
    placed = lookup_join(classes.select("label", "width", "cid", "weight", "unit", "h1"), counts, ["label", "width"], F.col("h1"), "inner")
    key = ["label", "width", "shard"]
    parts = placed.withColumn("shard", F.pmod(F.col("h1"), F.col("shards")).cast("int")).drop("h1")

    def build(block: pa.Table) -> pa.Table:
        row = shard_row(block)
        head = block.slice(0, 1).select(["label", "width"])
        for name, type_ in (("shard", pa.int32()), ("shards", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("unit", pa.binary()), ("near", pa.binary())):
            head = head.append_column(name, pa.array([row[name]], type_))
        return head

    def meet(block: pa.Table) -> pa.Table:
        two = sorted(block.to_pylist(), key=lambda r: r["shard"])
        if len(two) == 1 and two[0]["i"] != two[0]["j"]:  # no vector was dealt to the other shard
            return _FOUND.empty_table()
        return pair_links(two[0], two[1] if len(two) > 1 else None)

    graphs = cut(parts.groupBy(key).applyInArrow(build, f"label {kind}, width int, {_SHARD_FIELDS}"))
    met = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = met.withColumn("i", F.least("shard", "other")).withColumn("j", F.greatest("shard", "other")).drop("other")
    found = cut(met.groupBy("label", "width", "i", "j").applyInArrow(meet, "what int, a long, b long, recall double"))
    links = found.where("what = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("n"), F.min("recall").alias("recall"))
    comp = components(found.where("what = 1 AND a <> b").select("a", "b")).withColumnRenamed("node", "cid")
    own = cut(classes.select("label", "h1", "h2", "cid", "weight", "low").join(links, "cid", "left").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    named = lookup_join(own, own.groupBy("component").agg(F.min("low").alias("component_id")), ["component"], F.col("cid"))
    result = named.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))
    live = lookup_join(usable.select("vec_id", "label", "h1", "h2"), result, ["label", "h1", "h2"], F.coalesce("vec_id", F.lit(0))).select("vec_id", "n_links", "component_id", "recall")
    return live.unionByName(_alone(vectors, kind)).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")


def _alone(vectors: DataFrame, kind: str) -> DataFrame:
    """The rows that link with nothing."""

    def odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ones(len(batch), bool)
            for own, _ in unit(batch.column("embedding")):
                out[own] = False
            out |= ~batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(np.flatnonzero(out)))], ["vec_id"])

    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(odd, "vec_id long").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1.0).alias("recall"))
