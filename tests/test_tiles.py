"""Tiles of one protein, and pairs too large for whole matrices."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from sparkfold.functions import geometry as geo
from sparkfold.functions import strips
from sparkfold.functions.align import align, consensus, hard_batch, soft_batch
from sparkfold.operators import encoders
from sparkfold.operators.alignment import AlignOptions, align_all, similarity_cells, similarity_summary, steps
from sparkfold.sources import tables as tb

RNG = np.random.default_rng(11)


def test_tiles_of_one_protein_have_no_pair_of_their_own(spark):
    proteins = tb.from_arrays(spark, {f"p{k}": RNG.normal(0, 0.3, (5 + k, 8)) for k in range(4)})
    for mode in ("hard", "both"):
        o = AlignOptions.of("structure-d64", mode)
        alone, together = ({r["pair_index"]: r for r in align_all(proteins, o, tile=t).collect()} for t in (1, 64))
        assert alone == together and len(alone) == 6
    assert steps(align_all(proteins.where("idx = 0"), AlignOptions.of("structure-d64"), tile=1)).count() == 0


@pytest.mark.parametrize("gaps", [(-1.4, -0.15), (-1.01982, 0.225736), (-2.0, -1.0)])
def test_strips_give_what_whole_matrices_give(gaps):
    for k in range(60):
        a, b = (RNG.normal(0, 0.7, (RNG.integers(1, 40), 3)).round(k % 2) for _ in range(2))  # whole numbers: many ties
        rows, t = int(RNG.integers(1, 12)), (1.0, 0.3, 2.0)[k % 3]
        best, path = hard_batch([a @ b.T], *gaps)[0]
        got, found = strips.hard_pair(a, b, *gaps, rows=rows)
        assert got == pytest.approx(best) == pytest.approx(strips.hard_pair(a, b, *gaps, paths=False, rows=rows)[0])
        assert (found.query.tolist(), found.target.tolist()) == (path.query.tolist(), path.target.tolist())
        assert found.score == pytest.approx(path.score)
        log_z, shares = soft_batch([a @ b.T], -3.2, -0.11, t)[0]
        got, found = strips.soft_pair(a, b, -3.2, -0.11, t, threshold=0.1, rows=rows)
        likely = consensus(a @ b.T, shares, 0.1)
        assert got == pytest.approx(log_z) == pytest.approx(strips.soft_pair(a, b, -3.2, -0.11, t, paths=False, rows=rows)[0])
        assert (found.query.tolist(), found.target.tolist()) == (likely.query.tolist(), likely.target.tolist())


def test_a_large_pair_takes_the_memory_of_strips():
    """Whole matrices of this pair take 72 MB for the scores alone."""
    a, b = RNG.normal(0, 0.12, (2, 3000, 16))
    for mode in ("hard", "soft", "both"):
        tracemalloc.start()
        align([(a, b)], mode, (-1.4, -0.15), (-3.2, -0.11), paths=mode == "hard")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6


def test_contacts_and_neighbours_by_blocks(monkeypatch):
    a, b = RNG.normal(0, 8, (2, 50, 3))
    ok = RNG.random((2, 50)) < 0.8
    q, t = np.sort(RNG.choice(50, (2, 30)), 1)
    whole, near = geo.lddt(a, ok[0], b, ok[1], q, t), geo.knn(a, ok[0], 60)
    monkeypatch.setattr(geo, "BLOCK_CELLS", 170)  # three rows
    assert geo.lddt(a, ok[0], b, ok[1], q, t) == whole
    assert all(np.array_equal(x, y) for x, y in zip(geo.knn(a, ok[0], 60), near, strict=True))
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(2)) <= 15
    contacts = np.triu(d & ok[0][:, None] & ok[0][None], 1).sum()
    aligned = np.isin(np.arange(50), q)
    to = dict(zip(q.tolist(), t.tolist(), strict=True))
    aligned &= np.array([ok[1][to.get(k, 0)] for k in range(50)])
    assert whole["coverage_byA"] == pytest.approx(np.triu(d & (ok[0] & aligned)[:, None] & (ok[0] & aligned)[None], 1).sum() / contacts)


def test_lddt_of_a_long_protein_takes_the_memory_of_blocks():
    """All distances of this protein would take 128 MB a table."""
    a = RNG.normal(0, 1, (4000, 3))
    ok, q = np.ones(4000, bool), np.arange(4000)
    tracemalloc.start()
    assert geo.lddt(a, ok, a, ok, q, q)["lddt"] == 1
    assert geo.knn(a, ok, 8)[0].shape == (4000, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


def test_edges_by_blocks(monkeypatch):
    xyz, source = RNG.normal(0, 6, (40, 5, 3)), np.ones((40, 5), int)
    w = encoders.synthetic_graph_weights()
    whole = encoders.encode_graph(xyz, source, w, attend=True)
    monkeypatch.setattr(encoders.blocks, "__defaults__", (7,))
    for x, y in zip(whole, encoders.encode_graph(xyz, source, w, attend=True), strict=True):
        assert np.allclose(x, y)


def test_products_by_blocks(spark):
    vectors = {k: RNG.normal(0, 1, (n, 4)) for k, n in enumerate((5, 7, 3))}
    rows = [(k, i, [float(x) for x in v]) for k, m in vectors.items() for i, v in enumerate(m)] + [(3, 0, [None, 1.0, 1.0, 1.0]), (3, 1, [1.0, 1.0, 1.0, 1.0])]
    r = spark.createDataFrame(rows, "idx long, residue_index int, embedding array<double>")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 0), (2, 0, 3)], "pair_index long, query_index long, target_index long")
    got = {(c["pair_index"], c["i"], c["j"]): c["score"] for c in similarity_cells(r, pairs, block=3, rows=2).collect()}
    want = {(k, i, j): float(vectors[a][i] @ vectors[b][j]) for k, a, b in ((0, 0, 1), (1, 2, 0)) for i in range(len(vectors[a])) for j in range(len(vectors[b]))}
    assert {k: v for k, v in got.items() if k[0] < 2} == pytest.approx(want)
    assert all((got[2, i, 0] is None) and got[2, i, 1] == pytest.approx(vectors[0][i].sum()) for i in range(5)) and len(got) == len(want) + 10
    for s in similarity_summary(r, pairs, block=3, rows=2).collect():
        cells = [v for k, v in got.items() if k[0] == s["pair_index"] and v is not None]
        assert (s["cells"], s["lowest"], s["highest"], s["mean"]) == (sum(k[0] == s["pair_index"] for k in got), pytest.approx(min(cells)), pytest.approx(max(cells)), pytest.approx(np.mean(cells)))


def test_cells_come_from_a_row_a_line(spark):
    vectors = {k: RNG.normal(0, 1, (n, 4)) for k, n in enumerate((5, 9))}
    gone = {(0, 2), (1, 0), (1, 3), (1, 4)}  # residues without an embedding meet nothing, and places go on after them
    rows = [(k, i, None if (k, i) in gone else [float(x) for x in v]) for k, m in vectors.items() for i, v in enumerate(m)]
    r = spark.createDataFrame(rows, "idx long, residue_index int, embedding array<double>")
    cells = similarity_cells(r, spark.createDataFrame([(7, 0, 1)], "pair_index long, query_index long, target_index long"), block=6, rows=2)
    assert cells.columns == ["pair_index", "query_index", "target_index", "i", "j", "score"]
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("MapInArrow")  # Spark makes the cells of what workers send
    got = [((c["pair_index"], c["query_index"], c["target_index"], c["i"], c["j"]), c["score"]) for c in cells.collect()]
    want = {(7, 0, 1, i, j): float(vectors[0][i] @ vectors[1][j]) for i in range(5) for j in range(9) if (0, i) not in gone and (1, j) not in gone}
    assert len(got) == len(want) and dict(got) == pytest.approx(want)


def test_quick_rounding_is_sparks(spark):
    from pyspark.sql import functions as F

    from sparkfold.queries import quick_r6, r6

    ties = [(k + 0.5) / 1e6 for k in (0, 1, 2, 123456, 499999, 999999, 999999999)] + [float(f"{k}.{m}5") for k in (0, 1, 12, 999) for m in range(100000, 100040)]
    near = [x + d for x in ties for d in (-1e-15, 1e-15, -1e-13, 1e-13, -1e-9, 1e-9)]
    odd = [0.0, 1e-300, 1e-7, 4.9999999e-7, 999.9999995, 1000.0, 1234567.8901235, 9007199254.740993, 1e15, 1e300, float("inf"), float("nan"), None]
    many = [float(x) for x in np.concatenate([RNG.normal(0, 0.125, 5000), RNG.normal(0, 300, 2000)])]
    x = [s * v if v is not None else None for v in ties + near + odd + many for s in (1, -1)]
    both = spark.createDataFrame([(v,) for v in x], "x double").select("x", r6(F.col("x"), "slow"), quick_r6(F.col("x"), "quick")).collect()
    text = lambda v: None if v is None else v.hex()  # noqa: E731  the sign of zero counts
    assert len(both) == len(x) and [b["x"] for b in both if text(b["slow"]) != text(b["quick"])] == []
