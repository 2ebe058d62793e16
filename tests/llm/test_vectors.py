"""Vector links against all pairs: repeated and null ids, lengths, extreme numbers, crowds, several shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sparkfold.llm import vector_graph

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows: list[tuple]) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) of each row by all pairs."""

    def usable(e):
        return e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)

    def unit(e):
        x = np.array(e, float)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    n = len(rows)
    units = [unit(e) if usable(e) and label is not None else None for _, e, label in rows]
    link = [[j for j in range(n) if i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.98] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), low, rows[i][0] == low))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def found(spark, rows, **options):
    got = vector_graph.near_vectors(spark.createDataFrame(rows, SCHEMA), **options)
    return ordered(tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in got.collect())


@pytest.mark.parametrize("shard", [8, 4096])
def test_odd_rows(spark, shard):
    e = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    rows = [(1, e[0], 0), (1, e[1], 0), (3, e[0], 0), (4, e[1], 0)]  # an id that repeats with other vectors
    rows += [(11, e[0], 1), (11, e[0], 1), (13, e[0], 1), (14, [2.0, 0.0, 0.0], 1)]  # and with equal ones
    rows += [(20, [1.0, 2.0], 2), (21, [1.0, 2.0], 2), (22, e[0], 2), (23, e[0], 2), (24, e[1], 2)]  # lengths
    rows += [(30, [1e200, 1e200], 3), (31, [1e200, 1e200], 3), (32, [1e-200, 1e-200], 3), (33, [5e-324, 5e-324], 3), (34, [1e308, -1e308], 3), (35, [-0.0, 1.0], 3), (36, [0.0, 1.0], 3)]
    rows += [(40, None, 4), (41, [], 4), (42, [0.0, 0.0], 4), (43, [float("nan"), 1.0], 4), (44, [float("inf"), 1.0], 4), (45, [None, 1.0], 4), (46, e[0], None), (47, e[0], None)]
    rows += [(None, e[0], 5), (None, e[0], 5), (52, e[0], 5), (None, e[1], 5), (None, None, 5)]
    assert found(spark, rows, shard=shard) == ordered(plain(rows))


def test_all_pairs_over_shards(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((240, 6))
    x[40:90] = x[3] + 0.02 * rng.standard_normal((50, 6))  # a crowd
    for k in range(100, 160):  # chains
        x[k] = x[k - 1] + 0.12 * rng.standard_normal(6)
    x[200:205] = x[3]
    rows = [(int(k), [float(a) for a in v], int(k) % 2) for k, v in enumerate(x)]
    want = plain(rows)
    assert sum(w[1] for w in want) > 1000
    for shard in (16, 60, 4096):
        assert found(spark, rows, shard=shard) == ordered(want)


def test_equal_vectors_are_one_node(spark):
    v = [float(a) for a in np.random.default_rng(1).standard_normal(16)]
    got = found(spark, [(k, v, 0) for k in range(5000)])
    assert got == [(k, 4999, 0, k == 0) for k in range(5000)]


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], SCHEMA)
    clash = df.withColumn("kept", F.lit("x")).withColumn("unit", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("weight", F.lit(1))
    assert [tuple(r)[:4] for r in vector_graph.near_vectors(clash).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False)]
    assert vector_graph.near_vectors(df.where("vec_id < 0")).count() == 0


def test_a_failed_audit_ends_in_all_pairs():
    """A graph without edges finds nothing: its audit says so, and every node is compared."""
    x = np.repeat(np.eye(30), 10, 0) + 0.01 * np.random.default_rng(3).standard_normal((300, 30))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = vector_graph.Graph(x, np.arange(300))
    whole, recall, width = graph.audited(x, True)
    assert recall >= vector_graph.RECALL and (whole == (x @ x.T >= 0.98)).mean() > 0.999
    for level in graph.near:
        level[:] = -1
    every, recall, width = graph.audited(x, True)
    assert width == 0 and (every == (x @ x.T >= 0.98)).all()


def test_units_of_every_length():
    rows = pa.array([[3.0, 4.0], None, [1.0, 0.0, 0.0], [], [1e-300, 0.0], [None, 1.0]])
    got = {int(k): x.tolist() for own, block in vector_graph.unit(rows) for k, x in zip(own, block, strict=True)}
    assert got == {0: [0.6, 0.8], 2: [1.0, 0.0, 0.0], 4: [1.0, 0.0]}
    assert {int(k) for own, _ in vector_graph.unit(rows.slice(1, 2)) for k in own} == {1}
