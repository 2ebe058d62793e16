"""The metric panel as relational aggregates over paths and residues, and as one kernel a pair.

Tables: steps (pair_index, query_index, target_index, step, q, t) and residues (idx, residue_index, code, x, y, z,
observed). Everything that isn't defined is null; nothing is made up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.expressions import tm_d0
from ..functions.lazy import pandas_udf
from ..model import AMINO, METRICS

MATCH = "q >= 0 AND t >= 0"


def coverage(alignments: DataFrame, lengths: DataFrame) -> DataFrame:
    """pair_index, coverage_query, coverage_target, coverage_mean from aligned_pairs and idx, length."""
    size = lambda s: lengths.select(F.col("idx").alias(f"{s}_index"), F.col("length").alias(f"{s}_length"))
    j = alignments.join(size("query"), "query_index").join(size("target"), "target_index")
    n = F.col("aligned_pairs")
    return j.select("pair_index", F.try_divide(n, F.col("query_length")).alias("coverage_query"), F.try_divide(n, F.col("target_length")).alias("coverage_target"), F.try_divide(2 * n, F.col("query_length") + F.col("target_length")).alias("coverage_mean"))


def matched(steps: DataFrame, residues: DataFrame, columns: list[str]) -> DataFrame:
    """Match steps with the columns of both residues, as q_* and t_*."""
    side = lambda s, k: residues.select(F.col("idx").alias(f"{s}_index"), F.col("residue_index").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns])
    return steps.where(MATCH).join(side("query", "q"), ["query_index", "q"]).join(side("target", "t"), ["target_index", "t"])


def identity(steps: DataFrame, residues: DataFrame) -> DataFrame:
    """pair_index, identity: equal letters among matches of two standard residues, whatever their case."""
    both = matched(steps, residues, ["code"])
    a, b = F.upper("q_code"), F.upper("t_code")
    known = a.isin(*AMINO) & b.isin(*AMINO)
    return both.groupBy("pair_index").agg(F.avg(F.when(known, (a == b).cast("double"))).alias("identity"))


def moments(steps: DataFrame, residues: DataFrame) -> DataFrame:
    """pair_index, n, the mean points and the nine central cross-moments of matched observed atoms: all a superposition needs."""
    both = matched(steps, residues, ["x", "y", "z", "observed"]).where("q_observed AND t_observed")
    sums = [F.count("*").alias("n")]
    for s in "qt":
        sums += [F.sum(f"{s}_{c}").alias(f"{s}{c}") for c in "xyz"]
        sums.append(F.sum(sum(F.col(f"{s}_{c}") * F.col(f"{s}_{c}") for c in "xyz")).alias(f"{s}{s}"))
    sums += [F.sum(F.col(f"t_{a}") * F.col(f"q_{b}")).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"]
    g = both.groupBy("pair_index").agg(*sums)
    n = F.col("n")
    out = [F.col("pair_index"), n, *[(F.col(f"{s}{c}") / n).alias(f"{s}{c}") for s in "qt" for c in "xyz"]]
    out += [(F.col(f"{s}{s}") - sum(F.col(f"{s}{c}") * F.col(f"{s}{c}") for c in "xyz") / n).alias(f"{s}{s}") for s in "qt"]
    out += [(F.col(f"s{a}{b}") - F.col(f"t{a}") * F.col(f"q{b}") / n).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"]
    return g.select(out)


@pandas_udf("struct<r:array<double>,t:array<double>,rmsd:double>")
def _transform(m: pd.DataFrame) -> pd.DataFrame:
    """Rotation (row by row), shift and RMSD from the moments of each row; null below three points."""
    v = m.to_numpy(np.float64)
    n = v[:, 0]
    q, t = v[:, 1:4], v[:, 4:7]
    qq, tt, s = v[:, 7], v[:, 8], v[:, 9:18].reshape(-1, 3, 3)
    key = np.empty((len(v), 4, 4))
    trace = np.trace(s, axis1=1, axis2=2)
    key[:, 0, 0] = trace
    key[:, 0, 1:] = key[:, 1:, 0] = np.stack([s[:, 1, 2] - s[:, 2, 1], s[:, 2, 0] - s[:, 0, 2], s[:, 0, 1] - s[:, 1, 0]], 1)
    key[:, 1:, 1:] = s + s.transpose(0, 2, 1) - trace[:, None, None] * np.eye(3)
    value, vector = np.linalg.eigh(key)
    w, x, y, z = vector[:, :, -1].T
    r = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], 1)
    shift = q - np.einsum("kij,kj->ki", r.reshape(-1, 3, 3), t)
    rmsd = np.sqrt(np.maximum(qq + tt - 2 * value[:, -1], 0) / np.maximum(n, 1))
    ok = n >= 3
    return pd.DataFrame({"r": [list(a) if k else None for a, k in zip(r, ok, strict=True)], "t": [list(a) if k else None for a, k in zip(shift, ok, strict=True)], "rmsd": np.where(ok, rmsd, np.nan)}).astype({"rmsd": "Float64"}).assign(rmsd=lambda d: d["rmsd"].where(ok, None))


def superpositions(steps: DataFrame, residues: DataFrame) -> DataFrame:
    """pair_index, n, r, t, rmsd: target onto query over matched observed atoms; null below three."""
    m = moments(steps, residues)
    cols = ["n", *[f"{s}{c}" for s in "qt" for c in "xyz"], "qq", "tt", *[f"s{a}{b}" for a in "xyz" for b in "xyz"]]
    return m.withColumn("u", _transform(F.struct(*[F.col(c).cast("double") for c in cols]))).select("pair_index", "n", "u.r", "u.t", "u.rmsd")


def tm_scores(steps: DataFrame, residues: DataFrame, lengths: DataFrame) -> DataFrame:
    """pair_index, rmsd, tm_score_query, tm_score_target, each over the whole length of its protein."""
    both = matched(steps, residues, ["x", "y", "z", "observed"]).where("q_observed AND t_observed")
    size = lambda s: lengths.select(F.col("idx").alias(f"{s}_index"), F.col("length").alias(f"{s}_length"))
    j = both.join(superpositions(steps, residues).where("r IS NOT NULL").select("pair_index", "r", F.col("t").alias("shift"), "rmsd"), "pair_index").join(size("query"), "query_index").join(size("target"), "target_index")
    moved = [sum(F.col("r")[3 * k + c] * F.col(f"t_{'xyz'[c]}") for c in range(3)) + F.col("shift")[k] for k in range(3)]
    d2 = sum((moved[k] - F.col(f"q_{'xyz'[k]}")) * (moved[k] - F.col(f"q_{'xyz'[k]}")) for k in range(3))
    j = j.withColumn("d2", d2)
    near = lambda length: 1 / (1 + F.col("d2") / (tm_d0(length) * tm_d0(length)))
    return j.groupBy("pair_index").agg(F.max("rmsd").alias("rmsd"), F.sum(near(F.col("query_length")) / F.col("query_length")).alias("tm_score_query"), F.sum(near(F.col("target_length")) / F.col("target_length")).alias("tm_score_target"))


def contacts(residues: DataFrame, radius: float = geo.LDDT_RADIUS, cell: float | None = None) -> DataFrame:
    """idx, i, j, d: pairs i < j of observed atoms of a protein within the radius.

    Atoms meet by an equi-join on grid cells as wide as the radius (one side copied to its 27 neighbours),
    so the work follows the number of near atoms and not the square of the protein.
    """
    w = cell or radius
    seen = residues.where("observed").select("idx", "residue_index", "x", "y", "z", *[F.floor(F.col(c) / w).alias(f"c{c}") for c in "xyz"])
    left = seen.select("idx", F.col("residue_index").alias("i"), *[F.col(c).alias(f"{c}1") for c in "xyz"], "cx", "cy", "cz")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = seen.select("idx", F.col("residue_index").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"], "cx", "cy", "cz")
    for c in ("cx", "cy", "cz"):
        right = right.withColumn("_o", F.explode(around)).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
    d = F.sqrt(sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"))
    return left.join(right, ["idx", "cx", "cy", "cz"]).where("i < j").withColumn("d", d).where(F.col("d") <= radius).select("idx", "i", "j", "d")


_SIX = ("lddt", "lddt_byA", "lddt_byB", "lddt_aln", "coverage_byA", "coverage_byB")


@pandas_udf("struct<" + ",".join(f"`{m}`:double" for m in _SIX) + ">")
def _six(p: pd.DataFrame) -> pd.DataFrame:
    """The six lDDT fields of each pair: columns q, t, at_q, ca_q, at_t, ca_t (places and coordinates of observed atoms)."""
    rows = []
    for r in p.itertuples(index=False):
        side = []
        q, t = (np.zeros(0, np.int64) if v is None else np.asarray(v, np.int64) for v in (r.q, r.t))
        for at, ca, own in ((r.at_q, r.ca_q, q), (r.at_t, r.ca_t, t)):
            at = np.zeros(0, np.int64) if at is None else np.asarray(at, np.int64)
            n = int(max(at.max(initial=-1), own.max(initial=-1))) + 1
            xyz, ok = np.zeros((n, 3)), np.zeros(n, bool)
            if len(at):
                xyz[at], ok[at] = np.asarray(ca, np.float64).reshape(-1, 3), True
            side += [xyz, ok]
        rows.append(geo.lddt(*side, q, t))
    return pd.DataFrame(rows, columns=list(_SIX)).astype({m: object for m in _SIX})


def lddt(steps: DataFrame, residues: DataFrame, alignments: DataFrame) -> DataFrame:
    """pair_index and the six lDDT fields.

    A row a pair holds its path and the observed atoms of both proteins, whose contacts are counted block by block: a
    protein's contacts grow with the square of its length where its atoms are near each other, and none is written out.
    """
    path = steps.where(MATCH).groupBy("pair_index").agg(F.sort_array(F.collect_list(F.struct("step", "q", "t"))).alias("v")).select("pair_index", F.col("v.q").alias("q"), F.col("v.t").alias("t"))
    atoms = residues.where("observed").groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("residue_index", "x", "y", "z"))).alias("v"))
    flat = F.flatten(F.transform("v", lambda s: F.array(s["x"], s["y"], s["z"])))
    side = lambda s: atoms.select(F.col("idx").alias(f"{s}_index"), F.col("v.residue_index").alias(f"at_{s[0]}"), flat.alias(f"ca_{s[0]}"))
    j = alignments.select("pair_index", "query_index", "target_index").join(path, "pair_index", "left").join(side("query"), "query_index", "left").join(side("target"), "target_index", "left")
    return _dealt(j).withColumn("s", _six(F.struct("q", "t", "at_q", "ca_q", "at_t", "ca_t"))).select("pair_index", "s.*")


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs over all cores: few bytes but long work, in a number of tasks that adaptive execution leaves alone."""
    spark = pairs.sparkSession
    return pairs.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


PANEL = "struct<" + ",".join(f"`{m}`:double" for m in METRICS) + ",invalid_reasons:map<string,string>>"


@pandas_udf(PANEL)
def metric_panel(p: pd.DataFrame) -> pd.DataFrame:
    """All metrics of a pair in one pass over its path: columns steps, lq, lt, codes_q, codes_t, ca_q, ok_q, ca_t, ok_t.

    One superposition serves RMSD and both TM-scores. invalid_reasons says why a value is null.
    """
    rows = []
    for r in p.itertuples(index=False):
        steps = r.steps if r.steps is not None else []
        q = np.array([s["query_index"] for s in steps], np.int64)
        t = np.array([s["target_index"] for s in steps], np.int64)
        place = lambda v: None if v is None else np.asarray(v, np.float64).reshape(-1, 3)
        seen = lambda v: None if v is None else np.asarray(v).astype(int) == 1
        out, why = geo.pair_metrics(q, t, int(r.lq), int(r.lt), r.codes_q, r.codes_t, place(r.ca_q), seen(r.ok_q), place(r.ca_t), seen(r.ok_t))
        rows.append({**out, "invalid_reasons": why})
    return pd.DataFrame(rows, columns=[*METRICS, "invalid_reasons"]).astype({m: object for m in METRICS})


def with_panel(alignments: DataFrame, proteins: DataFrame) -> DataFrame:
    """alignments with the metric panel; proteins: idx, length, and codes, ca, ca_source where known."""
    have = proteins.columns
    get = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    p = proteins.select("idx", "length", get("codes", "string").alias("codes"), get("ca", "array<double>").alias("ca"), get("ca_source", "array<int>").alias("ca_source"))
    side = lambda s: p.select(F.col("idx").alias(f"{s}_index"), F.col("length").alias(f"l{s[0]}"), F.col("codes").alias(f"codes_{s[0]}"), F.col("ca").alias(f"ca_{s[0]}"), F.col("ca_source").alias(f"ok_{s[0]}"))
    j = alignments.join(side("query"), "query_index").join(side("target"), "target_index")
    cols = ["lq", "lt", "codes_q", "codes_t", "ca_q", "ok_q", "ca_t", "ok_t"]
    panel = metric_panel(F.struct(F.col("path.steps").alias("steps"), *cols))
    return _dealt(j).withColumn("metrics", panel).drop(*cols[2:]).withColumnsRenamed({"lq": "query_length", "lt": "target_length"})


def observed(source: Column) -> Column:
    return source == 1


def knn_graph(residues: DataFrame, k: int) -> DataFrame:
    """idx, i, slot, j, d2: the k nearest observed residues of each one in its protein, itself included; ties go to the lower j."""
    from pyspark.sql import Window

    seen = residues.where("observed").select("idx", "residue_index", "x", "y", "z")
    a = seen.select("idx", F.col("residue_index").alias("i"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    b = seen.select("idx", F.col("residue_index").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    d2 = sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz") + F.lit(1e-6)
    ranked = a.join(b, "idx").withColumn("d2", d2).withColumn("slot", F.row_number().over(Window.partitionBy("idx", "i").orderBy("d2", "j")) - 1)
    return ranked.where(F.col("slot") < k).select("idx", "i", "slot", "j", "d2")


def gather(edges: DataFrame, nodes: DataFrame, value: str, missing: float = 0.0) -> DataFrame:
    """edges with the value of their neighbour j; `missing` where there is none."""
    v = nodes.select("idx", F.col("residue_index").alias("j"), F.col(value).alias("gathered"))
    return edges.join(v, ["idx", "j"], "left").withColumn("gathered", F.coalesce("gathered", F.lit(missing)))


def aggregate_messages(edges: DataFrame, value: str = "gathered", scale: float = 30.0) -> DataFrame:
    """idx, i, message: the sum over a residue's neighbours, over the scale."""
    return edges.groupBy("idx", "i").agg((F.sum(value) / scale).alias("message"))
