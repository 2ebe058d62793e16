"""Named SQL functions over the kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import PATH
from . import geometry as geo
from .align import align
from .lazy import pandas_udf

RAISED = {k: k - 32 for k in range(97, 123)}
_ALIGNED = f"struct<raw_sw_score:double,soft_sw_score:double,path:{PATH}>"


def _pairs(qv: pd.Series, ql: pd.Series, tv: pd.Series, tl: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(a, float).reshape(n, -1), np.asarray(b, float).reshape(m, -1)) for a, n, b, m in zip(qv, ql, tv, tl, strict=True)]


@pandas_udf(_ALIGNED)
def sw_align(qv: pd.Series, ql: pd.Series, tv: pd.Series, tl: pd.Series, gap_open: pd.Series, gap_extension: pd.Series) -> pd.DataFrame:
    """Hard alignment of embeddings (flat values and length of each); the gaps are those of a batch's first row of each value."""
    out: list = [None] * len(qv)
    pairs = _pairs(qv, ql, tv, tl)
    for gaps in sorted(set(zip(gap_open, gap_extension, strict=True))):
        own = [k for k, g in enumerate(zip(gap_open, gap_extension, strict=True)) if g == gaps]
        for k, r in zip(own, align([pairs[k] for k in own], "hard", gaps, gaps), strict=True):
            out[k] = {"raw_sw_score": r[0], "soft_sw_score": None, "path": r[2].as_row()}
    return pd.DataFrame(out)


@pandas_udf("double")
def soft_sw(qv: pd.Series, ql: pd.Series, tv: pd.Series, tl: pd.Series, gap_open: pd.Series, gap_extension: pd.Series, temperature: pd.Series) -> pd.Series:
    """log Z of embeddings."""
    pairs = _pairs(qv, ql, tv, tl)
    return pd.Series([align([p], "soft", (o, e), (o, e), t, paths=False)[0][0] for p, o, e, t in zip(pairs, gap_open, gap_extension, temperature, strict=True)])


@pandas_udf("double")
def kabsch_rmsd(moving: pd.Series, fixed: pd.Series) -> pd.Series:
    """RMSD of matched points (flat x, y, z) after superposition; null below three."""
    rows = [(np.asarray(a, float).reshape(-1, 3), np.asarray(b, float).reshape(-1, 3)) for a, b in zip(moving, fixed, strict=True)]
    return pd.Series([geo.superpose(a, b)[2] if len(a) >= 3 else None for a, b in rows], dtype="Float64")


@pandas_udf("double")
def lddt(query: pd.Series, target: pd.Series) -> pd.Series:
    """Symmetric lDDT of matched points, residue by residue."""
    out = []
    for a, b in zip(query, target, strict=True):
        x, y = np.asarray(a, float).reshape(-1, 3), np.asarray(b, float).reshape(-1, 3)
        k = np.arange(len(x))
        out.append(geo.lddt(x, np.ones(len(x), bool), y, np.ones(len(y), bool), k, k)["lddt"])
    return pd.Series(out, dtype="Float64")


@pandas_udf("array<int>")
def tokenize_aa(text: pd.Series) -> pd.Series:
    from ..model import AMBIGUOUS, AMBIGUOUS_TOKEN, AMINO, OTHER_TOKEN

    token = lambda c: AMINO.find(c) if c in AMINO else AMBIGUOUS_TOKEN if c in AMBIGUOUS else OTHER_TOKEN
    return text.map(lambda s: None if s is None else [token(c) for c in s.translate(RAISED) if c not in "-*" and not c.isspace()])


class AlignmentSteps:
    """A row for each step of a hard alignment of two embeddings."""

    def eval(self, qv, ql, tv, tl, gap_open, gap_extension):
        pair = (np.asarray(qv, float).reshape(ql, -1), np.asarray(tv, float).reshape(tl, -1))
        path = align([pair], "hard", (float(gap_open), float(gap_extension)), (0.0, 0.0))[0][2]
        for k, row in enumerate(zip(path.query.tolist(), path.target.tolist(), path.score.tolist(), strict=True)):
            yield k, *row


def register(spark: SparkSession) -> list[str]:
    """Registers the functions in a session and returns their names."""
    for name, f in (("sw_align", sw_align), ("soft_sw", soft_sw), ("kabsch_rmsd", kabsch_rmsd), ("lddt", lddt), ("tokenize_aa", tokenize_aa)):
        spark.udf.register(name, f.udf)
    spark.udtf.register("alignment_steps", F.udtf(AlignmentSteps, returnType="step int, query_index int, target_index int, residue_score double"))
    return ["sw_align", "soft_sw", "kabsch_rmsd", "lddt", "tokenize_aa", "alignment_steps"]
