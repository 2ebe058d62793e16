"""Queries over a pair too large for whole matrices: their rows, and the memory that Python workers take for them."""

from __future__ import annotations

from pathlib import Path
from threading import Event, Thread

import numpy as np
import psutil
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkfold import queries as qs
from sparkfold.functions import geometry as geo
from sparkfold.functions.align import Path as Aligned
from sparkfold.functions.align import hard_batch, soft_batch
from sparkfold.functions.lazy import LazyUDF
from sparkfold.model import AMINO

#: Residues of four proteins: one pair has 9 million cells, 72 MB of scores.
LENGTHS = (3000, 3000, 40, 30)
#: MB that a worker may grow by; whole matrices of the large pair take more.
MOST_MB = 100


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """(folder, embeddings, vec_ids by label): proteins whose alignments are long."""
    rng = np.random.default_rng(17)
    label = rng.permutation(np.repeat(np.arange(4), LENGTHS))
    v = rng.normal(0.2, 1, (len(label), 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = tmp_path_factory.mktemp("large")
    pq.write_table(pa.table({"vec_id": np.arange(len(label)), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": label.astype(np.int32)}), out / "embeddings.parquet")
    at = [np.flatnonzero(label == k) for k in range(4)]
    return str(out), [v[a].astype(np.float64) for a in at], at


PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


@pytest.fixture(scope="module")
def hard(table):
    """(score, path) of each pair, from whole matrices."""
    return [hard_batch([table[1][a] @ table[1][b].T], qs.HARD.hard.open, qs.HARD.hard.extension)[0] for a, b in PAIRS]


def codes(table, k: int) -> str:
    return "".join(AMINO[i % 20] for i in table[2][k])


def panel(table, a: int, b: int, path: Aligned) -> dict:
    """All metrics of a path by the kernel of one pair."""
    ca, seen = [10 * table[1][k][:, :3] for k in (a, b)], [table[2][k] % 17 != 0 for k in (a, b)]
    return geo.pair_metrics(path.query, path.target, LENGTHS[a], LENGTHS[b], codes(table, a), codes(table, b), ca[0], seen[0], ca[1], seen[1])[0]


def moments(table, a: int, b: int, path: Aligned) -> dict:
    both = (path.query >= 0) & (path.target >= 0)
    q, t = path.query[both], path.target[both]
    seen = (table[2][a][q] % 17 != 0) & (table[2][b][t] % 17 != 0)
    x, y = 10 * table[1][a][q[seen], :3], 10 * table[1][b][t[seen], :3]
    s = (y - y.mean(0)).T @ (x - x.mean(0))
    out = {"n": int(seen.sum())} | {f"{k}{c}": m for k, v in (("q", x), ("t", y)) for c, m in zip("xyz", v.mean(0), strict=True)}
    return out | {k: ((v - v.mean(0)) ** 2).sum() for k, v in (("qq", x), ("tt", y))} | {f"s{c}{d}": s[i, j] for i, c in enumerate("xyz") for j, d in enumerate("xyz")}


def workers(spark) -> dict[int, int]:
    """Peak resident memory, in kB, of each Python worker."""
    out = {}
    for p in psutil.Process(spark.sparkContext._gateway.proc.pid).children(recursive=True):
        try:
            if "pyspark.daemon" in " ".join(p.cmdline()) and "pyspark.daemon" in " ".join(p.parent().cmdline()):
                out[p.pid] = int(next(x for x in Path(f"/proc/{p.pid}/status").read_text().splitlines() if x.startswith("VmHWM")).split()[1])
        except (OSError, StopIteration, psutil.Error):
            pass
    return out


def rows(spark, query, table, by: str = "pair_index") -> list[dict]:
    """The query's rows over the large pair, in order; a worker that takes MOST_MB more than for a small table fails the test."""
    others, done, peaks = set(workers(spark)), Event(), {}

    def watch() -> None:
        """Workers may end before the query does."""
        while not done.wait(0.02):
            peaks.update({pid: kb for pid, kb in workers(spark).items() if pid not in others})

    watcher = Thread(target=watch)
    watcher.start()
    spark.sparkContext.environment["LARGE_PAIRS"] = query.__name__  # workers of its own, without what others have kept
    for f in vars(qs.me).values():
        if isinstance(f, LazyUDF):
            f._udf = None  # made anew, for these workers
    try:
        query(spark, "/root/testdata/sf0.001").collect()
        small = max(peaks.values())
        out = query(spark, table[0]).collect()
    finally:
        del spark.sparkContext.environment["LARGE_PAIRS"]
        done.set()
        watcher.join()
    assert max(peaks.values()) - small < MOST_MB * 1000
    return sorted((r.asDict() for r in out), key=lambda r: tuple(r[c] for c in by.split()))


def near(got: list[dict], want: list[dict], digits: int = 6) -> None:
    """Rows are equal, numbers to the query's rounding."""
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-6, abs=0.6 * 10**-digits)


def test_both_modes(spark, table, hard):
    o = qs.al.AlignOptions.of("structure-d64", "both")
    soft = [soft_batch([table[1][a] @ table[1][b].T], o.soft.open, o.soft.extension, o.temperature, posteriors=False)[0][0] for a, b in PAIRS]
    near(rows(spark, qs.both_modes, table), [{"pair_index": k, "raw_sw_score": s, "soft_sw_score": z, "aligned_pairs": p.aligned} for k, ((s, p), z) in enumerate(zip(hard, soft, strict=True))])


def test_path_steps(spark, table, hard):
    want = [{"pair_index": k, "step": n, "q": int(a), "t": int(b), "residue_score": c} for k, (_, p) in enumerate(hard) for n, (a, b, c) in enumerate(zip(p.query, p.target, p.score, strict=True))]
    assert len(want) > 2000
    near(rows(spark, qs.path_steps, table, "pair_index step"), want)


def diagonals(table, pairs: list[tuple[int, int]]) -> list[dict]:
    out = []
    for k, (a, b) in enumerate(pairs):
        at = np.arange(min(LENGTHS[a], LENGTHS[b]))
        m = panel(table, a, b, Aligned(at, at, np.zeros(len(at))))
        out.append({"pair_index": k, "aligned_pairs": len(at)} | {c: m[c] for c in ("coverage_query", "coverage_target", "coverage_mean", "identity")})
    return out


def test_score_alignment(spark, table):
    near(rows(spark, qs.score_alignment, table), diagonals(table, [(int(q[1:]), int(t[1:])) for _, q, t in qs.PAIRS]))


def test_superposition_moments(spark, table, hard):
    near(rows(spark, qs.superposition_moments, table), [{"pair_index": k} | moments(table, *PAIRS[k], p) for k, (_, p) in enumerate(hard)], 5)


def test_path_spans(spark, table, hard):
    names = ("query_start", "query_end", "target_start", "target_end")
    near(rows(spark, qs.path_spans, table), [{"pair_index": k} | dict(zip(names, p.spans(), strict=True)) for k, (_, p) in enumerate(hard)])


def test_result_rollup(spark, table, hard):
    own = [[s for (a, _), (s, _) in zip(PAIRS, hard, strict=True) if a == k] for k in range(3)]
    near(rows(spark, qs.result_rollup, table, "query_index"), [{"query_index": k, "pairs": len(s), "mean_score": np.mean(s), "best_score": max(s)} for k, s in enumerate(own)])


def test_score_alignment_all(spark, table):
    near(rows(spark, qs.score_alignment_all, table), diagonals(table, [(a, b) for a in range(4) for b in range(a, 4)]))


def test_coverage(spark, table, hard):
    names = ("coverage_query", "coverage_target", "coverage_mean")
    near(rows(spark, qs.coverage, table), [{"pair_index": k} | {c: panel(table, *PAIRS[k], p)[c] for c in names} for k, (_, p) in enumerate(hard)])


def test_rmsd(spark, table, hard):
    near(rows(spark, qs.rmsd, table), [{"pair_index": k, "rmsd": panel(table, *PAIRS[k], p)["rmsd"]} for k, (_, p) in enumerate(hard)], 5)


def test_tm_score(spark, table, hard):
    names = ("tm_score_query", "tm_score_target")
    near(rows(spark, qs.tm_score, table), [{"pair_index": k} | {c: panel(table, *PAIRS[k], p)[c] for c in names} for k, (_, p) in enumerate(hard)], 5)


def test_gapped_fasta(spark, table, hard):
    def record(k: int, places: np.ndarray) -> str:
        own = codes(table, k)
        letters = "".join("-" if i < 0 else own[i] for i in places)
        return f">p{k}\n" + "\n".join(letters[n : n + 80] for n in range(0, len(letters), 80)) + "\n"

    want = [{"pair_index": k, "name": f"p{a}__p{b}", "fasta": record(a, p.query) + record(b, p.target)} for k, ((a, b), (_, p)) in enumerate(zip(PAIRS, hard, strict=True))]
    assert rows(spark, qs.gapped_fasta, table) == want


def test_hard_alignment_positive_extension(spark, table):
    found = [hard_batch([table[1][a] @ table[1][b].T], qs.POSITIVE.hard.open, qs.POSITIVE.hard.extension)[0] for a, b in PAIRS]
    near(rows(spark, qs.hard_alignment_positive_extension, table), [{"pair_index": k, "raw_sw_score": s, "aligned_pairs": p.aligned} for k, (s, p) in enumerate(found)])


def test_length_normalised_scores(spark, table, hard):
    near(rows(spark, qs.length_normalised_scores, table), [{"pair_index": k, "sw_per_query_len": s / LENGTHS[a], "sw_per_target_len": s / LENGTHS[b], "sw_per_aligned": s / p.aligned} for k, ((a, b), (s, p)) in enumerate(zip(PAIRS, hard, strict=True))])


def test_identity(spark, table, hard):
    near(rows(spark, qs.identity, table), [{"pair_index": k, "identity": panel(table, *PAIRS[k], p)["identity"]} for k, (_, p) in enumerate(hard)])
