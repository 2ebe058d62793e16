"""Local affine alignments of many pairs at once, swept by anti-diagonals in numpy.

Cells of an anti-diagonal depend only on the two before it, so a whole batch of padded pairs moves in
step. Rows are query residues; M ends in a match, I in a query residue against a gap, D in a target
residue against a gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..model import GAP

LOW = -1e300
#: Padded cells of a batch of pairs; it bounds the traces held (1 byte a cell) and the scores (8 bytes).
BATCH_CELLS = 4_000_000
RESTART, FROM_M, FROM_I, FROM_D = 0, 1, 2, 3


@dataclass
class Path:
    query: np.ndarray
    target: np.ndarray
    score: np.ndarray

    @property
    def aligned(self) -> int:
        return int(((self.query >= 0) & (self.target >= 0)).sum())

    def spans(self) -> tuple[int, int, int, int]:
        """query start, end, target start, end of the matched residues; -1 where there are none."""
        both = (self.query >= 0) & (self.target >= 0)
        if not both.any():
            return -1, -1, -1, -1
        q, t = self.query[both], self.target[both]
        return int(q.min()), int(q.max()), int(t.min()), int(t.max())

    def as_row(self) -> dict:
        s = self.spans()
        steps = [{"query_index": a, "target_index": b, "residue_score": c} for a, b, c in zip(self.query.tolist(), self.target.tolist(), self.score.tolist(), strict=True)]
        return {"steps": steps, "aligned_pairs": self.aligned, "query_start": s[0], "query_end": s[1], "target_start": s[2], "target_end": s[3]}


def batches(lengths: list[tuple[int, int]], cells: int = BATCH_CELLS) -> Iterator[list[int]]:
    """Numbers of pairs that are swept together: of like sizes, `cells` padded cells at most (one larger pair alone)."""
    order = sorted(range(len(lengths)), key=lambda k: (lengths[k][0] + lengths[k][1], lengths[k]))
    group: list[int] = []
    q = t = 0
    for k in order:
        nq, nt = max(q, lengths[k][0]), max(t, lengths[k][1])
        if group and (len(group) + 1) * (nq + 1) * (nt + 1) > cells:
            yield group
            group, nq, nt = [], *lengths[k]
        group.append(k)
        q, t = nq, nt
    if group:
        yield group


def _padded(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lq = np.array([s.shape[0] for s in scores])
    lt = np.array([s.shape[1] for s in scores])
    out = np.full((len(scores), int(lq.max()), int(lt.max())), -1e30)
    for k, s in enumerate(scores):
        out[k, : s.shape[0], : s.shape[1]] = s
    return out, lq, lt


def hard_batch(scores: list[np.ndarray], gap_open: float, gap_extension: float, all_states: bool = False, paths: bool = True) -> list[tuple[float, Path | None]]:
    """Best local score and path of each pair.

    The best cell is the first in row order among the largest M (all_states: of M, then I, then D) above 0.
    Ties prefer a restart, then M, I, D; opening a gap before extending one.
    """
    if any(s.shape[0] == 0 or s.shape[1] == 0 for s in scores):
        full = [k for k, s in enumerate(scores) if s.size]
        done = dict(zip(full, hard_batch([scores[k] for k in full], gap_open, gap_extension, all_states, paths), strict=True)) if full else {}
        return [done.get(k, (0.0, _empty() if paths else None)) for k in range(len(scores))]
    s, lq, lt = _padded(scores)
    p, q, t = s.shape
    m1, i1, d1 = (np.full((p, q + 1), v) for v in (0.0, LOW, LOW))  # the diagonal before, by row
    m2, i2, d2 = m1.copy(), i1.copy(), d1.copy()
    trace = np.zeros((p, q + 1, t + 1), np.uint8) if paths else None
    best, row, col, kind = np.zeros(p), np.full(p, -1), np.full(p, -1), np.full(p, FROM_M)
    pick = np.arange(p)
    for diag in range(2, q + t + 1):
        a, b = max(1, diag - t), min(q, diag - 1)
        i = np.arange(a, b + 1)
        j = diag - i
        cell = s[:, i - 1, j - 1]
        pm, pi, pd = m2[:, a - 1 : b], i2[:, a - 1 : b], d2[:, a - 1 : b]
        top = np.maximum(np.maximum(pm, pi), np.maximum(pd, 0.0))
        io, ie = m1[:, a - 1 : b] + gap_open, i1[:, a - 1 : b] + gap_extension
        do, de = m1[:, a : b + 1] + gap_open, d1[:, a : b + 1] + gap_extension
        if paths:
            code = np.where(top == 0.0, RESTART, np.where(top == pm, FROM_M, np.where(top == pi, FROM_I, FROM_D)))
            trace[:, i, j] = (code + 4 * (ie > io) + 8 * (de > do)).astype(np.uint8)
        m, ins, dele = cell + top, np.maximum(io, ie), np.maximum(do, de)
        for state, value in ((FROM_M, m), (FROM_I, ins), (FROM_D, dele)) if all_states else ((FROM_M, m),):
            inside = value if state == FROM_M else np.where((i[None] <= lq[:, None]) & (j[None] <= lt[:, None]), value, LOW)
            k = inside.argmax(1)
            v = inside[pick, k]
            r, c = i[k], j[k]
            better = (v > best) | ((v == best) & (best > 0) & (row >= 0) & ((r < row) | ((r == row) & ((c < col) | ((c == col) & (state < kind))))))
            best, row, col, kind = np.where(better, v, best), np.where(better, r, row), np.where(better, c, col), np.where(better, state, kind)
        m2, i2, d2 = m1, i1, d1
        m1, i1, d1 = (np.full((p, q + 1), v) for v in (0.0, LOW, LOW))
        m1[:, a : b + 1], i1[:, a : b + 1], d1[:, a : b + 1] = m, ins, dele
    if not paths:
        return [(float(v), None) for v in best]
    return list(zip(best.tolist(), _walk(trace, s, row, col, kind), strict=True))


def _empty() -> Path:
    return Path(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))


def _walk(trace: np.ndarray, s: np.ndarray, row: np.ndarray, col: np.ndarray, kind: np.ndarray) -> list[Path]:
    """Paths back from the best cells; all pairs step together."""
    at, i, j, state = np.flatnonzero(row > 0), row.copy(), col.copy(), kind.copy()
    parts: list[tuple[np.ndarray, ...]] = []
    while len(at):
        r, c, k = i[at], j[at], state[at]
        code = trace[at, r, c]
        match, ins = k == FROM_M, k == FROM_I
        score = np.where(match, s[at, r - 1, c - 1], 0.0)
        parts.append((at, np.where(match | ins, r - 1, GAP), np.where(ins, GAP, c - 1), score))
        state[at] = np.where(match, code & 3, np.where(ins, np.where(code & 4, FROM_I, FROM_M), np.where(code & 8, FROM_D, FROM_M)))
        i[at] = np.where(match | ins, r - 1, r)
        j[at] = np.where(ins, c, c - 1)
        go = (state[at] != RESTART) & (i[at] > 0) & (j[at] > 0)
        at = at[go]
    out = [_empty() for _ in range(len(row))]
    if not parts:
        return out
    pair, q, t, v = (np.concatenate([x[k] for x in parts]) for k in range(4))
    order = np.argsort(pair, kind="stable")
    cut = np.searchsorted(pair[order], np.arange(len(row) + 1))
    for k in range(len(row)):
        own = order[cut[k] : cut[k + 1]][::-1]
        out[k] = Path(q[own].astype(np.int32), t[own].astype(np.int32), v[own])
    return out


def _lse(*terms: np.ndarray) -> np.ndarray:
    top = np.maximum.reduce(terms)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(sum(np.exp(x - safe) for x in terms))


def soft_batch(scores: list[np.ndarray], gap_open: float, gap_extension: float, temperature: float = 1.0, posteriors: bool = True) -> list[tuple[float, np.ndarray | None]]:
    """log Z at the temperature, over all local alignments and the empty one, and match posteriors of each pair.

    Gaps never open at the border. Everything is in double precision and in units of the temperature.
    """
    if not (temperature > 0 and np.isfinite(temperature)):
        raise ValueError("temperature must be positive and finite")
    if any(s.shape[0] == 0 or s.shape[1] == 0 for s in scores):
        full = [k for k, s in enumerate(scores) if s.size]
        done = dict(zip(full, soft_batch([scores[k] for k in full], gap_open, gap_extension, temperature, posteriors), strict=True)) if full else {}
        return [done.get(k, (0.0, np.zeros(scores[k].shape) if posteriors else None)) for k in range(len(scores))]
    s, lq, lt = _padded(scores)
    s, go, ge = s / temperature, gap_open / temperature, gap_extension / temperature
    p, q, t = s.shape
    alpha = np.full((3, p, q + 2, t + 2), -np.inf)  # one row and column more, for the way back
    m, ins, dele = alpha
    diagonals = []
    for diag in range(2, q + t + 1):
        i = np.arange(max(1, diag - t), min(q, diag - 1) + 1)
        diagonals.append((i, diag - i))
    for i, j in diagonals:
        m[:, i, j] = s[:, i - 1, j - 1] + _lse(m[:, i - 1, j - 1], ins[:, i - 1, j - 1], dele[:, i - 1, j - 1], np.zeros((p, len(i))))
        ins[:, i, j] = _lse(m[:, i - 1, j] + go, ins[:, i - 1, j] + ge)
        dele[:, i, j] = _lse(m[:, i, j - 1] + go, dele[:, i, j - 1] + ge)
    inside = (np.arange(q + 2)[None, :, None] <= lq[:, None, None]) & (np.arange(t + 2)[None, None, :] <= lt[:, None, None])
    alpha[:, ~inside] = -np.inf
    flat = alpha.transpose(1, 0, 2, 3).reshape(p, -1)
    top = np.maximum(flat.max(1), 0.0)
    log_z = top + np.log(np.exp(flat - top[:, None]).sum(1) + np.exp(-top))
    if not posteriors:
        return [(float(v) * temperature, None) for v in log_z]
    beta = np.exp(alpha - log_z[None, :, None, None])
    bm, bi, bd = beta

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(whole), np.exp(part - whole), 0.0)

    for i, j in reversed(diagonals):
        step = np.where((i < q) & (j < t), s[:, np.minimum(i, q - 1), np.minimum(j, t - 1)], -np.inf)
        for mine, b in ((m, bm), (ins, bi), (dele, bd)):
            b[:, i, j] += bm[:, i + 1, j + 1] * share(mine[:, i, j] + step, m[:, i + 1, j + 1])
        bm[:, i, j] += bi[:, i + 1, j] * share(m[:, i, j] + go, ins[:, i + 1, j]) + bd[:, i, j + 1] * share(m[:, i, j] + go, dele[:, i, j + 1])
        bi[:, i, j] += bi[:, i + 1, j] * share(ins[:, i, j] + ge, ins[:, i + 1, j])
        bd[:, i, j] += bd[:, i, j + 1] * share(dele[:, i, j] + ge, dele[:, i, j + 1])
    return [(float(log_z[k]) * temperature, np.clip(bm[k, 1 : lq[k] + 1, 1 : lt[k] + 1], 0.0, 1.0)) for k in range(p)]


def consensus(scores: np.ndarray, posteriors: np.ndarray, threshold: float = 0.5) -> Path:
    """Cells with a posterior above the threshold, in row order; no gap steps."""
    i, j = np.nonzero(posteriors > threshold)
    return Path(i.astype(np.int32), j.astype(np.int32), scores[i, j])


def align(pairs: list[tuple[np.ndarray, np.ndarray]], mode: str, hard: tuple[float, float], soft: tuple[float, float], temperature: float = 1.0, paths: bool = True) -> list[tuple[float, float | None, Path | None]]:
    """(raw score, soft score, path) of pairs of embeddings: dot products, then hard, soft or both.

    hard: best score, no soft one; soft: log Z as both, consensus path; both: hard path and score, and log Z.
    """
    from . import strips

    if mode not in ("hard", "soft", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    out: list[tuple[float, float | None, Path | None]] = [(0.0, None, None)] * len(pairs)
    sizes = [(len(a), len(b)) for a, b in pairs]
    limit = BATCH_CELLS if mode == "hard" else BATCH_CELLS // 8
    for group in batches(sizes, limit):
        k = group[0]
        if (sizes[k][0] + 1) * (sizes[k][1] + 1) > limit:  # alone: in strips, as its matrices may not fit
            best, path = strips.hard_pair(*pairs[k], *hard, paths=paths) if mode != "soft" else (0.0, None)
            log_z, likely = strips.soft_pair(*pairs[k], *soft, temperature, paths and mode == "soft") if mode != "hard" else (None, None)
            out[k] = (log_z, log_z, likely) if mode == "soft" else (best, log_z, path)
            continue
        scores = [pairs[k][0] @ pairs[k][1].T for k in group]
        hards = hard_batch(scores, *hard, paths=paths) if mode != "soft" else None
        softs = soft_batch(scores, *soft, temperature, posteriors=paths and mode == "soft") if mode != "hard" else None
        for n, k in enumerate(group):
            if mode == "hard":
                out[k] = (hards[n][0], None, hards[n][1])
            elif mode == "both":
                out[k] = (hards[n][0], softs[n][0], hards[n][1])
            else:
                out[k] = (softs[n][0], softs[n][0], consensus(scores[n], softs[n][1]) if paths else None)
    return out
