"""Sequence design from backbones: an autoregressive decoder over the residue graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AMINO, DESIGN_ALPHABET, MISSING, InvalidArgument
from .encoders import DESIGN, GraphShape, Weights, _dense, _norm, encode_graph, gelu, layer_norm, linear, synthetic_graph_weights

MASK64 = (1 << 64) - 1


class SplitMix64:
    """The published splitmix64 generator."""

    def __init__(self, seed: int):
        self.state = seed & MASK64

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK64
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK64
        return z ^ (z >> 31)

    def uniform(self) -> float:
        return (self.next() >> 11) / float(1 << 53)

    def normal(self) -> float:
        """Box-Muller, the cosine branch."""
        u = max(self.uniform(), 1e-300)
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self.uniform())


def decode_order(mask: np.ndarray, seed: int, how: str | list[int] = "random") -> np.ndarray:
    """Residues in the order they are decoded: by (mask + 1e-4) |normal|, from N to C, or as given."""
    n = len(mask)
    if how == "n_to_c":
        return np.arange(n)
    if how == "random":
        r = SplitMix64(seed)
        return np.argsort([(m + 1e-4) * abs(r.normal()) for m in mask], kind="stable")
    order = np.asarray(how, int)
    if sorted(order.tolist()) != list(range(n)):
        raise InvalidArgument("a decode order must hold each residue once")
    return order


def causal_masks(order: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(decoded before, not yet) for each residue's neighbours."""
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    before = rank[near] < rank[:, None]
    return before.astype(float), (~before).astype(float)


def synthetic_design_weights(shape: GraphShape = DESIGN, seed: int = 0, decoder_layers: int = 3) -> Weights:
    w = synthetic_graph_weights(shape, seed)
    rng, h = np.random.default_rng(seed + 1), shape.hidden
    w["sequence.weight"] = rng.standard_normal((len(DESIGN_ALPHABET), h)).astype(np.float32)
    for k in range(decoder_layers):
        for name, out, inn in (("w1", h, 4 * h), ("w2", h, h), ("w3", h, h), ("ffn.in", 4 * h, h), ("ffn.out", h, 4 * h)):
            _dense(rng, w, f"decoder.{k}.{name}", out, inn)
        for n in (1, 2):
            _norm(w, f"decoder.{k}.norm{n}", h)
    _dense(rng, w, "logits", len(DESIGN_ALPHABET), h)
    return w


def _decoder_layer(h: np.ndarray, context: np.ndarray, mask: np.ndarray, w: Weights, name: str, scale: float) -> np.ndarray:
    x = np.concatenate([np.broadcast_to(h[:, None], (*context.shape[:2], h.shape[1])), context], -1)
    m = linear(gelu(linear(gelu(linear(x, w, f"{name}.w1")), w, f"{name}.w2")), w, f"{name}.w3")
    h = layer_norm(h + m.sum(1) / scale, w, f"{name}.norm1")
    return layer_norm(h + linear(gelu(linear(h, w, f"{name}.ffn.in")), w, f"{name}.ffn.out"), w, f"{name}.norm2") * mask[:, None]


def _layers(w: Weights) -> int:
    return sum(1 for k in w if k.startswith("decoder.") and k.endswith(".w1.weight"))


def log_softmax(x: np.ndarray) -> np.ndarray:
    m = x.max(-1, keepdims=True)
    return x - m - np.log(np.exp(x - m).sum(-1, keepdims=True))


def pick(logits: np.ndarray, temperature: float, r: SplitMix64) -> int:
    """The first largest logit if the temperature isn't positive, else a draw from the softmax."""
    if temperature <= 0:
        return int(logits.argmax())
    p = np.exp(log_softmax(logits / temperature))
    return int(min(np.searchsorted(np.cumsum(p), r.uniform() * p.sum(), "right"), len(p) - 1))


def decode(h: np.ndarray, e: np.ndarray, near: np.ndarray, mask: np.ndarray, order: np.ndarray, w: Weights, shape: GraphShape, choose) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, log-probabilities [L, 21]); choose(residue, logits) gives a residue's token, in decode order."""
    n, layers = len(h), _layers(w)
    before, after = causal_masks(order, near)
    attend = mask[near] * mask[:, None]
    before, after = before * attend, after * attend
    tokens, logp = np.zeros(n, int), np.zeros((n, len(DESIGN_ALPHABET)))
    seq = np.zeros((n, shape.hidden))
    stack = [h] + [np.zeros_like(h) for _ in range(layers)]
    for i in order.tolist():
        nb, one = near[i : i + 1], slice(i, i + 1)
        only = np.concatenate([e[one], np.zeros_like(e[one]), h[nb]], -1) * after[one][..., None]
        for k in range(layers):
            aware = np.concatenate([e[one], seq[nb], stack[k][nb]], -1) * before[one][..., None]
            stack[k + 1][one] = _decoder_layer(stack[k][one], aware + only, mask[one], w, f"decoder.{k}", shape.message_scale)
        logits = linear(stack[-1][one], w, "logits")[0]
        logp[i] = log_softmax(logits)
        tokens[i] = choose(i, logits)
        seq[i] = w["sequence.weight"][tokens[i]]
    return tokens, logp


def noised(xyz: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    """Coordinates with Gaussian noise, from numpy's own seeded generator."""
    return xyz if sigma <= 0 else xyz + sigma * np.random.default_rng(seed).standard_normal(xyz.shape)


def score(logp: np.ndarray, tokens: np.ndarray, mask: np.ndarray) -> float | None:
    """Mean negative log-probability of the tokens over the residues of the mask."""
    return float(-(logp[np.arange(len(tokens)), tokens] * mask).sum() / mask.sum()) if mask.sum() else None


def recovery(tokens: np.ndarray, native: str) -> float | None:
    """Share of standard native residues that the tokens have."""
    known = [(DESIGN_ALPHABET[t], c) for t, c in zip(tokens, native, strict=True) if c in AMINO]
    return sum(a == b for a, b in known) / len(known) if known else None


def design_one(xyz: np.ndarray, source: np.ndarray, native: str, w: Weights, shape: GraphShape = DESIGN, seed: int = 0, temperature: float = 0.1, order: str | list[int] = "random", noise: float = 0.0, given: str | None = None) -> dict:
    """One sampled sequence, or the scores of a given one (its residues are fed in place of samples)."""
    mask = (source[:, 1] != MISSING).astype(float)
    h, e, near = encode_graph(noised(xyz, noise, seed), source, w, shape, attend=True)
    steps = decode_order(mask, seed, order)
    r = SplitMix64(seed)
    fixed = None if given is None else np.array([DESIGN_ALPHABET.find(c) if c in DESIGN_ALPHABET else len(AMINO) for c in given])
    tokens, logp = decode(h, e, near, mask, steps, w, shape, (lambda i, z: pick(z, temperature, r)) if fixed is None else (lambda i, z: int(fixed[i])))
    return {"sequence": "".join(DESIGN_ALPHABET[t] for t in tokens), "score": score(logp, tokens, mask), "recovery": recovery(tokens, native), "decode_order": steps.tolist(), "log_probs": logp}


DESIGNS = "input_id string, sample int, seed long, temperature double, sequence string, score double, recovery double, decode_order array<int>, log_probs array<array<float>>"


def design(structures: DataFrame, weights: Weights, num_seqs: int = 1, seed: int = 0, temperature: float = 0.1, order: str = "random", noise: float = 0.0, log_probs: bool = False, shape: GraphShape = DESIGN) -> DataFrame:
    """num_seqs designs of each structure (input_id, codes, xyz, sources): a row a sample, sample k with seed + k.

    Samples are rows of their own before the decoder runs, so one structure's samples spread over tasks.
    """
    if num_seqs < 1:
        raise InvalidArgument("num_seqs must be positive")
    known = structures.sparkSession.sparkContext.broadcast(weights)
    each = structures.select("input_id", "codes", "xyz", "sources", F.explode(F.sequence(F.lit(0), F.lit(num_seqs - 1))).alias("sample"))
    parts = max(1, each.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                d = design_one(np.asarray(r.xyz, float).reshape(-1, 5, 3), np.asarray(r.sources, int).reshape(-1, 5), r.codes, known.value, shape, seed + r.sample, temperature, order, noise)
                rows.append((r.input_id, r.sample, seed + r.sample, temperature, d["sequence"], d["score"], d["recovery"], d["decode_order"], d["log_probs"].astype(np.float32).tolist() if log_probs else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DESIGNS.split(", ")])

    return each.repartition(parts, "input_id", "sample").mapInPandas(run, DESIGNS)
