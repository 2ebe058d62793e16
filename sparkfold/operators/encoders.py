"""Structure and sequence encoders in numpy, one protein a call, over a table of named weights.

No published weights come with this package: callers bring a weights table, or seeded synthetic ones
of the right shapes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import geometry as geo
from ..model import MISSING, START_TOKEN, STOP_TOKEN, InvalidArgument

EPSILON = 1e-5
#: Residues whose edges are worked on at once.
ROWS = 128
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class GraphShape:
    """Sizes of a graph encoder: the 64-wide scoring encoder, or the 128-wide one of the designer."""

    hidden: int = 64
    neighbours: int = 64
    layers: int = 3
    message_scale: float = 30.0
    edges: int = 16 + 25 * geo.RBF_COUNT
    update_last_edges: bool = False


@dataclass(frozen=True)
class SequenceShape:
    width: int = 320
    heads: int = 20
    layers: int = 6
    inner: int = 1280
    vocabulary: int = 29


STRUCTURE, DESIGN, SEQUENCE = GraphShape(), GraphShape(128, 48, update_last_edges=True), SequenceShape()


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    y = x @ w[f"{name}.weight"].T.astype(np.float64)
    return y + w[f"{name}.bias"] if f"{name}.bias" in w else y


def layer_norm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    m = x.mean(-1, keepdims=True)
    v = ((x - m) ** 2).mean(-1, keepdims=True)
    return (x - m) / np.sqrt(v + EPSILON) * w[f"{name}.weight"] + w[f"{name}.bias"]


def erf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _dense(rng: np.random.Generator, w: Weights, name: str, out: int, inn: int, bias: bool = True) -> None:
    w[f"{name}.weight"] = (rng.standard_normal((out, inn)) / math.sqrt(inn)).astype(np.float32)
    if bias:
        w[f"{name}.bias"] = np.zeros(out, np.float32)


def _norm(w: Weights, name: str, width: int) -> None:
    w[f"{name}.weight"], w[f"{name}.bias"] = np.ones(width, np.float32), np.zeros(width, np.float32)


def synthetic_graph_weights(shape: GraphShape = STRUCTURE, seed: int = 0) -> Weights:
    rng, w, h = np.random.default_rng(seed), {}, shape.hidden
    _dense(rng, w, "positions", 16, 66)
    _dense(rng, w, "edges", h, shape.edges, bias=False)
    _norm(w, "edges.norm", h)
    _dense(rng, w, "edges.out", h, h)
    for k in range(shape.layers):
        for name, out, inn in (("w1", h, 3 * h), ("w2", h, h), ("w3", h, h), ("w11", h, 3 * h), ("w12", h, h), ("w13", h, h), ("ffn.in", 4 * h, h), ("ffn.out", h, 4 * h)):
            _dense(rng, w, f"layers.{k}.{name}", out, inn)
        for n in (1, 2, 3):
            _norm(w, f"layers.{k}.norm{n}", h)
    return w


def synthetic_sequence_weights(shape: SequenceShape = SEQUENCE, seed: int = 0) -> Weights:
    rng, w = np.random.default_rng(seed), {}
    w["embed.weight"] = rng.standard_normal((shape.vocabulary, shape.width)).astype(np.float32)
    for k in range(shape.layers):
        for name in ("q", "k", "v", "out"):
            _dense(rng, w, f"layers.{k}.{name}", shape.width, shape.width)
        _dense(rng, w, f"layers.{k}.ffn.in", shape.inner, shape.width)
        _dense(rng, w, f"layers.{k}.ffn.out", shape.width, shape.inner)
        _norm(w, f"layers.{k}.norm1", shape.width)
        _norm(w, f"layers.{k}.norm2", shape.width)
    _norm(w, "norm", shape.width)
    return w


def edge_rows(xyz: np.ndarray, source: np.ndarray, w: Weights, near: np.ndarray, rows: slice, chain: np.ndarray | None = None) -> np.ndarray:
    """[rows, K, 416] features of the edges of some residues."""
    i, near = np.arange(len(xyz))[rows, None], near[rows]
    same = True if chain is None else chain[i] == chain[near]
    position = w["positions.weight"].T[geo.positional_class(i, near, same)] + w["positions.bias"]
    d = geo.atom_pair_distances(xyz, source, near, rows)
    return np.concatenate([position, geo.rbf(d).reshape(*near.shape, -1)], -1)


def blocks(n: int, rows: int = ROWS) -> list[slice]:
    return [slice(at, min(at + rows, n)) for at in range(0, n, rows)]


def graph_layer(h: np.ndarray, e: np.ndarray, near: np.ndarray, mask: np.ndarray, w: Weights, name: str, shape: GraphShape, update_edges: bool, attend: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Messages over edges, a feed-forward step, and new edges (in place) from the new nodes; residuals are normed after the sum.

    Edges are taken by blocks of residues, so that only `e` itself grows with the protein.
    """

    def mlp(names: tuple[str, str, str], b: slice) -> np.ndarray:
        x = np.concatenate([np.broadcast_to(h[b, None], e[b].shape), e[b], h[near[b]]], -1)
        return linear(gelu(linear(gelu(linear(x, w, f"{name}.{names[0]}")), w, f"{name}.{names[1]}")), w, f"{name}.{names[2]}")

    told = np.empty_like(h)
    for b in blocks(len(h)):
        m = mlp(("w1", "w2", "w3"), b)
        if attend is not None:
            m = m * attend[b][..., None]
        told[b] = m.sum(1)
    h = layer_norm(h + told / shape.message_scale, w, f"{name}.norm1")
    h = layer_norm(h + linear(gelu(linear(h, w, f"{name}.ffn.in")), w, f"{name}.ffn.out"), w, f"{name}.norm2")
    h = h * mask[:, None]
    if update_edges:
        for b in blocks(len(h)):
            e[b] = layer_norm(e[b] + mlp(("w11", "w12", "w13"), b), w, f"{name}.norm3")
    return h, e


def encode_graph(xyz: np.ndarray, source: np.ndarray, w: Weights, shape: GraphShape = STRUCTURE, attend: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, edges, neighbours) of a structure [L, 5, 3]; nodes without a CA are zero."""
    if not len(xyz):
        raise InvalidArgument("an empty structure can't be encoded")
    near, _ = geo.knn(xyz[:, 1], source[:, 1] != MISSING, min(shape.neighbours, len(xyz)))
    e = np.empty((*near.shape, shape.hidden))
    for b in blocks(len(xyz)):
        e[b] = linear(layer_norm(linear(edge_rows(xyz, source, w, near, b), w, "edges"), w, "edges.norm"), w, "edges.out")
    mask = (source[:, 1] != MISSING).astype(float)
    h = np.zeros((len(xyz), shape.hidden))
    both = mask[:, None] * mask[near] if attend else None
    for k in range(shape.layers):
        h, e = graph_layer(h, e, near, mask, w, f"layers.{k}", shape, shape.update_last_edges or k + 1 < shape.layers, both)
    return h, e, near


def rotate(x: np.ndarray) -> np.ndarray:
    """Rotary positions: the halves of a head turn by the position over 10000^(2 d / width)."""
    n, width = x.shape[-2:]
    angle = np.arange(n)[:, None] / 10000.0 ** (2 * np.arange(width // 2) / width)
    a, b = x[..., : width // 2], x[..., width // 2 :]
    return np.concatenate([a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)], -1)


def attention(x: np.ndarray, w: Weights, name: str, heads: int, mask: np.ndarray | None = None) -> np.ndarray:
    split = lambda y: y.reshape(len(x), heads, -1).transpose(1, 0, 2)
    q, k, v = (split(linear(x, w, f"{name}.{p}")) for p in "qkv")
    s = rotate(q) @ rotate(k).transpose(0, 2, 1) / math.sqrt(q.shape[-1])
    if mask is not None:
        s = np.where(mask[None, None], s, -np.inf)
    return linear((softmax(s) @ v).transpose(1, 0, 2).reshape(len(x), -1), w, f"{name}.out")


def encode_tokens(tokens: np.ndarray, w: Weights, shape: SequenceShape = SEQUENCE) -> np.ndarray:
    """Rows for the residues of a token sequence; start and stop are put around it and dropped again."""
    if not len(tokens):
        raise InvalidArgument("an empty sequence can't be encoded")
    x = w["embed.weight"][np.concatenate([[START_TOKEN], tokens, [STOP_TOKEN]])].astype(np.float64)
    for k in range(shape.layers):
        n = f"layers.{k}"
        x = x + attention(layer_norm(x, w, f"{n}.norm1"), w, n, shape.heads)
        x = x + linear(gelu(linear(layer_norm(x, w, f"{n}.norm2"), w, f"{n}.ffn.in")), w, f"{n}.ffn.out")
    return layer_norm(x, w, "norm")[1:-1]


_OUT = "length int, dim int, embedding array<float>"


def _encoded(frame: DataFrame, columns: list[str], one) -> DataFrame:
    others = [c for c in frame.columns if c not in ("length", "dim", "embedding")]
    kinds = dict(frame.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(*r) for r in zip(*(pdf[c] for c in columns), strict=True)]
            out = pdf[others].copy()
            out["length"], out["dim"], out["embedding"] = [len(r) for r in rows], [r.shape[1] for r in rows], [r.astype(np.float32).ravel() for r in rows]
            yield out

    return frame.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), _OUT]))


def encode_structures(structures: DataFrame, weights: Weights, shape: GraphShape = STRUCTURE) -> DataFrame:
    """structures (xyz flat, sources flat) with length, dim, embedding; the weights are broadcast once."""
    known = structures.sparkSession.sparkContext.broadcast(weights)
    # few bytes but long work: dealt out, in a number that adaptive execution leaves alone
    structures = structures.repartition(2 * structures.sparkSession.sparkContext.defaultParallelism)
    return _encoded(structures, ["xyz", "sources"], lambda x, s: encode_graph(np.asarray(x, float).reshape(-1, 5, 3), np.asarray(s, int).reshape(-1, 5), known.value, shape)[0])


def encode_sequences(sequences: DataFrame, weights: Weights, shape: SequenceShape = SEQUENCE) -> DataFrame:
    """sequences (tokens) with length, dim, embedding."""
    known = sequences.sparkSession.sparkContext.broadcast(weights)
    return _encoded(sequences, ["tokens"], lambda t: encode_tokens(np.asarray(t, int), known.value, shape))
