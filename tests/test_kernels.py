"""Alignment, geometry and model kernels against plain versions and values worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sparkfold import model
from sparkfold.functions import geometry as geo
from sparkfold.functions.align import align, batches, consensus, hard_batch, soft_batch
from sparkfold.operators import design, encoders

RNG = np.random.default_rng(7)


def plain(s, go, ge):
    """Best M score of the recurrence, cell by cell."""
    q, t = s.shape
    m, i, d = np.zeros((q + 1, t + 1)), np.full((q + 1, t + 1), -1e300), np.full((q + 1, t + 1), -1e300)
    best = 0.0
    for a in range(1, q + 1):
        for b in range(1, t + 1):
            m[a, b] = s[a - 1, b - 1] + max(0, m[a - 1, b - 1], i[a - 1, b - 1], d[a - 1, b - 1])
            i[a, b] = max(m[a - 1, b] + go, i[a - 1, b] + ge)
            d[a, b] = max(m[a, b - 1] + go, d[a, b - 1] + ge)
            best = max(best, m[a, b])
    return best


@pytest.mark.parametrize("gaps", [(-1.4, -0.15), (-1.01982, 0.225736), (-2.0, -1.0)])
def test_hard_scores_and_paths(gaps):
    scores = [RNG.normal(0, 1, (RNG.integers(1, 12), RNG.integers(1, 12))).round(1) for _ in range(120)]
    for s, (best, path) in zip(scores, hard_batch(scores, *gaps), strict=True):
        assert best == pytest.approx(plain(s, *gaps))
        total, before = 0.0, None
        for q, t, v in zip(path.query, path.target, path.score, strict=True):
            kind = "M" if q >= 0 and t >= 0 else "I" if q >= 0 else "D"
            total += v if kind == "M" else gaps[1] if kind == before else gaps[0]
            assert {kind, before} != {"I", "D"}  # gaps of different kinds never touch
            before = kind
        assert total == pytest.approx(best)
        assert not len(path.query) or before == "M"


def test_ties_restart_and_take_the_first_cell():
    s = np.array([[1.0, -5, 1.0], [-5, -5, -5], [1.0, -5, 1.0]])
    best, path = hard_batch([s], -3, -3)[0]
    assert best == 1 and path.query.tolist() == [0] and path.target.tolist() == [0]
    s = np.array([[0.0, 0], [0, 2.0]])
    best, path = hard_batch([s], -1, -1)[0]
    assert best == 2 and path.query.tolist() == [1]  # a score of 0 before it restarts


def test_nothing_above_zero_is_an_empty_path():
    best, path = hard_batch([np.zeros((3, 4))], -1, -1)[0]
    assert best == 0 and path.aligned == 0 and path.spans() == (-1, -1, -1, -1)
    assert hard_batch([np.zeros((0, 4)), np.ones((1, 1))], -1, -1)[1][0] == 1


def test_identity_diagonal():
    best, path = hard_batch([np.eye(3)], -1, -1)[0]
    assert best == 3 and path.aligned == 3 and path.spans() == (0, 2, 0, 2)


def test_best_over_all_states_can_end_in_a_gap():
    s = np.array([[1.0, -9, -9, -9, -9]])
    assert hard_batch([s], -0.5, 1.0)[0][0] == 1
    best, path = hard_batch([s], -0.5, 1.0, all_states=True)[0]
    assert best == pytest.approx(3.5) and path.target.tolist() == [0, 1, 2, 3, 4] and path.query.tolist() == [0, -1, -1, -1, -1]


def test_soft_scores_sum_all_alignments():
    s = np.array([[0.3]])
    z, p = soft_batch([s], -1, -1, 1.0)[0]
    assert z == pytest.approx(math.log(1 + math.exp(0.3))) and p[0, 0] == pytest.approx(math.exp(0.3) / (1 + math.exp(0.3)))
    s = RNG.normal(0, 1, (4, 5))
    z, p = soft_batch([s], -1.0, -0.3, 0.7)[0]
    for i in range(4):
        for j in range(5):
            up, down = s.copy(), s.copy()
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            slope = (soft_batch([up], -1.0, -0.3, 0.7)[0][0] - soft_batch([down], -1.0, -0.3, 0.7)[0][0]) / 2e-5
            assert p[i, j] == pytest.approx(slope, abs=1e-6)
    cold = soft_batch([s], -1.0, -0.3, 0.01)[0][0]
    assert cold == pytest.approx(hard_batch([s], -1.0, -0.3, all_states=True)[0][0], abs=0.05) or cold <= hard_batch([s], -1.0, -0.3, all_states=True)[0][0] + 0.1


def test_batches_of_padded_pairs_agree_with_single_ones():
    scores = [RNG.normal(0, 1, (a, b)) for a, b in ((3, 9), (8, 2), (5, 5), (1, 1))]
    together, apart = hard_batch(scores, -1, -0.2), [hard_batch([s], -1, -0.2)[0] for s in scores]
    assert [x[0] for x in together] == [x[0] for x in apart]
    assert [x[1].query.tolist() for x in together] == [x[1].query.tolist() for x in apart]
    soft = soft_batch(scores, -1, -0.2)
    assert np.allclose([x[0] for x in soft], [soft_batch([s], -1, -0.2)[0][0] for s in scores])
    groups = list(batches([(100, 100)] * 10 + [(5000, 5000)], 50_000))
    assert sorted(k for g in groups for k in g) == list(range(11)) and [10] in groups


def test_consensus_and_modes():
    p = consensus(np.arange(4.0).reshape(2, 2), np.array([[0.6, 0.5], [0.1, 0.9]]))
    assert p.query.tolist() == [0, 1] and p.target.tolist() == [0, 1] and p.score.tolist() == [0, 3]
    a = RNG.normal(0, 1, (6, 4))
    hard, soft, both = (align([(a, a)], m, (-1, -0.1), (-3, -0.1))[0] for m in ("hard", "soft", "both"))
    assert hard[0] == both[0] and soft[0] == both[1] and hard[1] is None and both[2].query.tolist() == hard[2].query.tolist()
    with pytest.raises(ValueError):
        soft_batch([a], -1, -1, 0.0)


def test_superposition_and_scores():
    x = RNG.normal(0, 5, (20, 3))
    angle = 0.7
    r = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    rot, shift, rmsd = geo.superpose(x, x @ r.T + [1, 2, 3])
    assert rmsd == pytest.approx(0, abs=1e-6) and np.allclose(rot, r) and np.allclose(shift, [1, 2, 3])
    assert np.linalg.det(geo.superpose(x, x * [1, 1, -1])[0]) == pytest.approx(1)
    k = np.arange(20)
    m, why = geo.pair_metrics(k, k, 20, 40, "A" * 20, "A" * 40, x, np.ones(20, bool), np.concatenate([x, x + 50]), np.ones(40, bool))
    assert m["coverage_query"] == 1 and m["coverage_target"] == 0.5 and m["coverage_mean"] == pytest.approx(2 / 3)
    assert m["rmsd"] == pytest.approx(0, abs=1e-6) and m["tm_score_query"] == pytest.approx(1) and m["tm_score_target"] == pytest.approx(0.5) and m["lddt_byA"] == 1
    assert why == {"ecs": "Unimplemented"}


def test_missing_metrics_are_null_with_a_reason():
    q, t = np.array([0, 1, 2]), np.array([0, 1, 2])
    m, why = geo.pair_metrics(q, t, 5, 5, "AXA", "AAC")
    assert m["identity"] == 0.5 and m["rmsd"] is None and why["rmsd"] == "MissingStructureMetadata"
    x = np.zeros((3, 3))
    m, why = geo.pair_metrics(q, t, 3, 3, None, None, x, np.array([True, True, False]), x, np.ones(3, bool))
    assert why["rmsd"] == "InsufficientAlignedPairs" and why["identity"] == "MissingResidueCodes" and m["identity"] is None
    m, why = geo.pair_metrics(q, t, 3, 3, "XXX", "AAA")
    assert why["identity"] == "ZeroDenominator"


def test_neighbours_prefer_the_lower_number():
    x = np.array([[0.0, 0, 0], [1, 0, 0], [-1, 0, 0], [9, 9, 9]])
    near, d = geo.knn(x, np.array([True, True, True, False]), 6)
    assert near[0].tolist() == [0, 1, 2, 3, -1, -1] and d[0, 0] == pytest.approx(1e-6) and d[0, 4] == d[0].max()


def test_features():
    assert geo.rbf(np.array([2.0]))[0, 0] == 1 and geo.rbf(np.array([-1.0])).sum() == 0
    assert geo.positional_class(np.array([0, 99, 0]), np.array([99, 0, 0])).tolist() == [0, 64, 32]
    assert geo.tm_d0(10) == 0.5


def test_inferred_and_virtual_atoms():
    r = np.array([[0.0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    whole = geo.IDEAL @ r.T + [5, 6, 7]
    source = np.array([1, 1, 1, 0, 0])
    xyz, src = geo.infer_atoms(np.where(source[:, None] == 1, whole, 0), source, "A")
    assert np.allclose(xyz, whole, atol=1e-6) and src.tolist() == [1, 1, 1, 2, 2]
    xyz, src = geo.infer_atoms(np.where(source[:, None] == 1, whole, 0), source, "G")
    assert src.tolist() == [1, 1, 1, 2, 3] and np.allclose(xyz[4], geo.virtual_cb(*whole[:3]))
    off = whole.copy()
    off[1] += 3
    assert geo.infer_atoms(off, source, "A")[1].tolist() == [1, 1, 1, 0, 0]
    assert geo.infer_atoms(whole, np.array([1, 1, 0, 0, 0]), "A")[1].tolist() == [1, 1, 0, 0, 0]


def test_structure_encoder():
    w = encoders.synthetic_graph_weights()
    xyz = RNG.normal(0, 5, (9, 5, 3))
    source = np.ones((9, 5), int)
    source[4] = 0
    h, e, near = encoders.encode_graph(xyz, source, w)
    assert h.shape == (9, 64) and near.shape == (9, 9) and not h[4].any() and np.isfinite(h).all()
    moved, _, _ = encoders.encode_graph(xyz + 3, source, w)
    assert np.allclose(h, moved, atol=1e-6)  # only distances count


def test_sequence_encoder_drops_start_and_stop():
    shape = encoders.SequenceShape(16, 4, 2, 32)
    w = encoders.synthetic_sequence_weights(shape)
    assert encoders.encode_tokens(np.array([1, 2, 3]), w, shape).shape == (3, 16)
    x = RNG.normal(0, 1, (2, 5, 8))
    assert np.allclose(np.linalg.norm(encoders.rotate(x), axis=-1), np.linalg.norm(x, axis=-1))
    with pytest.raises(model.InvalidArgument):
        encoders.encode_tokens(np.array([], int), w, shape)


def test_design():
    shape = encoders.GraphShape(16, 6, update_last_edges=True)
    w = design.synthetic_design_weights(shape)
    xyz, source = RNG.normal(0, 4, (8, 5, 3)), np.ones((8, 5), int)
    one, two = (design.design_one(xyz, source, "ACDEFGHI", w, shape, seed=3, temperature=0.5) for _ in range(2))
    assert one["sequence"] == two["sequence"] and sorted(one["decode_order"]) == list(range(8))
    scored = design.design_one(xyz, source, "ACDEFGHI", w, shape, seed=3, given=one["sequence"])
    assert scored["score"] == pytest.approx(one["score"]) and np.allclose(scored["log_probs"], one["log_probs"])
    assert np.allclose(np.exp(one["log_probs"]).sum(1), 1)
    assert design.decode_order(np.ones(5), 0, "n_to_c").tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(model.InvalidArgument):
        design.decode_order(np.ones(3), 0, [0, 0, 1])
    before, after = design.causal_masks(np.array([2, 0, 1]), np.array([[0, 1], [1, 2], [2, 0]]))
    assert before.tolist() == [[0, 0], [0, 1], [0, 0]] and (before + after == 1).all()


def test_splitmix_is_the_published_one():
    r = design.SplitMix64(1234567)
    assert [r.next() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]


def test_packages_and_gaps():
    assert model.package("structure").name == "structure-d64" and model.package("esm2").hard.extension > 0
    gaps, warnings = model.resolve_gaps(model.package("structure"), "hard", -2.0, float("nan"))
    assert gaps == model.Gaps(-2.0, -0.15) and len(warnings) == 1
    with pytest.raises(model.InvalidArgument):
        model.resolve_gaps(model.package("structure"), "hard", float("inf"))
    with pytest.raises(model.NotFound):
        model.package("none")
    assert not any(model.validate_package(p) for p in model.PACKAGES.values())
    assert model.validate_package(model.Package("", "odd", 0, model.Gaps(float("nan"), 0), model.Gaps(0, 0)))
