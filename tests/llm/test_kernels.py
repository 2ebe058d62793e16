"""Kernels of the corpus operators against plain versions, without Spark."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfold.llm import automata as au
from sparkfold.llm import line_dedup as ld
from sparkfold.llm import ngram_join as nj
from sparkfold.llm import secrets
from sparkfold.llm import textvec as tv
from sparkfold.llm import token_files as tf
from sparkfold.llm import vector_graph as vg

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("abAB \t\n\x0b.,!é日ß<|>1"), max_size=40)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@given(st.lists(TEXT, max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    data, at = tv.raw(tv.strings(pa.array(texts, pa.string())))
    begin, end, of = tv.words(data, at)
    raw = data.tobytes()
    got = [[raw[begin[k] : end[k]].decode() for k in range(of[i], of[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]


@given(st.lists(TEXT, max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingle_sets_are_equal_where_word_windows_are(texts):
    lower = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    plain = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in lower]
    got = dict(tv.shingles(tv.strings(pa.array(texts, pa.string()))))
    for i, a in enumerate(plain):
        assert len(got[i]) == len(a)
        for j, b in enumerate(plain):
            assert len(np.intersect1d(got[i], got[j])) == len(a & b)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance_and_segments_lose_no_near_line(tau):
    r = random.Random(tau)
    pairs = []
    while len(pairs) < 400:
        a = "".join(r.choices("abc", k=r.randint(tau + 3, 30)))
        b = list(a)
        for _ in range(r.randint(0, tau + 2)):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 1)] = r.choice(["", "a", "b"])
            b = b or ["a"]
        if len(b) > tau + 1:
            pairs.append((a, "".join(b)))
    points = [au.code_points(x) for p in pairs for x in p]
    n = np.array([len(p) for p in points])
    at = np.cumsum(n) - n
    got = ld.edit_within(np.concatenate(points), at[::2], n[::2], at[1::2], n[1::2], tau)
    want = [distance(a, b) <= tau for a, b in pairs]
    assert got.tolist() == want
    names = lambda s: {(len(s) - d, i, s[int(b[0]) : int(b[0] + z[0])]) for i, d, b, z in ld.probes(np.array([len(s)]), tau)}
    assert all(names(a) & names(b) for (a, b), near in zip(pairs, want, strict=True) if near)


def test_suffix_automaton_counts_longest_match_phrases():
    r = random.Random(2)
    sample = [r.randint(0, 3) for _ in range(300)]
    table = au.suffix_automaton(sample, 5, 0)
    whole = "".join(map(str, sample))
    for _ in range(30):
        s = [r.randint(0, 4) for _ in range(r.randint(1, 60))]
        _, ends = au.run(table, np.array([0]), np.array(s), np.array([0]), np.array([len(s)]))
        breaks, current = 0, ""
        for c in map(str, s):
            if current + c in whole or not current:  # a character that occurs nowhere is a phrase too
                current += c
            else:
                breaks, current = breaks + 1, c
        assert int(ends[0, 0]) == breaks


def test_fuzzy_lexicon_accepts_what_edit_distance_does():
    terms = [("idiot", False), ("trash", False), ("worthless", False), ("chlla", True), ("abc", False)]
    edits = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
    letters = sorted({c for t, _ in terms for c in t})
    classes = {c: k + 1 for k, c in enumerate(letters)}
    table, outcome = au.fuzzy_lexicon(terms, edits, classes)
    r = random.Random(5)
    words = ["idiot", "idoit", "idi0t", "idiots", "worthles", "wrthles", "chllamo", "challamo", "abc", "abd", "", "trashy"]
    words += ["".join(r.choices("idotrashwle", k=r.randint(1, 10))) for _ in range(500)]
    size = np.array([len(w) for w in words])
    codes = np.array([classes.get(c, 0) for w in words for c in w])
    state, _ = au.run(table, np.array([0]), codes, np.cumsum(size) - size, size)
    for w, s in zip(words, state[0], strict=True):
        near = [min(distance(w[:k], t) for k in range(len(w) + 1)) if is_open else distance(w, t) for t, is_open in terms]
        fits = [d for d, (t, _) in zip(near, terms, strict=True) if d <= edits(t)]
        assert (outcome[s] >= 0) == bool(fits), w
        assert not fits or outcome[s] & 3 == min(fits), w


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.integers(0, 40))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(ids, narrow):
    a = np.array(ids, np.uint32) >> np.uint32(min(narrow, 31))
    blob = tf.write_segment(pa.array([7]), np.array([len(a)]), a, 5)
    docs, n, back, start = tf.read_segment(blob)
    assert docs.tolist() == [7] and n.tolist() == [len(a)] and start == 5 and np.array_equal(back, a)


def test_outliers_go_to_the_exception_list():
    a = np.full(tf.BLOCK, 3, np.uint32)
    a[[5, 100]] = 1 << 30
    assert len(tf.encode_blocks(a)[0]) < 40
    with pytest.raises(ValueError):
        tf.read_segment(b"nope" + bytes(40))


def test_word_coder_equals_the_library():
    from sparkfold.llm.queries import tokenizer_file

    c = tf.WordCoder(tokenizer_file("word_bpe_49k.json"), most=50)
    texts = ["", "  ", "<|endoftext|>. <|ENDOFTEXT|> a<|startoftext|>b", "don't I'M é́ Å x'S,. 12.5%", " a b c.,d..", "İstanbul K", "'s. 's 'll, ''s", "word " * 300, "A.b,c! q"]
    for _ in range(2):
        n, ids = c.encode(tv.strings(pa.array(texts)), 1)
        want = [c.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_pieces_equal_the_library_and_come_back():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from sparkfold.llm import pieces
    from sparkfold.llm.queries import tokenizer_file

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.PieceModel.load(path)
    s = pieces.Segmenter(model)
    r = random.Random(3)
    texts = ["", "  ", "   a  b ", "日本語 😀 x́", "\n\n a\tb", "Ünï  ", "".join(r.choices("thandeingor1é", k=700)), *("".join(r.choices("thandeingor é1.\n", k=60)) for _ in range(40))]
    n, ids = s.encode(tv.strings(pa.array(texts)))
    assert ids.tolist() == sum((lib.encode(t) for t in texts), [])
    assert s.decode(n, ids) == texts
    # the Viterbi search, against the library's lattice over the same pieces
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pieces.UNIGRAM
    lattice = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    u = pieces.Segmenter(pieces.PieceModel(model.pieces, model.scores, model.kinds, model.prefix))
    words = ["hello", "thandeingor", "straße", "aaaa", "inthe"]
    n, ids = u.encode(tv.strings(pa.array(words)))
    total = lambda own: sum(model.scores[i] for i in own)
    at = 0
    for w, k in zip(words, n, strict=True):
        assert total(ids[at : at + k]) == max(map(total, lattice.nbest_encode_as_ids(w, 3)))
        at += k
    assert u.decode(n, ids) == words


def test_trie_finds_all_components():
    r = random.Random(9)
    base = list(range(40))
    sets = []
    for k in range(60):
        own = set(base if k % 3 else range(100, 140))
        for _ in range(r.randint(0, 9)):
            own.discard(r.choice(base))
            own.add(r.randint(1000, 1200))
        sets.append(sorted(own))
    count = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    keep = [[x for x in s if count[x] > 1] for s in sets]
    keep = [sorted(k, key=lambda x: (count[x], x)) for k in keep]

    def solve(sides):
        parent = list(range(len(sets)))

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for i, j in sides:
            own = [t for t in range(len(sets)) if t % 3 in (i, j)]
            table = pa.table({"n": [len(sets[t]) for t in own], "comp": own, "side": [0 if t % 3 == i else 1 for t in own], "h": [keep[t] for t in own], "df": [[count[x] for x in keep[t]] for t in own], "grp": [0] * len(own)})
            for a, b in zip(*nj._bin_links(table).to_pydict().values(), strict=True):
                parent[find(max(find(a), find(b)))] = min(find(a), find(b))
        return [find(v) for v in range(len(sets))]

    got = solve([(i, j) for i in range(3) for j in range(i, 3)])
    plain = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            o = len(set(sets[a]) & set(sets[b]))
            if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                low, high = sorted((plain[a], plain[b]))
                plain = [low if v == high else v for v in plain]
    assert got == plain and len(set(plain)) > 2


def test_graph_finds_links_of_crowds_and_pairs():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16))
    x[100:200] = x[0] + 0.02 * rng.standard_normal((100, 16))
    x[300:320] = x[1]
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact = x @ x.T >= vg.COSINE
    graph = vg.Graph(x, np.arange(700) * 3)
    met, recall, _ = graph.audited(x, True)
    assert recall >= vg.RECALL and not (met & ~exact).any() and met.sum() >= 0.99 * exact.sum()
    again = vg.Graph.unpacked(x, np.arange(700) * 3, graph.packed())
    assert (again.audited(x, True)[0] == met).all() and [n.shape for n in again.near] == [n.shape for n in graph.near]


def test_forest_tells_made_up_secrets():
    rows = secrets.made_up_findings(3000, seed=1)
    scanner = secrets.Scanner.train(rows[:2000])
    p = scanner.forest.predict(np.array([scanner.features(f) for f in rows[2000:]]))
    assert np.mean((p >= secrets.SECRET) == np.array([f.label for f in rows[2000:]])) > 0.95


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
