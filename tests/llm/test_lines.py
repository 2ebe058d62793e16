"""Line classes against all pairs of lines: short lines, repeated and null ids, blocks of a bucket."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparkfold.llm import automata as au
from sparkfold.llm import line_dedup

from .test_kernels import distance

SCHEMA = "doc_id long, text string"
BLANKS = " \t\n\x0b\x0c\r"


def plain(rows: list[tuple]) -> dict:
    """(doc_id, line_no) -> (rep, n_links, kept) for rows of distinct ids."""
    lines = {(d, k): x.strip(BLANKS) for d, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(BLANKS)}
    first: dict[str, tuple] = {}
    for at in sorted(lines):
        first.setdefault(lines[at], at)
    kinds = sorted(first)
    near = {x: [y for y in kinds if y != x and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2] for x in kinds}
    return {at: (first[x], len(near[x]), first[x] == at and not any(first[y] < at for y in near[x])) for at, x in lines.items()}


def found(spark, rows):
    return {(x["doc_id"], x["line_no"]): ((x["rep_doc_id"], x["rep_line_no"]), x["n_links"], x["kept"]) for x in line_dedup.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}


def mangled(r: random.Random, x: str) -> str:
    for _ in range(r.randint(0, 3)):
        at = r.randrange(len(x) + 1)
        x = r.choice([x[:at] + r.choice("abé日") + x[at:], x[:at] + x[at + 1 :], x[:at] + r.choice("abc ") + x[at + 1 :]])
    return x


@pytest.mark.parametrize("block", [5, 1024])
def test_all_lengths_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(block)
    base = ["".join(r.choices("abc dé", k=n)) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12, 17, 25, 29, 30, 31, 60, 200)]
    rows = [(k, "\n".join(mangled(r, r.choice(base)) for _ in range(6))) for k in range(45)]
    assert found(spark, rows) == plain(rows)


def test_short_and_odd_lines(spark):
    rows = [(0, "a short line of 25 chars."), (1, "a shirt line of 25 chars."), (2, None), (3, ""), (4, " \n\t\n"), (5, "x" * 3000), (6, "x" * 3001 + "\n  a  "), (7, "日本"), (8, "日"), (9, "abcde"), (10, "abc")]
    assert found(spark, rows) == plain(rows)
    assert line_dedup.line_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_share_an_id_and_rows_without_one(spark):
    one, two = "the first line that is long enough to be cut", "another line, of other words and of another length"
    rows = [(1, one), (1, two), (2, one + "s"), (3, two + "s"), (None, one), (None, "a third one of its own")]
    got = sorted((x["doc_id"] or 0, x["rep_doc_id"] or 0, x["n_links"], x["kept"]) for x in line_dedup.line_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, 0, True), (0, 1, 1, False), (1, 1, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 3, 1, False)]
    left = line_dedup.without_repeats(spark.createDataFrame([(1, one + "\n" + two), (1, "mine\n" + one), (None, "x y z"), (None, two), (4, "bed\nbad")], SCHEMA))
    assert sorted((x["doc_id"] or 0, x["text"]) for x in left.collect()) in ([(0, "x y z"), (1, "mine"), (1, one + "\n" + two), (4, "bed\nbad")], [(0, "x y z"), (1, "mine\n" + one), (1, two), (4, "bed\nbad")])


def test_small_distances():
    r = random.Random(2)
    words = ["".join(r.choices("abé", k=r.randint(1, 4))) for _ in range(60)]
    codes = au.code_points("".join(words))
    n = np.array([len(w) for w in words])
    at = np.cumsum(n) - n
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    got = line_dedup.edit_small(codes, at[a], n[a], at[b], n[b])
    assert got.tolist() == [distance(words[i], words[j]) <= 2 for i, j in zip(a, b, strict=True)]
