"""Automata over code points as dense tables, run over many strings at once.

A table row is a state, a column a character class. An entry is the next state, with the bit BREAK
set where a phrase ends before this character.
"""

from __future__ import annotations

import numpy as np

BREAK = 1 << 30
LETTER = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), bool)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run(tables: np.ndarray, starts: np.ndarray, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Final states and numbers of phrase ends, a row for each start state and a column for each string.

    tables: all automata below each other; a string is codes[begin : begin + length]. Strings advance
    together, one character a step. at: states to begin in, for each start and string, instead of the starts.
    """
    order = np.argsort(-length, kind="stable")
    begin, left = begin[order], length[order]
    state = np.repeat(starts[:, None].astype(np.int64), len(order), 1) if at is None else at[:, order].astype(np.int64)
    ends = np.zeros(state.shape, np.int32)
    width, flat = tables.shape[1], tables.ravel()
    active = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")  # strings longer than t
    for t, k in enumerate(active):
        got = flat.take(state[:, :k] * width + codes[begin[:k] + t])
        ends[:, :k] += got >> 30
        state[:, :k] = got & (BREAK - 1)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return state[:, back], ends[:, back]


def suffix_automaton(codes: list[int], width: int, base: int) -> np.ndarray:
    """Rows of the automaton of all substrings, the root first, for states numbered from `base`.

    Where a state can't read a character, the entry breaks and reads it from the root; the root itself has no phrase to end.
    """
    link, size, step = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(step), width), -1, np.int32)
    for s, row in enumerate(step):
        if row:
            table[s, list(row)] = list(row.values())
    # one state more, the last: after a character that occurs nowhere, which is a phrase of its own
    again = np.where(table[0] >= 0, table[0], len(step)) + base
    rows = np.where(table >= 0, table + base, again[None] | BREAK)
    rows[0] = again
    return np.concatenate([rows, again[None] | BREAK]).astype(np.int32)


def fuzzy_lexicon(entries: list[tuple[str, bool]], edits, classes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(table, outcome): the trie of entries intersected with Levenshtein automata, made deterministic.

    entries: (term, open): an open term also accepts any continuation. edits(term) is the most
    errors for a term. outcome[state] is -1, or 4 * entry + errors of the closest entry (the first
    of equals). Class 0 is any character of no entry.
    """
    child: list[dict[int, int]] = [{}]
    ends: list[list[int]] = [[]]
    most = [0]
    for e, (term, _) in enumerate(entries):
        node = 0
        most[0] = max(most[0], edits(term))
        for ch in term:
            c = classes[ch]
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({})
                ends.append([])
                most.append(0)
            node = child[node][c]
            most[node] = max(most[node], edits(term))
        ends[node].append(e)

    def closed(items: dict[int, int]) -> frozenset:
        todo = list(items.items())
        while todo:
            node, err = todo.pop()
            if items.get(node, 9) < err:
                continue
            for below in child[node].values():
                if err + 1 <= most[below] and err + 1 < items.get(below, 9):
                    items[below] = err + 1
                    todo.append((below, err + 1))
        return frozenset(items.items())

    def result(state: frozenset, kept: int) -> int:
        best = min(((err, e) for node, err in state for e in ends[node] if err <= edits(entries[e][0])), default=None)
        mine = 4 * best[1] + best[0] if best else -1
        return mine if kept < 0 or (mine >= 0 and (mine & 3) < (kept & 3)) else kept

    def stuck(state: frozenset) -> int:
        """The closest open entry reached so far; it holds whatever follows."""
        best = min(((err, e) for node, err in state for e in ends[node] if entries[e][1] and err <= edits(entries[e][0])), default=None)
        return 4 * best[1] + best[0] if best else -1

    def merged(a: int, b: int) -> int:
        return b if a < 0 or (b >= 0 and (b & 3) < (a & 3)) else a

    first = closed({0: 0})
    start = (first, stuck(first))
    number, order, rows = {start: 0}, [start], []
    width = len(classes) + 1
    for state, held in order:
        row = []
        for c in range(width):
            new: dict[int, int] = {}
            for node, err in state:
                for ch, below in child[node].items():
                    e = err + (ch != c)
                    if e <= most[below] and e < new.get(below, 9):
                        new[below] = e
                if err + 1 <= most[node] and err + 1 < new.get(node, 9):
                    new[node] = err + 1
            closure = closed(new)
            target = (closure, merged(held, stuck(closure)))
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    return np.array(rows, np.int32), np.array([result(s, held) for s, held in order], np.int32)
