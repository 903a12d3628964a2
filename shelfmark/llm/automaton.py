"""Rules compiled to one deterministic automaton: a small pattern reader, subset construction, minimisation."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: Ends a text; never part of UTF-8.
STOP = 0xFF


def _read(pattern: str):
    """The tree of a pattern of literals, classes, groups, | ? * + {m,n} and the escapes \\xHH \\. and the like."""
    at = 0

    def escaped() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return {"n": 10, "t": 9}.get(c, ord(c))

    def char_class():
        nonlocal at
        negate = pattern[at] == "^"
        at += negate
        got: set[int] = set()
        while pattern[at] != "]":
            at += 1
            low = escaped() if pattern[at - 1] == "\\" else ord(pattern[at - 1])
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 2
                high = escaped() if pattern[at - 1] == "\\" else ord(pattern[at - 1])
                got.update(range(low, high + 1))
            else:
                got.add(low)
        at += 1
        return ("set", frozenset(range(STOP)) - got if negate else frozenset(got))

    def item():
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            node = either()
            at += 1
        elif c == "[":
            node = char_class()
        else:
            node = ("set", frozenset([escaped() if c == "\\" else ord(c)]))
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at:end].partition(",")
                rest = [("star", node)] if "," in pattern[at:end] and not high else [("opt", node)] * (int(high or low) - int(low))
                at, node = end + 1, ("cat", [node] * int(low) + rest)
            else:
                node = {"?": ("opt", node), "*": ("star", node), "+": ("cat", [node, ("star", node)])}[c]
        return node

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(item())
        return ("cat", parts)

    def either():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return ("alt", parts)

    return either()


def _reversed(node):
    kind, x = node
    if kind == "cat":
        return ("cat", [_reversed(y) for y in reversed(x)])
    return (kind, [_reversed(y) for y in x]) if kind == "alt" else node if kind == "set" else (kind, _reversed(x))


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        kind, x = node
        if kind == "set":
            end = self.state()
            self.moves[start] = (x, end)
            return end
        if kind == "cat":
            for y in x:
                end = self.add(y, start)
                start = self.state()
                self.empty[end].append(start)
            return start
        end = self.state()
        if kind == "alt":
            for y in x:
                s = self.state()
                self.empty[start].append(s)
                self.empty[self.add(y, s)].append(end)
        else:
            s = self.state()
            self.empty[start] += [s, end]
            e = self.add(x, s)
            self.empty[e] += [s, end] if kind == "star" else [end]
        return end

    def closure(self, states) -> frozenset:
        got, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in got:
                    got.add(s)
                    todo.append(s)
        return frozenset(got)


def compile_rules(patterns: list[str], search: bool, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(next state [states, 256] of uint16, bit mask of accepting rules per state); state 0 is the start.

    With search a match may begin at any byte; otherwise at the first, and state 1 is the dead one if there is
    any. STOP leads back to the start.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for i, p in enumerate(patterns):
        s = nfa.state()
        nfa.empty[root].append(s)
        tree = _read(p)
        ends[nfa.add(_reversed(tree) if backwards else tree, s)] = i
    start = nfa.closure([root])
    names, rows, masks, todo = {start: 0}, [], [], [start]
    while todo:
        have = todo.pop(0)
        by: dict[int, set[int]] = defaultdict(set)
        for s in have:
            if nfa.moves[s]:
                chars, to = nfa.moves[s]
                for c in chars:
                    by[c].add(to)
        known: dict[frozenset, int] = {}
        row = []
        for c in range(256):
            key = frozenset(by.get(c, ()))
            if key not in known:
                to = nfa.closure(key | {root}) if search else nfa.closure(key)
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                known[key] = names[to]
            row.append(0 if c == STOP else known[key])
        rows.append(row)
        masks.append(sum({1 << ends[s] for s in have if s in ends}))
    return _minimal(np.asarray(rows), np.asarray(masks, np.int64))


#: So few lanes to run again are run byte by byte.
FEW = 16


def _minimal(rows: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart, by refining classes until they stay."""
    part = np.unique(masks, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([part, part[rows]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    order = np.full(new.max() + 1, -1)
    seen = 0
    for p in new:
        if order[p] < 0:
            order[p] = seen
            seen += 1
    new = order[new]
    pick = np.asarray([np.flatnonzero(new == k)[0] for k in range(seen)])
    return new[rows[pick]].astype(np.uint16), masks[pick]


_lists: dict[int, tuple[np.ndarray, list[list[int]]]] = {}


def _as_lists(table: np.ndarray) -> list[list[int]]:
    if id(table) not in _lists:
        _lists[id(table)] = (table, table.tolist())
    return _lists[id(table)][1]


def states(table: np.ndarray, data: np.ndarray, lanes: int = 2048) -> np.ndarray:
    """The state after every byte, the whole of data in one pass over many lanes side by side.

    Every lane but the first begins in the start state; lanes whose neighbour ended elsewhere are run again
    from there until they meet what they had, which for such rules is soon.
    """
    n = len(data)
    if n < 4 * lanes:
        out = np.empty(n, np.uint16)
        s = 0
        rows = _as_lists(table)
        for i, c in enumerate(data.tolist()):
            s = rows[s][c]
            out[i] = s
        return out
    steps = -(-n // lanes)
    full = np.full(steps * lanes, STOP, np.uint8)
    full[:n] = data
    cols = np.ascontiguousarray(full.reshape(lanes, steps).T).astype(np.int32)
    flat = table.ravel()
    out = np.empty((steps, lanes), np.uint16)
    s = np.zeros(lanes, np.int32)
    for i in range(steps):
        s = flat[(s << 8) + cols[i]].astype(np.int32)
        out[i] = s
    came = np.zeros(lanes, np.uint16)
    while True:
        want = np.append(np.uint16(0), out[-1, :-1])
        todo = np.flatnonzero(want != came)
        if not len(todo):
            return np.ascontiguousarray(out.T).ravel()[:n]
        if len(todo) <= FEW:  # one byte after another, on through the lanes as long as states differ
            rows = _as_lists(table)
            for lane in todo.tolist():
                while lane < lanes and (lane == 0 or out[-1, lane - 1] != came[lane]):
                    s = int(out[-1, lane - 1]) if lane else 0
                    came[lane] = s
                    new, old = [], out[:, lane].tolist()
                    for i, c in enumerate(cols[:, lane].tolist()):
                        s = rows[s][c]
                        if s == old[i]:
                            break
                        new.append(s)
                    out[: len(new), lane] = new
                    if len(new) < steps:
                        break
                    lane += 1
            continue
        s = want[todo].astype(np.int32)
        came[todo] = want[todo]
        for i in range(steps):
            s = flat[(s << 8) + cols[i, todo]].astype(np.int32)
            differ = s != out[i, todo]
            if not differ.any():
                break
            out[i, todo] = s
            if not differ.all():
                todo, s = todo[differ], s[differ]
