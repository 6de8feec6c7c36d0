"""Rules of secrets, compiled to one deterministic automaton.

A rule is a head (a regular expression that occurs once) and a run: one character class, repeated at least `least`
times. Heads and runs are parsed to a nondeterministic automaton. Subset construction over all rules at once gives
one deterministic automaton of bytes; its states are minimised by partition refinement, and its transitions are one
flat array. A rule's threads are kept in order of their start, so matches are leftmost, longest and do not overlap:
once a thread is in its run, younger threads of the rule are dropped, as the run takes all that can follow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    """kind: its name; head: regular expression before the run; fold: head's letters match in either case."""

    kind: str
    head: str
    run: str
    least: int
    fold: bool = False


#: The three base rules. A match is head and run; shorter runs are dropped.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 12, True),
    Rule("access", r"AKIA", "[A-Z0-9]", 14),
    Rule("hex", r"", "[0-9a-f]", 16),
)
#: Further public key formats; their spans come on top of the base ones.
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", r"xox[abprs]-", "[A-Za-z0-9-]", 10),
)


class _Parser:
    """Recursive descent over literals, escapes, classes, groups, |, ?, * and +; builds a Thompson automaton."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold
        self.moves: list[tuple[int, frozenset[int], int]] = []
        self.free: list[tuple[int, int]] = []
        self.n = 0

    def state(self) -> int:
        self.n += 1
        return self.n - 1

    def build(self) -> tuple[int, int]:
        ends = self.choice()
        if self.i != len(self.p):
            raise ValueError(f"cannot parse {self.p!r} at {self.i}")
        return ends

    def choice(self) -> tuple[int, int]:
        a, z = self.state(), self.state()
        while True:
            s, e = self.chain()
            self.free += [(a, s), (e, z)]
            if self.i < len(self.p) and self.p[self.i] == "|":
                self.i += 1
                continue
            return a, z

    def chain(self) -> tuple[int, int]:
        a = e = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            s, t = self.atom()
            mark = self.p[self.i] if self.i < len(self.p) else ""
            if mark and mark in "?*+":
                self.i += 1
                if mark in "?*":
                    self.free.append((s, t))
                if mark in "*+":
                    self.free.append((t, s))
            self.free.append((e, s))
            e = t
        return a, e

    def atom(self) -> tuple[int, int]:
        if self.p[self.i] == "(":
            self.i += 1
            ends = self.choice()
            self.i += 1
            return ends
        s, t = self.state(), self.state()
        self.moves.append((s, frozenset(self.bytes_()), t))
        return s, t

    def one(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def bytes_(self) -> set[int]:
        got: set[int] = set()
        if self.p[self.i] == "[":
            self.i += 1
            while self.p[self.i] != "]":
                low = high = self.one()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self.one()
                got |= set(range(low, high + 1))
            self.i += 1
        else:
            got.add(self.one())
        if self.fold:
            got |= {b ^ 32 for b in got if chr(b).isalpha()}
        return got


class _Head:
    """The head's nondeterministic automaton, forwards and backwards."""

    def __init__(self, rule: Rule):
        p = _Parser(rule.head, rule.fold)
        self.first, self.last = p.build()
        self.moves, self.free = p.moves, p.free
        self.begin = self.close({self.first}, False)

    def close(self, states: set[int], back: bool) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            s = todo.pop()
            for a, b in self.free:
                x, y = (b, a) if back else (a, b)
                if x == s and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int, back: bool = False) -> frozenset[int]:
        return self.close({(a if back else b) for a, on, b in self.moves if byte in on and (b if back else a) in states}, back)

    def reversed(self) -> tuple[np.ndarray, np.ndarray]:
        """Transitions of the reversed head's deterministic automaton, and its accepting states; state 0 is dead."""
        start = self.close({self.last}, True)
        names, rows, todo = {frozenset(): 0, start: 1}, {}, [frozenset(), start]
        while todo:
            s = todo.pop()
            row = np.zeros(256, np.int32)
            for b in {x for _, on, _ in self.moves for x in on} if s else ():
                t = self.step(s, b, True)
                if t not in names:
                    names[t] = len(names)
                    todo.append(t)
                row[b] = names[t]
            rows[names[s]] = row
        return np.stack([rows[k] for k in range(len(names))]), np.array([self.first in s for s in names])


@dataclass
class Automaton:
    """classes: byte -> class; table: flat transitions, state * width + class -> state; hits: bits of the rules whose
    run is long enough in a state, states from `accepting` on have some; back: per rule the reversed head."""

    rules: tuple[Rule, ...]
    classes: np.ndarray
    width: int
    table: np.ndarray
    hits: np.ndarray
    accepting: int
    back: list[tuple[np.ndarray, np.ndarray]]


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """The minimal deterministic automaton of all rules together."""
    heads = [_Head(r) for r in rules]
    runs = [frozenset(_Parser(r.run, False).bytes_()) for r in rules]
    marks = np.zeros((256, 0), bool)
    for h, run in zip(heads, runs, strict=True):
        cols = [np.isin(np.arange(256), list(on)) for _, on, _ in h.moves] + [np.isin(np.arange(256), list(run))]
        marks = np.column_stack([marks, *cols])
    _, first, classes = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    classes, width = classes.reshape(-1).astype(np.uint8), len(first)

    def advance(k: int, state: tuple, byte: int) -> tuple:
        """state of a rule: an int n > 0 in the run (n characters so far, counted up to least), or groups of head
        states, oldest first."""
        if isinstance(state, int):
            if byte in runs[k]:
                return min(state + 1, rules[k].least)
            state = ()
        seen: set[int] = set()
        groups = []
        for group in (*state, heads[k].begin):
            if heads[k].last in group and byte in runs[k]:
                return 1
            moved = heads[k].step(group, byte) - seen
            if moved:
                groups.append(frozenset(moved))
                seen |= moved
        return tuple(groups)

    start = tuple(() for _ in rules)
    names, todo, rows, memo = {start: 0}, [start], [], {}
    while todo:
        state = todo.pop(0)
        row = []
        for b in first.tolist():
            to = []
            for k, s in enumerate(state):
                if (k, s, b) not in memo:
                    memo[k, s, b] = advance(k, s, b)
                to.append(memo[k, s, b])
            to = tuple(to)
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        rows.append(row)
    table = np.array(rows, np.int64)
    hit = np.array([sum(1 << k for k, s in enumerate(st) if isinstance(s, int) and s >= rules[k].least) for st in names], np.int64)
    # Minimise: refine the partition by hits until no block splits.
    block, count = np.unique(hit, return_inverse=True)[1].reshape(-1), 0
    while True:
        sign = np.zeros(len(block), np.uint64)
        for c in range(width):
            sign = (sign ^ block[table[:, c]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)
            sign ^= sign >> np.uint64(31)
        block = np.unique(np.column_stack([block.astype(np.uint64), sign]), axis=0, return_inverse=True)[1].reshape(-1)
        if block.max() + 1 == count:
            break
        count = int(block.max()) + 1
    lead = np.full(count, -1)
    lead[block[::-1]] = np.arange(len(block))[::-1]
    # Number the states: the start first, those that report last.
    order = sorted(range(count), key=lambda b: (hit[lead[b]] > 0, b != block[0], b))
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    small = place[block[table[lead[order]]]].astype(np.int32)
    hits = hit[lead[order]]
    return Automaton(rules, classes, width, small.reshape(-1), hits, int((hits == 0).sum()), [h.reversed() for h in heads])


def scan(auto: Automaton, data: np.ndarray, offsets: np.ndarray, alone: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and state of every byte at which some rule's run is long enough. All rows advance together, one
    byte a step, as long as more than `alone` are left; the last ones are walked one by one."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    at, left = offsets[:-1][order], lengths[order]
    symbol = auto.classes[data]
    table, width, limit = auto.table, auto.width, auto.accepting
    state = np.zeros(len(order), np.int32)
    rows, places, states = [], [], []
    active, step = int((left > 0).sum()), 0
    ends = np.searchsorted(-left, -np.arange(0, int(left[0]) + 1 if len(left) else 1), side="left") if len(left) else []
    while active > alone:
        here = state[:active]
        here *= width
        here += symbol[at[:active] + step]
        state[:active] = table[here]
        if int(state[:active].max()) >= limit:
            hit = np.flatnonzero(state[:active] >= limit)
            rows.append(order[hit])
            places.append(at[hit] + step)
            states.append(state[hit])
        step += 1
        active = int(ends[step]) if step < len(ends) else 0
    if active > 0:
        flat, top = (table * width).tolist(), limit * width
        for k in range(active):
            s, base, got = int(state[k]) * width, int(at[k]) + step, []
            for i, c in enumerate(symbol[base : int(at[k] + left[k])].tobytes()):
                s = flat[s + c]
                if s >= top:
                    got.append((i, s))
            if got:
                i, s = np.array(got, np.int64).T
                rows.append(np.full(len(i), order[k]))
                places.append(base + i)
                states.append(s // width)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(places), np.concatenate(states)


def matches(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (start, rule, end) in bytes of the row, in order of start, then rule."""
    rows, places, states = scan(auto, data, offsets)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, rule in enumerate(auto.rules):
        on = (auto.hits[states] >> k) & 1 == 1
        r, p = rows[on], places[on]
        by = np.argsort(p, kind="stable")
        r, p = r[by], p[by]
        if not len(p):
            continue
        cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(r) != 0)) + 1
        table, good = auto.back[k]
        last: dict[int, int] = {}
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]), strict=True):
            row, base = int(r[a]), int(offsets[r[a]])
            head = int(p[a]) - rule.least + 1
            begin, s, i = head, 1, head
            floor = max(base, last.get(row, base))
            while i > floor and s:  # the longest head that ends here
                i -= 1
                s = int(table[s, data[i]])
                if good[s]:
                    begin = i
            last[row] = int(p[b - 1]) + 1
            found.setdefault(row, []).append((begin - base, k, last[row] - base))
    for spans in found.values():
        spans.sort()
    return found
