"""Regular expressions as one minimal deterministic automaton over bytes.

Patterns are plain regular expressions over single bytes: literals, classes,
groups, ``|``, ``?``, ``*``, ``+`` and ``{m,n}``. Each is expanded into a
non-deterministic automaton; all of them together become one transition array
by subset construction and minimisation (partition refinement), with the set of
patterns that end in each state.
"""

from __future__ import annotations

import re

import numpy as np

ANY = (1 << 256) - 1


def _class(members) -> int:
    mask = 0
    for m in members:
        mask |= 1 << m
    return mask


class _Parser:
    """Recursive descent: a node is ("set", mask), ("cat", nodes), ("alt",
    nodes) or ("rep", node, least, most or None)."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        nodes = [self.sequence()]
        while self.peek() == "|":
            self.take()
            nodes.append(self.sequence())
        return nodes[0] if len(nodes) == 1 else ("alt", nodes)

    def sequence(self):
        nodes = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom()
            while self.peek() and self.peek() in "?*+{":
                node = ("rep", node, *self.count())
            nodes.append(node)
        return ("cat", nodes)

    def count(self) -> tuple[int, int | None]:
        sign = self.take()
        if sign != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at : end].partition(",")
        self.at = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            self.take()
            return node
        if c == "[":
            return ("set", self.members())
        if c == "\\":
            return ("set", 1 << self.escape())
        return ("set", ANY if c == "." else 1 << ord(c))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def members(self) -> int:
        negated = self.peek() == "^"
        if negated:
            self.take()
        mask, first = 0, True
        while first or self.peek() != "]":
            first = False
            low = self.take()
            low = self.escape() if low == "\\" else ord(low)
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.take()
                high = self.escape() if high == "\\" else ord(high)
            mask |= _class(range(low, high + 1))
        self.take()
        return ANY & ~mask if negated else mask


def _fold(node):
    """Both cases of every ASCII letter."""
    kind = node[0]
    if kind == "set":
        mask = node[1]
        for b in range(65, 91):
            if mask >> b & 1 or mask >> (b + 32) & 1:
                mask |= 1 << b | 1 << (b + 32)
        return ("set", mask)
    if kind == "rep":
        return ("rep", _fold(node[1]), *node[2:])
    return (kind, [_fold(n) for n in node[1]])


def _reversed(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reversed(n) for n in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_reversed(n) for n in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if kind == "rep" else node


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Builds ``node`` from ``start``; returns its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for n in node[1]:
                start = self.add(n, start)
            return start
        end = self.state()
        if kind == "alt":
            for n in node[1]:
                self.free[self.add(n, start)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end)
            return end
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end


def parse(pattern: str, ignore_case: bool = False):
    node = _Parser(pattern).alternatives()
    return _fold(node) if ignore_case else node


class Automaton:
    """``next[state * 256 + byte]`` and, per state, the patterns that end there.

    ``search``: a match may start at every byte. State 0 is the start; states
    from ``accepting`` on end a pattern. Anchored automata have a dead state,
    from which no pattern can be reached: ``dead`` (else -1)."""

    def __init__(self, nodes: list, search: bool) -> None:
        nfa = _Nfa()
        start = nfa.state()
        if search:
            nfa.moves[start].append((ANY, start))
        ends = {}
        for name, node in enumerate(nodes):
            first = nfa.state()
            nfa.free[start].append(first)
            ends[nfa.add(node, first)] = name
        self._build(nfa, start, ends)

    def _build(self, nfa: _Nfa, start: int, ends: dict[int, int]) -> None:
        # Sets of states are bit masks; what a state reaches for free is known.
        reach = []
        for s in range(len(nfa.free)):
            found, todo = {s}, [s]
            while todo:
                new = set(nfa.free[todo.pop()]) - found
                found |= new
                todo += new
            reach.append(sum(1 << t for t in found))
        # Bytes that no class tells apart move together.
        masks = sorted({m for moves in nfa.moves for m, _ in moves})
        signature = [tuple(m >> b & 1 for m in masks) for b in range(256)]
        kinds = {s: k for k, s in enumerate(dict.fromkeys(signature))}
        kind_of = np.array([kinds[s] for s in signature])
        sample = [signature.index(s) for s in kinds]
        step = [[0] * len(sample) for _ in nfa.moves]
        for s, moves in enumerate(nfa.moves):
            for k, b in enumerate(sample):
                for m, t in moves:
                    if m >> b & 1:
                        step[s][k] |= reach[t]
        moving = sum(1 << s for s, moves in enumerate(nfa.moves) if moves)
        first = reach[start]
        names, table, todo = {first: 0}, [], [first]
        for subset in todo:
            row, left = [0] * len(sample), subset & moving
            while left:
                low = left & -left
                row = [r | t for r, t in zip(row, step[low.bit_length() - 1])]
                left ^= low
            for k, reached in enumerate(row):
                if reached not in names:
                    names[reached] = len(todo)
                    todo.append(reached)
                row[k] = names[reached]
            table.append(row)
        table = np.array(table)
        accepts = [frozenset(p for s, p in ends.items() if subset >> s & 1) for subset in todo]
        # Refine until states of a group move to equal groups for each byte.
        group = np.unique([str(sorted(a)) for a in accepts], return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == group.max():
                break
            group = finer
        count = int(group.max()) + 1
        sample_state = [int(np.flatnonzero(group == g)[0]) for g in range(count)]
        order = sorted(range(count), key=lambda g: (bool(accepts[sample_state[g]]), g != group[0], g))
        place = np.empty(count, int)
        place[order] = np.arange(count)
        moves = place[group[table[[sample_state[g] for g in order]]]]
        self.start = int(place[group[0]])
        self.accepts = [accepts[sample_state[g]] for g in order]
        self.accepting = next((i for i, a in enumerate(self.accepts) if a), count)
        self.states = count
        self.moves = moves[:, kind_of].astype(np.int32)
        self.next: list[int] = []
        stuck = [i for i in range(self.accepting) if (moves[i] == i).all()]
        self.dead = stuck[0] * 256 if stuck else -1

    def open(self) -> None:
        """Lays the array out for scanning; before that it travels compactly."""
        if not self.next:
            self.next = (self.moves * 256).reshape(-1).tolist()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"next": []}


class Scanner:
    """Finds the leftmost matches of many patterns in one pass over the bytes.

    One search automaton for all patterns runs over each byte once. Where it
    ends a pattern, an automaton of the reversed pattern finds the earliest
    start that is not inside the pattern's last match, and an anchored one the
    latest end from there. This gives the matches of ``re.finditer`` for
    patterns of which no match that starts earlier ends later than one that it
    overlaps begins to end; that holds for patterns that are a fixed start
    followed by runs, and is tested for the rules used here."""

    def __init__(self, patterns: list[tuple[str, bool]]) -> None:
        nodes = [parse(p, fold) for p, fold in patterns]
        self.search = Automaton(nodes, search=True)
        self.ahead = [Automaton([n], search=False) for n in nodes]
        self.back = [Automaton([_reversed(n)], search=False) for n in nodes]

    def _furthest(self, machine: Automaton, data, positions) -> int | None:
        state, found, first_accept = machine.start * 256, None, machine.accepting * 256
        moves, dead = machine.next, machine.dead
        for at in positions:
            state = moves[state + data[at]]
            if state == dead:
                break
            if state >= first_accept:
                found = at
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(pattern, start, end) in the order of their ends."""
        if not self.search.next:
            for machine in (self.search, *self.ahead, *self.back):
                machine.open()
        moves, first_accept, accepts = self.search.next, self.search.accepting * 256, self.search.accepts
        free = [0] * len(self.ahead)
        state, found = self.search.start * 256, []
        for at, byte in enumerate(data):
            state = moves[state + byte]
            if state >= first_accept:
                for rule in accepts[state >> 8]:
                    if at >= free[rule]:
                        start = self._furthest(self.back[rule], data, range(at, free[rule] - 1, -1))
                        if start is not None:
                            end = self._furthest(self.ahead[rule], data, range(start, len(data))) + 1
                            free[rule] = end
                            found.append((rule, start, end))
        return found


def as_python(pattern: str, ignore_case: bool) -> re.Pattern:
    """The same pattern for ``re``, to check against."""
    return re.compile(pattern.encode(), re.IGNORECASE | re.DOTALL if ignore_case else re.DOTALL)
