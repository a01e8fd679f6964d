"""Regular expressions over bytes, compiled together into one minimal deterministic automaton of transition arrays."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import cached_property

import numpy as np

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Parser:
    """Literals, ``.``-free classes, groups, ``|``, ``? * + {m} {m,} {m,n}`` and ``(?i:...)`` into Thompson fragments."""

    def __init__(self, nfa: "_Nfa", pattern: str):
        self.nfa, self.p, self.i, self.fold = nfa, pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternation(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        start, end = self.nfa.state(), self.nfa.state()
        for a, b in parts:
            self.nfa.skip(start, a)
            self.nfa.skip(b, end)
        return start, end

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.nfa.skip(end, a)
            end = b
        return start, end

    def repeated(self) -> tuple[int, int]:
        at = self.i
        made = self.atom()
        until = self.i
        c = self.peek()
        if c not in ("?", "*", "+", "{") or c == "":
            return made
        if c == "{":
            close = self.p.index("}", self.i)
            low, _, high = self.p[self.i + 1 : close].partition(",")
            m, n = int(low), (int(high) if high else None) if "," in self.p[self.i : close] else int(low)
            after = close + 1
        else:
            m, n = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            after = self.i + 1

        def again() -> tuple[int, int]:
            self.i = at
            out = self.atom()
            assert self.i == until
            return out

        start = end = self.nfa.state()
        for _ in range(m):
            a, b = again()
            self.nfa.skip(end, a)
            end = b
        if n is None:
            a, b = again()
            hub = self.nfa.state()
            self.nfa.skip(end, hub)
            self.nfa.skip(hub, a)
            self.nfa.skip(b, hub)
            end = hub
        else:
            out = self.nfa.state()
            for _ in range(n - m):
                self.nfa.skip(end, out)
                a, b = again()
                self.nfa.skip(end, a)
                end = b
            self.nfa.skip(end, out)
            end = out
        self.i = after
        return start, end

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            fold = self.fold
            if self.p.startswith("(?i:", self.i):
                self.i += 4
                self.fold = True
            else:
                self.i += 1
            made = self.alternation()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            self.fold = fold
            return made
        if c == "[":
            return self.of(self.klass())
        return self.of({self.char()})

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            e = self.p[self.i]
            self.i += 1
            if e == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            c = _ESCAPES.get(e, e)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def klass(self) -> set[int]:
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        out: set[int] = set()
        while self.peek() != "]":
            a = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out |= set(range(a, self.char() + 1))
            else:
                out.add(a)
        self.i += 1
        return set(range(256)) - out if negated else out

    def of(self, chars: set[int]) -> tuple[int, int]:
        if self.fold:
            chars = chars | {ord(chr(x).swapcase()) for x in chars if chr(x).isalpha() and x < 128}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.moves[a].append((frozenset(chars), b))
        return a, b


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.skips: list[set[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.skips.append(set())
        return len(self.moves) - 1

    def skip(self, a: int, b: int) -> None:
        self.skips[a].add(b)

    def turn(self, first: int) -> None:
        """States from ``first`` on, which none of the others reaches, with all their arrows turned round."""
        arrows = [(a, chars, b) for a in range(first, len(self.moves)) for chars, b in self.moves[a]]
        skips = [(a, b) for a in range(first, len(self.moves)) for b in self.skips[a]]
        for a in range(first, len(self.moves)):
            self.moves[a], self.skips[a] = [], set()
        for a, chars, b in arrows:
            self.moves[b].append((chars, a))
        for a, b in skips:
            self.skips[b].add(a)

    def closure(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """``moves[state * classes + klass[byte]]`` is the next state, state 0 the start; bit k of ``accepts`` is set where
    rule k has just matched some text that ends here (the search is unanchored). Bytes that no rule tells apart share
    a class, which keeps the array within a processor's cache."""

    moves: np.ndarray
    klass: bytes
    accepts: np.ndarray

    @property
    def states(self) -> int:
        return len(self.accepts)

    @property
    def classes(self) -> int:
        return len(self.moves) // self.states

    def longest(self, data: bytes, start: int, bit: int = 0) -> tuple[int, int]:
        """For an anchored automaton: where the longest match of rule ``bit`` from ``start`` ends (-1: none), and the bits
        of the rules that accept there."""
        moves, klass, accepts, classes = self.lists
        state, end, bits = 0, -1, 0
        for at in range(start, len(data)):
            state = moves[state * classes + klass[data[at]]]
            if state == self.dead:
                break
            if accepts[state] >> bit & 1:
                end, bits = at + 1, accepts[state]
        return end, bits

    @cached_property
    def lists(self) -> tuple[list[int], bytes, list[int], int]:
        return self.moves.tolist(), self.klass, self.accepts.tolist(), self.classes

    @cached_property
    def dead(self) -> int:
        """The state from which nothing is accepted any more; -1 if there is none."""
        table = self.moves.reshape(self.states, self.classes)
        stuck = np.flatnonzero((table == np.arange(self.states)[:, None]).all(axis=1) & (self.accepts == 0))
        return int(stuck[0]) if len(stuck) else -1

    def accepted(self, data: bytes, reset: int = 10, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The positions at which some rule has just matched, in order, and the rules' bits there.

        The bytes are cut into equal stretches that advance in lockstep, so one numpy step moves them all. Each
        stretch is begun at the start state; those whose predecessor ended elsewhere are run again from its state
        until they meet what was found, which any byte that leads to the start (``reset`` does) makes soon.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = max(1, min(width, n // 64))
        length = -(-n // rows)
        padded = np.full(rows * length, self.klass[reset], np.uint8)
        padded[:n] = np.frombuffer(data.translate(self.klass), np.uint8)
        grid = np.ascontiguousarray(padded.reshape(rows, length).T).astype(np.int32)
        scaled = self.moves * np.int32(self.classes)  # states are kept as offsets of their rows
        states = np.empty((length, rows), np.int32)
        now = np.zeros(rows, np.int32)
        at = np.empty(rows, np.int32)
        for i in range(length):
            np.add(now, grid[i], out=at)
            now = np.take(scaled, at, out=states[i], mode="wrap")
        came = np.zeros(rows, np.int32)  # the state that each stretch was begun in
        while True:
            true = np.concatenate((np.zeros(1, np.int32), states[-1, :-1]))
            todo = np.flatnonzero(true != came)
            if not len(todo):
                break
            came[todo] = now = true[todo]
            for i in range(length):
                now = scaled[now + grid[i, todo]]
                differs = now != states[i, todo]
                states[i, todo] = now
                todo, now = todo[differs], now[differs]
                if not len(todo):
                    break
        mask = np.zeros(self.states * self.classes, bool)
        mask[:: self.classes] = self.accepts != 0
        i, j = np.nonzero(np.take(mask, states, mode="wrap"))
        position = j * length + i
        order = np.argsort(position, kind="stable")
        order = order[position[order] < n]
        return position[order], self.accepts[states[i, j][order] // self.classes]


def compile_rules(patterns: list[str], limit: int = 20_000, anchored: bool = False, backwards: bool = False) -> Automaton:
    """Thompson construction, subset construction over all rules at once, Moore minimisation.

    ``anchored``: a match begins where the bytes do, else anywhere. ``backwards``: the rules read from their ends, so
    that over reversed bytes bit k says where a match of rule k begins.
    """
    nfa = _Nfa()
    start, ends = nfa.state(), []
    if not anchored:
        nfa.moves[start].append((frozenset(range(256)), start))
    for p in patterns:
        before = len(nfa.moves)
        parser = _Parser(nfa, p)
        a, b = parser.alternation()
        if parser.i != len(p):
            raise ValueError(f"can't read {p!r} at {parser.i}")
        if backwards:
            nfa.turn(before)
            a, b = b, a
        nfa.skip(start, a)
        ends.append(b)
    first = nfa.closure({start})
    index, todo, table, accepts = {first: 0}, deque([first]), [], []
    while todo:
        now = todo.popleft()
        accepts.append(sum(1 << k for k, e in enumerate(ends) if e in now))
        targets: list[set[int]] = [set() for _ in range(256)]
        for s in now:
            for chars, to in nfa.moves[s]:
                for c in chars:
                    targets[c].add(to)
        row, seen = [], {}
        for t in targets:
            key = frozenset(t)
            if key not in seen:
                closed = nfa.closure(t)
                if closed not in index:
                    if len(index) >= limit:
                        raise ValueError(f"more than {limit} states")
                    index[closed] = len(index)
                    todo.append(closed)
                seen[key] = index[closed]
            row.append(seen[key])
        table.append(row)
    return _minimised(np.array(table, np.int32), np.array(accepts, np.int64))


def _minimised(table: np.ndarray, accepts: np.ndarray) -> Automaton:
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        key = np.column_stack((block, block[table]))
        _, finer = np.unique(key, axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # number the blocks so that the start is 0
    order = np.full(block.max() + 1, -1)
    order[block[0]] = 0
    free = 1
    for b in block:
        if order[b] < 0:
            order[b] = free
            free += 1
    block = order[block]
    rep = np.zeros(free, np.int64)
    rep[block] = np.arange(len(block))
    moves = block[table[rep]]
    columns, klass = np.unique(moves, axis=1, return_inverse=True)
    return Automaton(np.ascontiguousarray(columns.astype(np.int32)).reshape(-1), bytes(klass.reshape(-1).astype(np.uint8)), accepts[rep])
