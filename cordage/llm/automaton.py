"""One deterministic automaton for many rules: subset construction, minimisation, one byte pass.

A rule is a prefix expression and then a greedy run of one byte class. Per rule the automaton
follows leftmost, non-overlapping matches: a state is the list of the rule's live positions, those
of earlier starts first; once one is in its run, later starts are dropped, and where the run ends
the search goes on at that byte. The states of all rules side by side are one state of the combined
automaton, whose reachable states are then merged by Moore's partition refinement.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Between documents; in no byte class, so that it ends every match.
END = 0xFF


@dataclass(frozen=True)
class Rule:
    """``prefix`` then one or more bytes of ``run``; matches with a run below ``least`` don't count, but are
    passed over as matches are. ``fold``: letters of the prefix in either case (ASCII)."""

    name: str
    prefix: str
    run: str
    least: int
    fold: bool = False


class _Parser:
    """Expressions of literals, classes, groups, ``|``, ``?``, ``*`` and ``+`` as nested tuples."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom()
            while self.peek() in ("?", "*", "+") and self.peek():
                part = (self.take(), part)
            parts.append(part)
        return ("then", parts)

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.take()
            inner = self.either()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return inner
        if self.peek() != "[":
            return ("bytes", self.folded({self.byte()}))
        self.take()
        found: set[int] = set()
        while self.peek() != "]":
            low = self.byte()
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.byte()
            found |= set(range(low, high + 1))
        self.take()
        return ("bytes", self.folded(found))

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            text = bytes(sorted(found))
            found = found | set(text.lower()) | set(text.upper())
        return frozenset(found)


def parse(text: str, fold: bool = False):
    parser = _Parser(text, fold)
    tree = parser.either()
    if parser.at != len(text):
        raise ValueError(f"trailing text in {text!r}")
    return tree


def _reversed(tree):
    kind, rest = tree
    if kind == "bytes":
        return tree
    if kind == "then":
        return (kind, [_reversed(x) for x in reversed(rest)])
    return (kind, [_reversed(x) for x in rest]) if kind == "or" else (kind, _reversed(rest))


@dataclass
class Positions:
    """The consuming positions of an expression: their bytes, and what may follow each. -1: the end."""

    classes: list[frozenset[int]] = field(default_factory=list)
    after: list[tuple[int, ...]] = field(default_factory=list)
    start: tuple[int, ...] = ()

    @classmethod
    def of(cls, tree) -> Positions:
        found = cls()
        found.start = tuple(dict.fromkeys(found._build(tree, lambda: (-1,))()))
        found.after = [tuple(dict.fromkeys(a())) for a in found.after]  # type: ignore[operator]
        return found

    def _build(self, tree, onward):
        """A function that lists the positions at which ``tree`` then ``onward`` can begin, most preferred first."""
        kind, rest = tree
        if kind == "bytes":
            self.classes.append(rest)
            self.after.append(onward)  # type: ignore[arg-type]
            n = len(self.classes) - 1
            return lambda: (n,)
        if kind == "then":
            for part in reversed(rest):
                onward = self._build(part, onward)
            return onward
        if kind == "or":
            options = [self._build(part, onward) for part in rest]
            return lambda: tuple(p for f in options for p in f())
        if kind == "?":
            inner = self._build(rest, onward)
            return lambda: inner() + onward()
        box: list = []
        busy = [False]

        def again():
            if busy[0]:  # an empty turn of the loop adds nothing
                return ()
            busy[0] = True
            out = box[0]() + onward()
            busy[0] = False
            return out

        box.append(self._build(rest, again))
        return again if kind == "*" else box[0]

    def step(self, live: tuple[int, ...], byte: int) -> tuple[int, ...]:
        return tuple(dict.fromkeys(q for p in live if p >= 0 and byte in self.classes[p] for q in self.after[p]))


def _advance(rule: Positions, live: tuple[int, ...], byte: int) -> tuple[int, ...]:
    if -1 in live:
        moved = rule.step(live[: live.index(-1)], byte)
        if moved:
            return moved[: moved.index(-1) + 1] if -1 in moved else moved
        live = rule.start
    moved = tuple(dict.fromkeys(rule.step(live, byte)))
    if -1 in moved:
        return moved[: moved.index(-1) + 1]
    return tuple(dict.fromkeys(moved + rule.start))


class Automaton:
    """Transition arrays of all rules together.

    ``table[state * kinds + kind_of_byte]`` is the next state, premultiplied by ``kinds``; ``accepts[state]``
    (premultiplied too) has bit r set where rule r is in its run.
    """

    def __init__(self, rules: list[Rule]):
        if len(rules) > 16:
            raise ValueError("at most 16 rules in one automaton")
        self.rules = rules
        forward = [Positions.of(("then", [parse(r.prefix, r.fold), ("+", parse(r.run))])) for r in rules]
        self._backward = [Positions.of(_reversed(parse(r.prefix, r.fold))) for r in rules]
        used = [c for p in forward for c in p.classes]
        kinds: dict[tuple[bool, ...], int] = {}
        self.kind_of_byte = np.zeros(256, np.uint8)
        examples = []
        for b in range(256):
            key = tuple(b in c for c in used)
            if key not in kinds:
                kinds[key] = len(kinds)
                examples.append(b)
            self.kind_of_byte[b] = kinds[key]
        if any(END in c for c in used):
            raise ValueError("byte 255 separates documents")

        first = tuple(p.start for p in forward)
        states, todo, rows = {first: 0}, [first], []
        while len(rows) < len(todo):
            state, row = todo[len(rows)], []
            for b in examples:
                after = tuple(_advance(p, live, b) for p, live in zip(forward, state, strict=True))
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                row.append(states[after])
            rows.append(row)
        accepts = np.array([sum(1 << r for r, live in enumerate(s) if -1 in live) for s in todo])
        table, accepts = self._minimised(np.array(rows), accepts)
        self.kinds, self.states = len(examples), len(table)
        if self.states * self.kinds > 1 << 16:
            raise ValueError("too many states for 16-bit arrays")
        self.table = (table * self.kinds).astype(np.int32).ravel()
        self.accepts = np.repeat(accepts.astype(np.uint16), self.kinds)

    @staticmethod
    def _minimised(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moore's refinement: states part until those of a part go to the same parts on every byte. The first stays 0."""
        part = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([part[:, None], part[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        order = list(dict.fromkeys(part.tolist()))
        number = np.empty(len(order), int)
        number[order] = np.arange(len(order))
        one = np.array([np.flatnonzero(part == p)[0] for p in order])
        return number[part[table[one]]], accepts[one]

    def run(self, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """The state (premultiplied) after each byte. The data is cut into lanes that all start in state 0; a lane whose true
        first state is another one is then followed from that until both agree."""
        n = len(data)
        width = max(1, min(lanes, n // 128))
        length = -(-n // width)
        padded = np.full(width * length, END, np.uint8)
        padded[:n] = data
        columns = np.ascontiguousarray(self.kind_of_byte[padded].reshape(width, length).T)
        out = np.empty((length, width), np.uint16)
        state, index = np.zeros(width, np.int32), np.empty(width, np.int32)
        for t in range(length):
            np.add(state, columns[t], out=index)
            np.take(self.table, index, out=state, mode="clip")
            out[t] = state
        began = np.zeros(width, np.int32)
        while True:
            should = np.concatenate(([0], out[-1, :-1])).astype(np.int32)
            wrong = np.flatnonzero(began != should)
            if not len(wrong):
                break
            began[wrong] = should[wrong]
            now = should[wrong]
            for t in range(length):
                now = self.table[now + columns[t, wrong]]
                differ = out[t, wrong] != now
                if not differ.all():
                    wrong, now = wrong[differ], now[differ]
                    if not len(wrong):
                        break
                out[t, wrong] = now
        return out.T.ravel()[:n]

    def matches(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match of ``data``, whose documents are separated by END."""
        found: list[tuple[int, int, int]] = []
        if not len(data):
            return found
        accepts = self.accepts[self.run(data)]
        raw = data.tobytes()
        for r, rule in enumerate(self.rules):
            inside = np.zeros(len(data) + 2, np.int8)
            inside[1:-1] = (accepts >> r) & 1
            edges = np.flatnonzero(np.diff(inside))
            starts, ends = edges[::2], edges[1::2]
            long = np.flatnonzero(ends - starts >= rule.least)
            for i in long.tolist():
                floor = int(ends[i - 1]) if i else 0
                found.append((self._begin(r, raw, int(starts[i]), floor), int(ends[i]), r))
        return found

    def _begin(self, r: int, raw: bytes, at: int, floor: int) -> int:
        """Where the match whose run starts at ``at`` begins: its prefix is read backward, as far as it goes."""
        rule = self._backward[r]
        live, best = rule.start, at if -1 in rule.start else None
        i = at
        while i > floor and live:
            i -= 1
            live = rule.step(live, raw[i])
            if -1 in live:
                best = i
        if best is None:
            raise AssertionError("a run without its prefix")
        return best
