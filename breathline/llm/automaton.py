"""Regular expressions over bytes, combined into one minimal deterministic automaton.

A small regex dialect (literals, classes, groups, ``|``, ``? * + {m} {m,} {m,n}``,
``\\xHH`` and escaped characters) is parsed to an NFA; subset construction and
partition refinement give transition arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class _Nfa:
    """Transitions: empty ones by state, and (set of bytes, target) by state."""

    empty: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1


class _Parser:
    """Recursive descent to a syntax tree: ('set', bytes), ('cat', ..), ('alt', ..), ('rep', node, least, most)."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars |= {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(chars)

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return ("alt", branches) if len(branches) > 1 else branches[0]

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                bounds = ""
                while self.peek() != "}":
                    bounds += self.take()
                self.take()
                least, comma, most = bounds.partition(",")
                node = ("rep", node, int(least), int(most) if most else (None if comma else int(least)))
            else:
                node = ("rep", node, int(sign == "+"), 1 if sign == "?" else None)
        return node

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def atom(self):
        if self.peek() == "(":
            self.take()
            node = self.alternatives()
            self.take()
            return node
        if self.peek() == "[":
            self.take()
            negated, chars = self.peek() == "^", set()
            self.at += negated
            while self.peek() != "]":
                low = self.byte()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    chars.update(range(low, self.byte() + 1))
                else:
                    chars.add(low)
            self.take()
            chars = set(self.folded(chars))
            return ("set", frozenset(set(range(256)) - chars if negated else chars))
        return ("set", self.folded({self.byte()}))


def _build(nfa: _Nfa, node, start: int) -> int:
    """Add ``node`` from ``start``; returns its end state."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((node[1], end))
        return end
    if kind == "cat":
        for part in node[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for branch in node[1]:
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.empty[_build(nfa, branch, first)].append(end)
        return end
    _, inner, least, most = node
    for _ in range(least):
        start = _build(nfa, inner, start)
    if most is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[_build(nfa, inner, loop)].append(loop)
        return loop
    end = nfa.state()
    nfa.empty[start].append(end)
    for _ in range(most - least):
        start = _build(nfa, inner, start)
        nfa.empty[start].append(end)
    return end


def _reversed(node):
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    return node if node[0] == "set" else ("rep", _reversed(node[1]), *node[2:])


@dataclass
class Automaton:
    """Transition arrays: ``table[state * 256 + byte]`` is the next state times 256.

    States are numbered so that those that accept come last, from ``accepting`` on
    (times 256); ``rules[state]`` are the rules that end there. State 0 of an anchored
    automaton is dead; ``start`` is the start state times 256.
    """

    table: list[int]
    start: int
    accepting: int
    rules: list[tuple[int, ...]]


def compile_rules(patterns: list[tuple[str, bool]], anchored: bool, backwards: bool = False) -> Automaton:
    """One minimal automaton for ``patterns`` of (regex, whether letters match in either case).

    Not anchored, it looks for matches that begin at any byte.
    """
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for rule, (pattern, fold) in enumerate(patterns):
        first = nfa.state()
        nfa.empty[root].append(first)
        tree = _Parser(pattern, fold).alternatives()
        ends[_build(nfa, _reversed(tree) if backwards else tree, first)] = rule
    classes = _byte_classes(nfa)
    kinds = max(classes) + 1
    sample = [classes.index(k) for k in range(kinds)]

    def closed(states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)

    start = closed([root])
    number, steps, todo = {start: 0}, [], [start]
    for state in todo:
        row = []
        for byte in sample:
            to = {t for s in state for chars, t in nfa.moves[s] if byte in chars}
            to = closed(to if anchored else to | {root})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        steps.append(row)
    accepts = [tuple(sorted(ends[s] for s in state if s in ends)) for state in todo]
    return _numbered(*_minimal(steps, accepts), classes)


def _byte_classes(nfa: _Nfa) -> list[int]:
    """Bytes that no move tells apart have the same class."""
    sets = {chars for moves in nfa.moves for chars, _ in moves}
    seen: dict[tuple[bool, ...], int] = {}
    return [seen.setdefault(tuple(b in chars for chars in sets), len(seen)) for b in range(256)]


def _minimal(steps: list[list[int]], accepts: list[tuple[int, ...]]):
    """Partition refinement: states stay together while rules and successors' blocks agree."""
    names: dict = {}
    block = [names.setdefault(a, len(names)) for a in accepts]
    while True:
        names = {}
        finer = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(steps)]
        if len(names) == len(set(block)):
            break
        block = finer
    first = {b: s for s, b in reversed(list(enumerate(finer)))}
    blocks = sorted(first)
    return [[finer[t] for t in steps[first[b]]] for b in blocks], [accepts[first[b]] for b in blocks], finer[0]


def _numbered(steps, accepts, start, classes) -> Automaton:
    dead = [s for s, row in enumerate(steps) if not accepts[s] and all(t == s for t in row)]
    order = sorted(range(len(steps)), key=lambda s: (bool(accepts[s]), s not in dead, s))
    if not dead:
        order = [None, *order]
    at = {s: i * 256 for i, s in enumerate(order)}
    table: list[int] = []
    for s in order:
        table += [0] * 256 if s is None else [at[steps[s][c]] for c in classes]
    rules = [() if s is None else accepts[s] for s in order]
    accepting = next((i for i, r in enumerate(rules) if r), len(rules)) * 256
    return Automaton(table, at[start], accepting, rules)
