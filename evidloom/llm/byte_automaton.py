"""Regular expressions over bytes compiled to transition arrays by subset construction and minimisation.

``Combined`` is one automaton that searches for all rules at once in one pass and tells where a match of a rule is
sure (opens) and where it ends (closes). ``backward`` is a rule read from its end, which finds where a match began.
"""

from __future__ import annotations

import re._constants as kind
import re._parser as parser

import numpy as np

ALL = frozenset(range(256))
#: States an automaton may have; rules that need more are refused rather than left to fill memory.
MOST_STATES = 60_000


def parsed(pattern: bytes, backward: bool = False):
    return _reversed(parser.parse(pattern)) if backward else parser.parse(pattern)


def _reversed(tree) -> list:
    """The parsed pattern of the same words read from the end."""
    out = []
    for op, arg in tree:
        if op is kind.SUBPATTERN:
            arg = (*arg[:3], _reversed(arg[3]))
        elif op is kind.BRANCH:
            arg = (arg[0], [_reversed(way) for way in arg[1]])
        elif op is kind.MAX_REPEAT:
            arg = (*arg[:2], _reversed(arg[2]))
        out.insert(0, (op, arg))
    return out


class _Nfa:
    """States with moves on byte sets and moves on nothing."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, at: int) -> int:
        """Put the parsed pattern behind ``at``; the state reached."""
        for op, arg in tree:
            if op is kind.SUBPATTERN:
                at = self.add(arg[3], at)
            elif op is kind.BRANCH:
                end = self.state()
                for way in arg[1]:
                    begin = self.state()
                    self.free[at].append(begin)
                    self.free[self.add(way, begin)].append(end)
                at = end
            elif op is kind.MAX_REPEAT:
                at = self._repeat(*arg, at)
            else:
                to = self.state()
                self.moves[at].append((self._set(op, arg), to))
                at = to
        return at

    def _repeat(self, least: int, most: int, tree, at: int) -> int:
        for _ in range(least):
            at = self.add(tree, at)
        if most is kind.MAXREPEAT:
            loop, end = self.state(), self.state()
            self.free[at] += [loop, end]
            self.free[self.add(tree, loop)] += [loop, end]
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[at].append(end)
            at = self.add(tree, at)
        self.free[at].append(end)
        return end

    def _set(self, op, arg) -> frozenset[int]:
        if op is kind.LITERAL:
            return frozenset([arg])
        if op is kind.NOT_LITERAL:
            return ALL - {arg}
        if op is kind.ANY:
            return ALL - {10}
        if op is kind.RANGE:
            return frozenset(range(arg[0], arg[1] + 1))
        if op is kind.IN:
            negated = arg[0][0] is kind.NEGATE
            got = frozenset().union(*(self._set(*x) for x in arg[negated:]))
            return ALL - got if negated else got
        raise ValueError(f"{op} isn't regular or isn't supported")

    def closed(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


def byte_classes(nfas: list[_Nfa]) -> tuple[list[int], np.ndarray]:
    """A byte of each class of bytes that no move tells apart, and each byte's class."""
    sets = sorted({s for nfa in nfas for m in nfa.moves for s, _ in m}, key=sorted)
    seen: dict[tuple[bool, ...], int] = {}
    of_byte = np.array([seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)])
    return [int(np.flatnonzero(of_byte == c)[0]) for c in range(len(seen))], of_byte


class Rule:
    """A rule's pattern, and its narrower form that a match must have too to be kept, as one automaton with threads.

    A state lists the places where a match may have begun, leftmost first, each with the states it has reached. Once
    the first of them has a match, it alone goes on until it dies: that is the leftmost and longest match. Two things
    are asked of a pattern, and checked: a match that can grow stays a match, and no match is sure while one that began
    before it is still open.
    """

    def __init__(self, pattern: bytes, kept: bytes):
        self.nfa = _Nfa()
        self.begin = [self.nfa.state(), self.nfa.state()]
        self.end, self.kept_end = (self.nfa.add(parsed(p), b) for p, b in zip((pattern, kept), self.begin, strict=True))

    def compile(self, classes: list[int]) -> None:
        """``next[state, class]``, ``event`` (1 opens, 2 closes, 3 both) there, and whether states are open and kept."""
        nfa, inner = self.nfa, self._inner()
        moves = [{b: [to for s, to in m if b in s] for b in classes} for m in nfa.moves]
        first = nfa.closed(self.begin)

        def moved(t, b):
            return nfa.closed([to for s in t for to in moves[s][b]])

        number, todo, table, event = {((), False): 0}, [((), False)], [], []
        for threads, is_open in todo:
            row, told = [], []
            for b in classes:
                out, e = [], 0
                if is_open:
                    t = moved(threads[0], b)
                    if self.end in t:
                        out, now = [t], True
                    elif t & inner:
                        raise ValueError("a match that can grow must stay a match")
                    else:
                        e, now = 2, False
                if not out:
                    seen, now = set(), False
                    for t in (*(() if is_open else (moved(t, b) for t in threads)), moved(first, b)):
                        if not (t & inner) <= seen:
                            out.append(t)
                            seen |= t & inner
                    sure = [i for i, t in enumerate(out) if self.end in t]
                    if sure and sure[0]:
                        raise ValueError("a match may not be sure while an earlier one is open")
                    if sure:
                        out, now, e = out[:1], True, e + 1
                state = tuple(out), now
                if state not in number:
                    number[state] = len(number)
                    todo.append(state)
                    if len(number) > MOST_STATES:
                        raise ValueError(f"a rule needs more than {MOST_STATES} states")
                row.append(number[state])
                told.append(e)
            table.append(row)
            event.append(told)
        self.next, self.event = np.array(table), np.array(event)
        self.open = np.array([o for _, o in todo])
        self.kept = np.array([o and self.kept_end in t[0] for t, o in todo])

    def _inner(self) -> frozenset[int]:
        """States of the pattern itself, without those of its kept form."""
        seen, todo = {self.begin[0]}, [self.begin[0]]
        while todo:
            s = todo.pop()
            for to in (*self.nfa.free[s], *(x for _, x in self.nfa.moves[s])):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


def minimised(table: np.ndarray, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each state's class when states of one colour that no input tells apart are one, and a state of each class."""
    part, many = np.unique(colour, axis=0, return_inverse=True)[1].ravel(), 0
    while part.max() + 1 != many:
        many = int(part.max()) + 1
        part = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
    return part, np.unique(part, return_index=True)[1]


class Combined:
    """All rules as one minimal automaton: ``next[state, class]``, ``code`` of what a step tells, 0 for nothing.

    ``events[code]`` lists (rule, opens, closes, kept). ``at_end[state]`` lists (rule, kept) of matches still open.
    """

    def __init__(self, rules: list[tuple[bytes, bytes]]):
        own = [Rule(*r) for r in rules]
        classes, self.of_byte = byte_classes([r.nfa for r in own])
        for r in own:
            r.compile(classes)
        sizes = np.array([len(r.next) for r in own])
        radix = np.cumprod(np.append(1, sizes[:-1])).astype(object)
        if int(radix[-1]) * int(sizes[-1]) >= 1 << 62:
            raise ValueError("too many rules for one automaton")
        radix = radix.astype(np.int64)
        found, new = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(new):  # the states that all rules reach together, breadth first
            parts = new[:, None] // radix % sizes
            reached = np.unique(sum(r.next[parts[:, k]] * radix[k] for k, r in enumerate(own)))
            new = np.setdiff1d(reached, found, assume_unique=True)
            found = np.union1d(found, new)
            if len(found) > MOST_STATES:
                raise ValueError(f"the rules need more than {MOST_STATES} states")
        parts = found[:, None] // radix % sizes
        table = np.searchsorted(found, sum(r.next[parts[:, k]] * radix[k] for k, r in enumerate(own)))
        # What a step tells: two bits for each rule, and one for whether the match that closes is kept.
        step = sum((r.event[parts[:, k]] | np.where(r.event[parts[:, k]] & 2, 4 * r.kept[parts[:, k]][:, None], 0)).astype(np.int64) << (3 * k) for k, r in enumerate(own))
        last = sum((r.open[parts[:, k]] + 2 * r.kept[parts[:, k]]).astype(np.int64) << (2 * k) for k, r in enumerate(own))
        part, rep = minimised(table, np.column_stack([last, step]))
        start = part[0]
        order = np.argsort(np.arange(len(rep)) != start, kind="stable")  # the first state is 0
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        self.next = rank[part[table[rep[order]]]].astype(np.int32)
        codes, self.code = np.unique(np.append(0, step[rep[order]]), return_inverse=True)
        self.code = self.code[1:].reshape(self.next.shape).astype(np.int32)
        self.events = [tuple((k, bool(e & 1), bool(e & 2), bool(e & 4)) for k in range(len(own)) if (e := int(c) >> (3 * k) & 7)) for c in codes]
        self.at_end = [tuple((k, bool(e & 2)) for k in range(len(own)) if (e := int(x) >> (2 * k) & 3)) for x in last[rep[order]]]
        self.states = len(self.next)


def backward(pattern: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The pattern read from its end, anchored there: ``next[state, byte]``, which states are a whole match, the dead one."""
    nfa = _Nfa()
    begin = nfa.state()
    end = nfa.add(parsed(pattern, backward=True), begin)
    classes, of_byte = byte_classes([nfa])
    number, todo, table = {nfa.closed([begin]): 0}, [nfa.closed([begin])], []
    for now in todo:
        row = []
        for b in classes:
            got = nfa.closed([to for s in now for x, to in nfa.moves[s] if b in x])
            if got not in number:
                number[got] = len(number)
                todo.append(got)
                if len(number) > MOST_STATES:
                    raise ValueError(f"a rule needs more than {MOST_STATES} states")
            row.append(number[got])
        table.append(row)
    whole = np.array([end in s for s in todo])
    table = np.array(table)
    part, rep = minimised(table, whole)
    start = part[0]
    rank = np.argsort(np.argsort(np.arange(len(rep)) != start, kind="stable"))
    order = np.argsort(rank)
    new = rank[part[table[rep[order]]]][:, of_byte].astype(np.int32)
    dead = number.get(frozenset())
    return new, whole[rep[order]], -1 if dead is None else int(rank[part[dead]])
