"""One deterministic automaton for several regular grammars.

Productions without look-around and back references are joined into one non-deterministic automaton, which is made
deterministic by subset construction as characters come: a state is a set of positions in the productions, its successor for
a character is found once and kept.  From a place in a text the automaton is led along until no production can go on; the
longest text that some production accepts is the result, whatever its length.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser as parser

_CATEGORIES = {
    C.CATEGORY_DIGIT: str.isdigit, C.CATEGORY_SPACE: str.isspace, C.CATEGORY_WORD: lambda c: c.isalnum() or c == "_",
    C.CATEGORY_NOT_DIGIT: lambda c: not c.isdigit(), C.CATEGORY_NOT_SPACE: lambda c: not c.isspace(), C.CATEGORY_NOT_WORD: lambda c: not (c.isalnum() or c == "_"),
}


def _accepts(op, arg, c: str) -> bool:
    """Whether one element of a production takes a character."""
    if op is C.LITERAL:
        return ord(c) == arg
    if op is C.NOT_LITERAL:
        return ord(c) != arg
    if op is C.ANY:
        return c != "\n"
    if op is C.CATEGORY:
        return _CATEGORIES[arg](c)
    if op is C.RANGE:
        return arg[0] <= ord(c) <= arg[1]
    if op is C.IN:
        negate = arg[0][0] is C.NEGATE
        return any(_accepts(o, a, c) for o, a in arg[negate:]) != negate
    raise ValueError(f"no rule for {op}")


class Automaton:
    def __init__(self, productions: dict[str, str]):
        #: position -> elements that lead on, and positions that are reached without a character
        self.on: list[list[tuple[tuple, int]]] = []
        self.free: list[list[int]] = []
        self.tag: dict[int, str] = {}
        begin = self._position()
        for tag, pattern in productions.items():
            end = self._build(list(parser.parse(pattern)), self._link(begin))
            self.tag[end] = tag
        self.start = self._closed({begin})
        #: state -> character -> state or None; state -> tag or None
        self.next: dict[frozenset[int], dict[str, frozenset[int] | None]] = {}
        self.found: dict[frozenset[int], str | None] = {}

    def _position(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def _link(self, a: int) -> int:
        b = self._position()
        self.free[a].append(b)
        return b

    def _build(self, tree: list, at: int) -> int:
        for op, arg in tree:
            if op is C.SUBPATTERN:
                at = self._build(list(arg[3]), at)
            elif op is C.BRANCH:
                end = self._position()
                for part in arg[1]:
                    self.free[self._build(list(part), self._link(at))].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                least, most, part = arg
                for _ in range(least):
                    at = self._build(list(part), at)
                if most is C.MAXREPEAT:
                    again = self._link(at)
                    self.free[self._build(list(part), again)].append(again)
                    at = self._link(again)
                else:
                    ways = [at]
                    for _ in range(most - least):
                        at = self._build(list(part), at)
                        ways.append(at)
                    end = self._position()
                    for w in ways:
                        self.free[w].append(end)
                    at = end
            else:
                _accepts(op, arg, "a")  # refuses what is no single character
                b = self._position()
                self.on[at].append(((op, arg), b))
                at = b
        return at

    def _closed(self, positions: set[int]) -> frozenset[int]:
        todo, seen = list(positions), set(positions)
        while todo:
            for b in self.free[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    def _step(self, state: frozenset[int], c: str) -> frozenset[int] | None:
        ahead = {b for a in state for (op, arg), b in self.on[a] if _accepts(op, arg, c)}
        return self._closed(ahead) if ahead else None

    def longest(self, text: str, at: int) -> tuple[str, int] | None:
        """(production, end) of the longest text from ``at`` on that a production accepts; of equal ones the first production."""
        state, best = self.start, None
        for i in range(at, len(text)):
            c = text[i]
            ways = self.next.get(state)
            if ways is None:
                ways = self.next[state] = {}
            if c in ways:
                state = ways[c]
            else:
                if len(ways) > 2000:
                    ways.clear()
                state = ways[c] = self._step(state, c)
            if state is None:
                break
            if state in self.found:
                tag = self.found[state]
            else:
                ends = [p for p in state if p in self.tag]
                tag = self.found[state] = self.tag[min(ends)] if ends else None
            if tag:
                best = tag, i + 1
        return best
