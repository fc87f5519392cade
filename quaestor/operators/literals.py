"""Which of many patterns can match a text at all.

From a pattern's parse tree follow sets of literals; every match contains one literal of each set.  All literals of all
patterns go into one automaton, and a single scan of a text tells the patterns worth trying.  Patterns without such sets
are always tried, so nothing is lost.
"""

from collections.abc import Iterable
from re import _parser as P

import ahocorasick

#: Letters outside ASCII that match an ASCII letter when case is ignored (fixed values of Unicode's simple case folding).
FOLDED = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})


def fold(text: str) -> str:
    return text.translate(FOLDED).lower()


def _of_sequence(items: Iterable) -> list[frozenset]:
    found, run = [], ""
    for op, value in items:
        if op is P.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        found += [frozenset([run])] if run else []
        run = ""
        found += _of_item(op, value)
    return found + ([frozenset([run])] if run else [])


def _of_item(op, value) -> list[frozenset]:
    if op is P.SUBPATTERN:
        return _of_sequence(value[3])
    if op in (P.MAX_REPEAT, P.MIN_REPEAT, P.POSSESSIVE_REPEAT):
        return _of_sequence(value[2]) if value[0] > 0 else []
    if op is P.BRANCH:
        branches = [_of_sequence(branch) for branch in value[1]]
        # of each branch the set whose shortest literal is longest
        return [frozenset().union(*(max(b, key=lambda s: min(map(len, s))) for b in branches))] if all(branches) else []
    if op is P.ATOMIC_GROUP:
        return _of_sequence(value)
    return []  # classes, anchors, look-arounds, references


def required(pattern: str) -> frozenset[frozenset[str]]:
    """Sets of folded literals; every match contains one literal of each set."""
    return frozenset(_of_sequence(P.parse(pattern)))


class Screen:
    """Tells which patterns a text may match."""

    def __init__(self, patterns: list[str]):
        self.needs = [[*required(p)] for p in patterns]
        self.automaton = ahocorasick.Automaton()
        for literal in {x for needs in self.needs for s in needs for x in s}:
            self.automaton.add_word(literal, literal)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Numbers of the patterns to try, ascending."""
        found = set() if self.empty else {literal for _, literal in self.automaton.iter(fold(text))}
        return [i for i, needs in enumerate(self.needs) if not any(found.isdisjoint(s) for s in needs)]
