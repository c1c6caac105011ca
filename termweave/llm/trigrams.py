"""Trigram queries that a regular expression's matches must meet, derived from its syntax tree."""

from __future__ import annotations

from re import _constants as op
from re import _parser
from itertools import product

#: A query is a disjunction of conjunctions of trigrams; one with the empty conjunction holds for every text.
Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])
MOST_STRINGS, MOST_CLAUSES = 64, 64


def _absorbed(clauses) -> Query:
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _or(a: Query, b: Query) -> Query:
    return _absorbed(a | b)


def _and(a: Query, b: Query) -> Query:
    both = _absorbed(x | y for x, y in product(a, b))
    return both if len(both) <= MOST_CLAUSES else min(a, b, key=len)


def _of_strings(strings: frozenset[str]) -> Query:
    return _absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


class _Part:
    """What is known of a part's matches: all of them if few (exact), else how they begin and end, and a query they meet."""

    def __init__(self, exact: frozenset[str] | None, begins=frozenset([""]), ends=frozenset([""]), query: Query = ALL):
        self.exact, self.query = exact, query
        self.begins, self.ends = (exact, exact) if exact is not None else (begins, ends)

    def opened(self) -> "_Part":
        """The same with exact given up; beginnings and ends are cut to what a neighbouring trigram can use."""
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _of_strings(self.exact))

    def then(self, other: "_Part") -> "_Part":
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST_STRINGS:
            return _Part(frozenset(a + b for a, b in product(self.exact, other.exact)))
        a, b = self.opened(), other.opened()
        seam = _of_strings(frozenset(x + y for x, y in product(a.ends, b.begins)))
        whole_a = self.exact is not None and all(len(s) < 2 for s in self.exact)
        whole_b = other.exact is not None and all(len(s) < 2 for s in other.exact)
        begins = frozenset((x + y)[:2] for x, y in product(self.exact, b.begins)) if whole_a else a.begins
        ends = frozenset((x + y)[-2:] for x, y in product(a.ends, other.exact)) if whole_b else b.ends
        return _Part(None, begins, ends, _and(_and(a.query, b.query), seam))

    def either(self, other: "_Part") -> "_Part":
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= MOST_STRINGS:
            return _Part(self.exact | other.exact)
        a, b = self.opened(), other.opened()
        return _Part(None, a.begins | b.begins, a.ends | b.ends, _or(a.query, b.query))


ANY, EMPTY = _Part(None), _Part(frozenset([""]))


def _sequence(items) -> _Part:
    out = EMPTY
    for kind, value in items:
        out = out.then(_part(kind, value))
    return out


def _part(kind, value) -> _Part:
    if kind is op.LITERAL:
        return _Part(frozenset([chr(value).lower()]))
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
        return _Part(frozenset(chr(c).lower() for _, c in value))
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out.either(p)
        return out
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        inner = _sequence(inner)
        if (least, most) == (0, 1):
            return inner.either(EMPTY)
        if least == 0:
            return ANY
        out = inner
        for _ in range(min(least, 3) - 1):
            out = out.then(inner)
        return out if least == most <= 3 else _Part(None, out.opened().begins, inner.opened().ends, out.opened().query)
    if kind is op.AT:
        return EMPTY
    return ANY


def trigram_query(pattern: str) -> Query:
    """A query over trigrams of the lower-cased text that every text with a match meets; ALL if there is none."""
    return _sequence(_parser.parse(pattern)).opened().query
