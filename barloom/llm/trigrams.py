"""Boolean trigram queries derived from regular expressions.

For each part of a parsed expression five facts are kept: whether it can match nothing, the
finite set of strings it can be (or None), sets of strings that every match starts and ends
with, and a query that every match's text satisfies. Alternatives are combined with OR, what
stands in a row with AND and with the strings that arise where parts meet.

A query is True (no demand), a trigram, ("and", ...) or ("or", ...). Letters are folded to
lower case throughout, so a query serves any case.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # Python before 3.11
    import sre_constants as C
    import sre_parse as P

#: Strings kept exactly, or as starts and ends, before they are cut down to a query.
MOST = 24
#: Characters of a class that are spelled out.
CLASS = 8

Query = object


def both(*queries: Query) -> Query:
    flat = [p for q in queries if q is not True for p in (q[1:] if isinstance(q, tuple) and q[0] == "and" else (q,))]
    parts = list(dict.fromkeys(flat))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def either(*queries: Query) -> Query:
    flat = [p for q in queries for p in (q[1:] if isinstance(q, tuple) and q[0] == "or" else (q,))]
    parts = list(dict.fromkeys(flat))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def of_string(s: str) -> Query:
    return both(*[s[i : i + 3] for i in range(len(s) - 2)])


def of_any(strings: frozenset[str]) -> Query:
    return either(*[of_string(s) for s in sorted(strings)]) if strings else True


@dataclass(frozen=True)
class Facts:
    empty: bool
    exact: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    query: Query


ANY = Facts(False, None, frozenset({""}), frozenset({""}), True)
ANYTHING = Facts(True, None, frozenset({""}), frozenset({""}), True)
NOTHING = Facts(True, frozenset({""}), frozenset({""}), frozenset({""}), True)


def _exactly(strings: frozenset[str]) -> Facts:
    return Facts("" in strings, strings, strings, strings, True)


def _shrunk(f: Facts) -> Facts:
    """Turn too many strings, and long starts and ends, into demands."""
    exact, starts, ends, query = f.exact, f.starts, f.ends, f.query
    if exact is not None and (len(exact) > MOST or (exact and min(map(len, exact)) >= 12)):
        query, exact = both(query, of_any(exact)), None
    if exact is None:
        query = both(query, of_any(starts), of_any(ends))
        keep = 3
        starts, ends = frozenset(s[:keep] for s in starts), frozenset(s[-keep:] for s in ends)
        while keep and (len(starts) > MOST or len(ends) > MOST):
            keep -= 1
            starts, ends = frozenset(s[:keep] for s in starts), frozenset(s[-keep:] if keep else "" for s in ends)
    return Facts(f.empty, exact, starts, ends, query)


def _then(a: Facts, b: Facts) -> Facts:
    cross = lambda x, y: frozenset(p + q for p, q in product(x, y))
    exact = cross(a.exact, b.exact) if a.exact is not None and b.exact is not None else None
    starts = cross(a.exact, b.starts) if a.exact is not None else a.starts | b.starts if a.empty else a.starts
    ends = cross(a.ends, b.exact) if b.exact is not None else b.ends | a.ends if b.empty else b.ends
    query = both(a.query, b.query)
    if exact is None and len(a.ends) * len(b.starts) <= MOST * MOST:
        query = both(query, of_any(cross(a.ends, b.starts)))
    return _shrunk(Facts(a.empty and b.empty, exact, starts, ends, query))


def _or(a: Facts, b: Facts) -> Facts:
    if a.exact is not None and b.exact is not None:
        return _shrunk(_exactly(a.exact | b.exact))
    flat = lambda f: both(f.query, of_any(f.exact)) if f.exact is not None else f.query
    return _shrunk(Facts(a.empty or b.empty, None, a.starts | b.starts, a.ends | b.ends, either(flat(a), flat(b))))


def _class(items: list) -> Facts:
    chars: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            chars.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 2 * CLASS:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return ANY
    return _exactly(frozenset(chars)) if len(chars) <= CLASS else ANY


def _facts(parsed) -> Facts:
    out = NOTHING
    for op, arg in parsed:
        if op is C.LITERAL:
            part = _exactly(frozenset({chr(arg).lower()}))
        elif op is C.IN:
            part = _class(arg)
        elif op is C.SUBPATTERN:
            part = _facts(arg[-1])
        elif op is C.BRANCH:
            part = _facts(arg[1][0])
            for other in arg[1][1:]:
                part = _or(part, _facts(other))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            once = _facts(inner)
            if least == 0:
                part = _or(once, NOTHING) if most == 1 else ANYTHING
            else:
                part = once
                for _ in range(min(least, 8) - 1):
                    part = _then(part, once)
                if most != least or least > 8:
                    part = _then(part, ANYTHING)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            part = NOTHING
        elif op in (C.ANY, C.NOT_LITERAL):
            part = ANY
        else:
            part = ANYTHING
        out = _then(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """What the trigrams of any text must satisfy for ``pattern`` to match in it; True if nothing is certain."""
    f = _facts(P.parse(pattern, re.ASCII))
    if f.exact is not None:
        return both(f.query, of_any(f.exact))
    return both(f.query, of_any(f.starts), of_any(f.ends))


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1:]))


def candidates(query: Query, postings: Callable[[str], set[int]], everything: set[int]) -> set[int]:
    """Documents that satisfy a query: postings intersected for AND, united for OR."""
    if query is True:
        return everything
    if isinstance(query, str):
        return postings(query)
    if query[0] == "and":
        found = everything
        for q in sorted(query[1:], key=lambda q: not isinstance(q, str)):
            found = found & candidates(q, postings, everything)
            if not found:
                break
        return found
    return set().union(*[candidates(q, postings, everything) for q in query[1:]])
