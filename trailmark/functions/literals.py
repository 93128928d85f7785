"""Literals that a text must hold before a pattern can match in it.

Most texts match no pattern, and one pass over a text finds all literals of
all patterns at once.  A pattern needs one of a set of literals: the longest
such set among the parts that every match must go through.
"""

from __future__ import annotations

from re import _parser as syntax

#: A class of so many characters counts as that many literals.
LARGEST_CLASS = 64


def _of_class(items: list) -> set[str] | None:
    chars: set[str] = set()
    for kind, value in items:
        if kind is syntax.LITERAL:
            chars.add(chr(value))
        elif kind is syntax.RANGE and value[1] - value[0] < LARGEST_CLASS:
            chars |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return {c.lower() for c in chars} if 0 < len(chars) <= LARGEST_CLASS else None


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer; the smaller on a tie."""
    rank = lambda s: (min(map(len, s)), -len(s))
    return max((s for s in (a, b) if s), key=rank, default=None)


def _needed(parts) -> set[str] | None:
    best, run = None, ""
    for kind, value in parts:
        if kind is syntax.LITERAL:
            run += chr(value).lower()
            continue
        best, run = _better(best, {run} if run else None), ""
        if kind is syntax.SUBPATTERN:
            found = _needed(value[-1])
        elif kind is syntax.BRANCH:
            each = [_needed(b) for b in value[1]]
            found = set().union(*each) if all(each) else None
        elif kind in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[0] > 0:
            found = _needed(value[2])
        else:
            found = _of_class(value) if kind is syntax.IN else None
        best = _better(best, found)
    return _better(best, {run} if run else None)


def needed_literals(pattern: str) -> frozenset[str]:
    """Lower-case literals of which any text that matches holds one, whatever
    its case; empty if the pattern needs none.
    """
    return frozenset(_needed(syntax.parse(pattern)) or ())
