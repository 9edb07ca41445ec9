"""Cheap tests that have to hold where a pattern matches.

A pattern tells by its own syntax tree which literals every match has: of a
sequence any part's, of alternatives one of each. Looking for these first
spares the costly matching wherever there is nothing to match.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a pattern that are asked for, and literals of a part, at most: more cost more than they spare.
PARTS, LITERALS = 2, 40


def _parts(seq, fold: bool) -> list[frozenset[str]]:
    """Sets of literals, of each of which every match of the sequence has one."""
    out: list[frozenset[str]] = []
    run = ""
    for op, arg in [*seq, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg).lower() if fold else chr(arg)
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is C.SUBPATTERN:
            out += _parts(arg[3], fold)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out += _parts(arg[2], fold)
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in arg):
            out.append(frozenset(chr(c).lower() if fold else chr(c) for _, c in arg))
        elif op is C.BRANCH:
            each = [_best(_parts(alternative, fold)) for alternative in arg[1]]
            if all(each):
                out.append(frozenset().union(*each))
    return out


def _rank(part: frozenset[str]) -> tuple[int, int]:
    return -min(map(len, part)), len(part)


def _best(parts: list[frozenset[str]]) -> frozenset[str]:
    return min(parts, key=_rank, default=frozenset())


@cache
def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Up to PARTS sets of literals, lower-cased where the pattern ignores case, of each of which every match has one."""
    tree = _parser.parse(pattern)
    parts = [p for p in set(_parts(tree, bool(tree.state.flags & re.IGNORECASE))) if len(p) <= LITERALS]
    # what holds another literal says nothing new
    kept: list[frozenset[str]] = []
    for p in sorted(parts, key=lambda p: (_rank(p), sorted(p))):
        if len(kept) < PARTS and not any(all(any(a in b for a in p) for b in k) for k in kept):
            kept.append(p)
    return tuple(tuple(sorted(p)) for p in kept)


def folded(t: Column) -> Column:
    """The text in lower case, with the letters that match others without regard to case replaced by these."""
    return F.translate(F.lower(t), "ſı", "si")


def may_match(t: Column, low: Column, pattern: str) -> Column:
    """Whether the text has what a match would need; `low` is the folded text."""
    text = low if _parser.parse(pattern).state.flags & re.IGNORECASE else t
    one = lambda literals: reduce(lambda a, b: a | b, [text.contains(x) for x in literals])
    return reduce(lambda a, b: a & b, map(one, needed(pattern)), F.lit(True))
