"""Boolean trigram queries derived from regular expressions.

A query is a list of clauses that must all hold; a clause is a list of
alternatives; an alternative is a set of trigrams that must all occur in the
lower-cased text.  An empty query holds for every text.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

Query = list[list[frozenset[str]]]
#: Beyond so many alternative strings the run of literals is closed.
MOST = 64


def _strings(items, most: int = MOST) -> list[str] | None:
    """The finite set of strings that a piece of a pattern matches, or None."""
    out = [""]
    for kind, value in items:
        if kind is op.LITERAL:
            more = [chr(value)]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            more = [chr(v) for _, v in value]
        elif kind is op.SUBPATTERN:
            more = _strings(value[3])
        elif kind is op.BRANCH:
            each = [_strings(x) for x in value[1]]
            more = None if None in each else [s for x in each for s in x]
        elif kind is op.MAX_REPEAT and value[1] is not op.MAXREPEAT and value[1] <= 4:
            one = _strings(value[2])
            more = None
            if one is not None:
                more, run = [], [""]
                for n in range(value[1] + 1):
                    if n >= value[0]:
                        more += run
                    run = [a + b for a in run for b in one]
                    if len(run) > most:
                        return None
        elif kind is op.AT:
            more = [""]
        else:
            more = None
        if more is None or len(out) * len(more) > most:
            return None
        out = [a + b for a in out for b in more]
    return out


def _clause(strings: list[str]) -> list[list[frozenset[str]]]:
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in {s.lower() for s in strings}]
    if not sets or not all(sets):  # a string too short for a trigram: nothing is mandatory
        return []
    return [sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)]


def _walk(items) -> Query:
    query: Query = []
    run = [""]

    def close() -> None:
        nonlocal run
        query.extend(_clause(run))
        run = [""]

    for item in items:
        kind, value = item
        finite = _strings([item])
        if finite is not None:
            if len(run) * len(finite) > MOST:
                close()
            run = [a + b for a in run for b in finite]
            continue
        if kind is op.MAX_REPEAT and value[0] >= 1:
            one = _strings(value[2])
            if one is not None and len(run) * len(one) <= MOST:
                run = [a + b for a in run for b in one]
                close()
            else:
                close()
                query.extend(_walk(value[2]))
        elif kind is op.SUBPATTERN:
            close()
            query.extend(_walk(value[3]))
        elif kind is op.BRANCH:
            close()
            each = [_walk(x) for x in value[1]]
            if all(each):  # one clause of each branch is a weaker, safe condition
                query.append([alternative for q in each for alternative in q[0]])
        else:
            close()
    close()
    return query


def derive(pattern: str, ignore_case: bool = False) -> Query:
    """The trigram query that every text with a match of ``pattern`` fulfils."""
    return _walk(_parser.parse(pattern, re.ASCII | (re.IGNORECASE if ignore_case else 0)))


def trigrams(query: Query) -> set[str]:
    return {t for clause in query for alternative in clause for t in alternative}
