"""The shareable form of a faceted search: URL text to and from a ``Spec``.

``col=[mode,]v1,v2[,inc|dec][,?]`` for sets, ``col=yes1,~no1`` for yes/no lists,
``col=lo|_,hi|_[,inc|dec][,?]`` for ranges; values are percent-encoded, so
commas inside an option survive.  ``q`` holds the search words.
"""

from __future__ import annotations

import math
from urllib.parse import quote, unquote_plus

from ..functions.numbers import parse_si
from .facets import Facet, Multi, Range, Spec, YesNo

WORDS = "q"
DIRECTIONS = {"inc": False, "dec": True}


def parse(url: str, facets: list[Facet]) -> Spec:
    raw: dict[str, list[str]] = {}
    for piece in url.partition("?")[2].partition("#")[0].split("&"):
        name, eq, value = piece.partition("=")
        if eq:
            raw.setdefault(unquote_plus(name), value.split(","))
    filters: list[Multi | YesNo | Range] = []
    sort, descending = None, True
    for f in facets:
        parts = raw.get(f.column)
        if not parts:
            continue
        unknown = "?" in parts
        parts = [p for p in parts if p != "?"]
        if parts and parts[-1] in DIRECTIONS:
            sort, descending = f.column, DIRECTIONS[parts.pop()]
        if f.kind == "range":
            low, high = ((parse_si(unquote_plus(p)) if p and p != "_" else None) for p in (*parts, "_", "_")[:2])
            low, high = (None if v is None or math.isnan(v) else v for v in (low, high))
            if low is not None or high is not None:
                filters.append(Range(f.column, low, high, unknown))
            continue
        mode = f.modes[0]
        if parts and parts[0] in f.modes:
            mode = parts.pop(0)
        values = [unquote_plus(p) for p in parts if p and p != "_"]
        if f.kind == "boolean":
            no = tuple(v[1:] for v in values if v.startswith("~"))
            yes = tuple(v for v in values if not v.startswith("~"))
            if yes or no:
                filters.append(YesNo(f.column, yes, no, mode, unknown))
        elif values:
            filters.append(Multi(f.column, tuple(values), mode, unknown))
    return Spec(tuple(filters), sort, descending, unquote_plus(",".join(raw.get(WORDS, []))))


def _number(v: float | None, edge: float) -> str:
    return "_" if v is None or v == edge else f"{v:g}"


def serialise(spec: Spec, facets: list[Facet]) -> str:
    """The shortest form: default modes and bounds at a facet's edge are left out."""
    by = {f.column: f for f in spec.filters}
    out = []
    for f in facets:
        chosen, parts = by.get(f.column), []
        if isinstance(chosen, Range):
            parts = [_number(chosen.low, f.low), _number(chosen.high, f.high)]
        elif chosen is not None:
            if chosen.mode != f.modes[0]:
                parts.append(chosen.mode)
            values = chosen.selected if isinstance(chosen, Multi) else (*chosen.yes, *("~" + v for v in chosen.no))
            parts += [quote(v, safe="~") for v in values]
        if spec.sort == f.column:
            parts = [*(parts or ["_", "_"]), "dec" if spec.descending else "inc"]
        if not parts or parts == ["_", "_"]:
            continue
        if chosen is not None and chosen.unknown:
            parts.append("?")
        out.append(f"{quote(f.column)}={','.join(parts)}")
    if spec.words:
        out.append(f"{WORDS}={quote(spec.words)}")
    return "?" + "&".join(out) if out else ""
