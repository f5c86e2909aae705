"""Cells as they are shown: units, placeholders, strings made of several values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "?"


def in_unit(value: Column, template: str) -> Column:
    """``value`` in place of ``{}``; null stays null."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def cell(value: Column, template: str = "{}") -> Column:
    return F.coalesce(F.when(value != "", in_unit(value, template)), F.lit(UNKNOWN))


def cell_list(items: Column, separator: str = " ") -> Column:
    return F.coalesce(F.when(F.size(items) > 0, F.array_join(items, separator)), F.lit(UNKNOWN))


def labelled(parts: list[tuple[Column, str]]) -> Column:
    """The templates whose value is there, filled, as an array."""
    return F.array_compact(F.array(*[in_unit(v, t) for v, t in parts]))


def mode_strings(lumens: Column, hours: Column, names: Column) -> Column:
    """``X lum / Yh`` for each place of either list; the name where both are missing."""
    zipped = F.arrays_zip(lumens.alias("l"), hours.alias("h"), names.alias("n"))
    figures = lambda m: F.array_compact(F.array(in_unit(m["l"], "{} lum"), in_unit(m["h"], "{}h")))
    return F.array_compact(F.transform(zipped, lambda m: F.when(F.size(figures(m)) > 0, F.array_join(figures(m), " / ")).otherwise(m["n"])))


def without_references(c: Column) -> Column:
    """Blanks for no-break spaces; the few references that display texts carry, decoded."""
    for name, char in (("&nbsp;", " "), (" ", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c
