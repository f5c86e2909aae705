"""Fields read from whole texts: tables of patterns per field, tried together and filtered by bounds.

A ``Field`` is data: patterns whose first group is a number, the factor that
brings it to the field's unit, the bounds of plausible values, and which values
count (``all`` from the largest, ``max`` or ``first``).  Patterns use no
lookaround, so another engine can run the same table.  Titles, landed pages and
raw segments differ only in the fields they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import throw_from_candela
from ..functions.text import word_pattern
from .specs import BOUNDS

_N = r"([0-9]{1,9}(?:,[0-9]{3})*(?:\.[0-9]{1,6})?)"
_HOURS = r"(?:hours?|hrs?|h)\b"
_MINUTES = r"(?:minutes?|mins?)\b"
_METRES = r"(?:meters?|metres?|m)\b"


@dataclass(frozen=True)
class Field:
    patterns: tuple[tuple[str, float], ...]
    low: float
    high: float
    pick: str = "all"


# fixed values: what each field looks like in prose, titles and spec tables
FIELDS: dict[str, Field] = {
    "lumens": Field(((rf"(?i){_N}\s*(?:lumens?|lms?)\b", 1.0), (rf"(?i)\b(?:max(?:imum)? output|light output|brightness|luminous flux)\s*(?:\(lumens?\))?\s*[:=-]?\s*{_N}", 1.0)), *BOUNDS["lumens"]),
    "candela": Field(((rf"(?i){_N}\s*(?:cd|candelas?)\b", 1.0), (rf"(?i)\b(?:candela|(?:beam )?intensity)\s*(?:\(cd\))?\s*[:=-]\s*{_N}", 1.0)), 10.0, 5_000_000.0, "max"),
    "throw_m": Field(
        (
            (rf"(?i)\b(?:beam distance|throw(?: distance)?|beam range|max(?:imum)? distance)\s*(?:\(m\))?\s*[:=-]?\s*(?:up to )?{_N}\s*{_METRES}", 1.0),
            (rf"(?i){_N}\s*{_METRES}\s+(?:beam|throw|range|distance)", 1.0),
            (rf"(?i)\b(?:beam distance|throw(?: distance)?|beam range)\s*(?:\(ft\))?\s*[:=-]?\s*(?:up to )?{_N}\s*(?:feet|foot|ft)\b", 0.3048),
            (rf"(?i){_N}\s*(?:feet|foot|ft)\s+(?:beam|throw|range|distance)", 0.3048),
            (rf"(?i){_N}\s*(?:yards?|yd)\s+(?:beam|throw|range|distance)", 0.9144),
        ),
        *BOUNDS["throw_m"],
        "max",
    ),
    "runtime_h": Field(((rf"(?i){_N}\s*{_HOURS}", 1.0), (rf"(?i)\brun[ -]?time\s*(?:\(min\))?\s*[:=-]?\s*{_N}\s*{_MINUTES}", 1 / 60), (rf"(?i){_N}\s*{_MINUTES}\s+(?:of )?run[ -]?time", 1 / 60), (rf"(?i){_N}\s*days?\b", 24.0)), *BOUNDS["runtime_h"]),
    "length_mm": Field(((rf"(?i)\b(?:overall )?length\s*(?:\(mm\))?\s*[:=-]?\s*{_N}\s*mm\b", 1.0), (rf"(?i){_N}\s*mm\s*(?:long|\(length\)|length)", 1.0), (rf"(?i)\blength\s*[:=-]?\s*{_N}\s*cm\b", 10.0), (rf"(?i)\blength\s*[:=-]?\s*{_N}\s*(?:inch(?:es)?|in)\b", 25.4)), *BOUNDS["length_mm"], "max"),
    "bezel_mm": Field(((rf"(?i)\b(?:head|bezel)(?: diameter)?\s*[:=-]?\s*{_N}\s*mm\b", 1.0), (rf"(?i){_N}\s*mm\s*\(?(?:head|bezel)", 1.0)), 5.0, 300.0, "max"),
    "body_mm": Field(((rf"(?i)\b(?:body|tube|handle)(?: diameter)?\s*[:=-]?\s*{_N}\s*mm\b", 1.0), (rf"(?i){_N}\s*mm\s*\(?(?:body|tube)", 1.0)), 5.0, 200.0, "max"),
    "weight_g": Field(((rf"(?i){_N}\s*(?:grams?|g)\b", 1.0), (rf"(?i){_N}\s*kg\b", 1000.0), (rf"(?i){_N}\s*(?:ounces?|oz)\b", 28.3495), (rf"(?i){_N}\s*(?:pounds?|lbs?)\b", 453.592)), *BOUNDS["weight_g"], "first"),
    "cri": Field(((r"(?i)\bcri\s*(?:of|>|:|=|≥)?\s*([0-9]{2,3})\b", 1.0), (r"(?i)\b([0-9]{2})\s*\+?\s*cri\b", 1.0)), *BOUNDS["cri"], "first"),
    "cct": Field(((r"(?i)\b([0-9]{4,5})\s*k\b", 1.0),), *BOUNDS["cct"]),
    "price": Field(((rf"[$€£]\s?{_N}", 1.0),), *BOUNDS["price"], "first"),
    "version": Field(((r"(?i)\bversion\s+([0-9]{1,3}(?:\.[0-9]{1,3})?)", 1.0),), 0.0, 100.0),
    "year": Field(((r"\b(20[12][0-9])\b", 1.0),), 2010.0, 2029.0, "max"),
}
#: Terms looked for as whole words, by field.
TERMS: dict[str, list[str]] = {
    "battery": ["18650", "21700", "26650", "18350", "16340", "14500", "cr123a", "cr2032", "aaa", "aa"],
    "material": ["aluminum", "aluminium", "titanium", "copper", "brass", "steel", "polymer", "nylon", "rubber"],
    "switch": ["tail switch", "side switch", "rotary", "push button", "twist", "electronic switch"],
    "features": ["clip", "magnet", "lanyard", "holster", "waterproof", "rechargeable", "strobe", "license", "copyright"],
    "charging": ["usb-c", "micro-usb", "magnetic charging", "wireless charging"],
    "blink": ["strobe", "sos", "beacon"],
}
TITLE_FIELDS = ("lumens", "throw_m", "cct", "cri")
#: The least plausible length of a body that holds a cell, by the cell's own length.
CELL_MM = {"21700": 70.0, "26650": 65.0, "18650": 65.0, "14500": 50.0, "aa": 50.0, "aaa": 44.0, "18350": 35.0, "16340": 34.0, "cr123a": 34.0}


#: Literals of which a text must have one, in any case, for any of the field's patterns to match; they spare most texts the patterns.
HINTS: dict[str, tuple[str, ...]] = {
    "lumens": ("lumen", "lm", "output", "brightness", "luminous flux"),
    "candela": ("cd", "candela", "intensity"),
    "throw_m": ("throw", "distance", "range", "beam"),
    "length_mm": ("length", "long"),
    "bezel_mm": ("head", "bezel"),
    "body_mm": ("body", "tube", "handle"),
    "cri": ("cri",),
    "price": ("$", "€", "£"),
    "version": ("version",),
    "year": ("201", "202"),
}


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    """One of the words stands anywhere in a lower-cased text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def values(text: Column, field: Field, may: Column | None = None) -> Column:
    """All plausible values in the order of the patterns, as double; none where ``may`` is false."""

    def scaled(pattern: str, factor: float) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if may is not None:
            found = F.when(may, found).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))
        return F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double") * F.lit(factor))

    return F.filter(F.concat(*[scaled(p, k) for p, k in field.patterns]), lambda v: v.between(field.low, field.high))


def extract(text: Column, name: str, low: Column | None = None) -> Column:
    """array<double> for an ``all`` field, else double; ``low``: a column that holds the text in lower case, to test the hints on."""
    field = FIELDS[name]
    v = values(text, field, has_any(low, HINTS[name]) if low is not None and name in HINTS else None)
    if field.pick == "all":
        return F.sort_array(F.array_distinct(v), asc=False)
    return F.array_max(v) if field.pick == "max" else F.get(v, 0)


def terms(low: Column, name: str) -> Column:
    """Which of a field's terms stand in a lower-cased text, in the table's order; the literal is looked for before its borders."""
    hit = lambda t: F.contains(low, F.lit(t)) & low.rlike(word_pattern(t.replace("-", r"\-")))
    return F.array_compact(F.array(*[F.when(hit(t), F.lit(t)) for t in TERMS[name]]))


def throw_or_candela(text: Column) -> Column:
    """The distance a text tells, else the one its intensity gives."""
    low, high = BOUNDS["throw_m"]
    derived = throw_from_candela(extract(text, "candela"))
    return F.coalesce(extract(text, "throw_m"), F.when(derived.between(low, high), derived))


def length_for_cell(length: Column, cells: Column) -> Column:
    """A length that is no shorter than its longest cell, else null."""
    table = F.create_map(*[x for k, v in sorted(CELL_MM.items()) for x in (F.lit(k), F.lit(v))])
    longest = F.coalesce(F.array_max(F.transform(cells, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0.0)))), F.lit(0.0))
    return F.when(length >= longest, length)


def mined(df: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """``df`` with its missing values read from its text; ``fields`` maps columns to fields, and what is there stays."""
    return df.withColumns({c: F.coalesce(F.col(c), extract(F.col(text), f)) for c, f in fields.items()})


# fixed values: the colours a finish is filed under, each with further words for it
COLOURS = {
    "black": "midnight", "white": "", "silver": "chrome", "gray": "grey gunmetal", "brown": "tan desert coyote", "red": "crimson", "pink": "rose",
    "orange": "", "yellow": "", "gold": "", "green": "olive", "teal": "", "blue": "navy", "purple": "violet", "copper": "", "brass": "", "camo": "",
}
COLOUR_WORDS = [(word, colour) for colour, more in COLOURS.items() for word in (colour, *more.split())]
COLOUR_CODES = {code: colour for colour, codes in {"black": "bk blk", "blue": "bl", "brown": "fde tn", "gray": "gy", "green": "od", "red": "rd", "silver": "sv"}.items() for code in codes.split()}


def model_colours(model: Column) -> Column:
    """All colours a model name tells, in table order; without any, the one of its suffix code."""
    low = F.lower(model)
    told = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in COLOUR_WORDS])))
    codes = F.create_map(*[F.lit(x) for pair in sorted(COLOUR_CODES.items()) for x in pair])
    code = F.try_element_at(codes, F.regexp_extract(low, "[- ]([a-z]{2,3})$", 1))
    return F.when(F.size(told) > 0, told).when(code.isNotNull(), F.array(code)).otherwise(F.array().cast("array<string>"))
