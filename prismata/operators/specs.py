"""Specifications from prose: numbers with units, keywords, prices.

Each extractor tries ordered patterns; bounds are data, and a value outside them
counts as not found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import TO_GRAM, TO_HOUR, TO_METRE, TO_MM, convert
from ..functions.text import SILENT, decoded, numbers_desc, without_elements

# fixed values: bounds of plausible values
BOUNDS = {"lumens": (0.1, 200000.0), "throw_m": (1.0, 3000.0), "length_mm": (15.0, 800.0), "weight_g": (5.0, 5000.0), "runtime_h": (0.01, 5000.0), "price": (5.0, 5000.0), "cri": (50.0, 100.0), "cct": (1800.0, 10000.0)}
_N = r"([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"


def _value(found: Column) -> Column:
    return F.regexp_replace(found, ",", "").try_cast("double")


def _with_unit(text: Column, pattern: str, factors: dict[str, float]) -> Column:
    """Every match of a (number, unit) pattern, converted by its own unit."""
    p = F.lit(pattern)
    rows = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("n"), F.regexp_extract_all(text, p, F.lit(2)).alias("u"))
    return F.transform(rows, lambda r: convert(_value(r["n"]), r["u"], factors))


def _bounded(values: Column, name: str) -> Column:
    low, high = BOUNDS[name]
    return F.filter(values, lambda v: (v >= low) & (v <= high))


def lumens(text: Column) -> Column:
    return numbers_desc(text, rf"(?i){_N}\s*(?:lumens?|lm)\b", *BOUNDS["lumens"])


def throw_m(text: Column) -> Column:
    """The largest distance, from metres, feet or yards; minutes after hours (``8h 30m``) are none."""
    return F.array_max(_bounded(_with_unit(text, rf"(?i)(?<![0-9.,])(?<![0-9]h)(?<![0-9]h\s){_N}\s*(m|ft|yd)\b", TO_METRE), "throw_m"))


def length_mm(text: Column) -> Column:
    return F.array_max(_bounded(_with_unit(text, rf"(?i){_N}\s*(mm|cm|in)\b", TO_MM), "length_mm"))


def weight_g(text: Column) -> Column:
    """The first weight."""
    return F.get(_bounded(_with_unit(text, rf"(?i){_N}\s*(g|kg|oz|lb)\b", TO_GRAM), "weight_g"), 0)


def runtime_h(text: Column) -> Column:
    """All runtimes: hours, minutes, days, H:MM and 1h30m; longest first."""
    plain = _with_unit(text, rf"(?i){_N}\s*(h|min|d)(?:ours?|utes?|ays?)?\b", TO_HOUR)
    clock = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,2}:[0-5][0-9])\s*h"), F.lit(1)), lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("double") + F.split_part(x, F.lit(":"), F.lit(2)).cast("double") / 60)
    mixed = F.zip_with(F.regexp_extract_all(text, F.lit(r"(?i)\b([0-9]+)h\s?[0-9]+m\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?i)\b[0-9]+h\s?([0-9]+)m\b"), F.lit(1)), lambda h, m: h.cast("double") + m.cast("double") / 60)
    return F.sort_array(F.array_distinct(_bounded(F.concat(plain, clock, mixed), "runtime_h")), asc=False)


def ip_rating(text: Column) -> Column:
    v = F.upper(F.regexp_extract(text, r"(?i)\b(IP[X0-9][0-9])\b", 1))
    return F.when(v != "", v)


def price(html: Column) -> Column:
    """Structured price, then linked data, then the first amount in the text."""
    low, high = BOUNDS["price"]
    tries = [r'(?i)itemprop="price"[^>]*content="([0-9.,]+)"', r'(?i)"price"\s*:\s*"?([0-9.,]+)"?', r"[$€£]\s?([0-9][0-9,]*\.?[0-9]*)"]
    values = [_value(F.regexp_extract(html, t, 1)) for t in tries]
    return F.coalesce(*[F.when(v.between(low, high), v) for v in values])


# fixed values: bounds of a price told in prose
TOLD_PRICE = (5.0, 3000.0)
_AMOUNT = r"\$([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{2})?|[0-9]{1,7}(?:\.[0-9]{2})?)"


def told_price(text: Column) -> Column:
    """The list price, else the first amount that is written twice on end, else the one behind the word price; each only if plausible."""
    low, high = TOLD_PRICE
    fine = lambda v: F.when(v.between(low, high), v)
    first = lambda pattern: fine(_value(F.regexp_extract(text, pattern, 1)))
    pair = F.lit(_AMOUNT + _AMOUNT)
    both = F.arrays_zip(F.regexp_extract_all(text, pair, F.lit(1)).alias("a"), F.regexp_extract_all(text, pair, F.lit(2)).alias("b"))
    twice = F.get(F.filter(both, lambda p: p["a"] == p["b"]), 0)["a"]
    return F.coalesce(first(rf"(?i)\b(?:list(?: price)?|msrp|retail)[:\s]*{_AMOUNT}"), fine(_value(twice)), first(rf"(?i)\bprice[:\s]+{_AMOUNT}"))


#: Lengths of a section's text that is worth keeping.
SECTION_CHARS = (30, 5000)


def sections(html: Column, names: dict[str, str], chars: tuple[int, int] = SECTION_CHARS) -> Column:
    """array of (heading, category, text) of what stands under each heading, in page order.

    The category is the first whose pattern the lower-cased heading matches,
    else ``other``; texts that are too short or too long are left out.  The page
    is cut once before each heading, so the cost is linear.
    """
    plain = lambda x: F.trim(F.regexp_replace(decoded(F.regexp_replace(x, "<[^<>]*>", " ")), r"\s+", " "))
    pieces = F.filter(F.split(without_elements(html, SILENT), r"(?i)(?=<h[1-6]\b)"), lambda p: p.rlike(r"(?i)^<h[1-6]\b"))

    def one(parts: Column) -> Column:
        heading = plain(F.get(parts, F.lit(0)))
        category = F.lit("other")
        for name, pattern in reversed(names.items()):
            category = F.when(F.lower(heading).rlike(pattern), F.lit(name)).otherwise(category)
        return F.struct(heading.alias("heading"), category.alias("category"), plain(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("text"))

    cut = F.transform(pieces, lambda p: F.split(p, r"(?i)</h[1-6]\s*>", 2))
    return F.filter(F.transform(cut, one), lambda s: F.length(s["text"]).between(*chars))


def validated(record: Column, numbers: dict[str, tuple[float, float]]) -> Column:
    """A JSON record as a map of the known numeric keys whose values are inside their bounds."""
    m = F.from_json(record, "map<string, string>")
    keep = F.map_filter(m, lambda k, v: k.isin(list(numbers)))
    known = F.create_map(*[x for k, (a, b) in sorted(numbers.items()) for x in (F.lit(k), F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")))])
    number = F.transform_values(keep, lambda k, v: v.try_cast("double"))
    return F.map_filter(number, lambda k, v: v.between(F.element_at(known, k)["low"], F.element_at(known, k)["high"]))
