"""Numbers: units, rounding, light formulas, SI prefixes, slider positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: conversion factors
TO_MM = {"mm": 1.0, "cm": 10.0, "in": 25.4}
TO_GRAM = {"g": 1.0, "kg": 1000.0, "oz": 28.3495, "lb": 453.592}
TO_METRE = {"m": 1.0, "ft": 0.3048, "yd": 0.9144}
TO_HOUR = {"h": 1.0, "min": 1 / 60, "d": 24.0}


def round_half_up(c: Column, digits: int = 0) -> Column:
    """floor(x + 0.5), also for negative numbers."""
    k = 10.0**digits
    return F.floor(c * k + 0.5) / k if digits else F.floor(c + 0.5)


def convert(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """``value`` times the factor of its captured unit; null for an unknown unit."""
    out = F.lit(None).cast("double")
    for u, k in factors.items():
        out = F.when(F.lower(unit) == u, value * F.lit(k)).otherwise(out)
    return out


def throw_from_candela(cd: Column) -> Column:
    return 2 * F.sqrt(cd)


def candela_from_throw(metres: Column) -> Column:
    return F.pow(metres / 2, F.lit(2.0))


def percent_below(low: Column, price: Column) -> Column:
    return round_half_up((low - price) / low * 100)


def fixed_text(c: Column, digits: int) -> Column:
    """``c`` with up to two ``digits`` after the point, as C's printf writes it.

    The exact binary value is rounded, halves to the even digit; ``format_string``
    rounds the shortest decimal and halves up.  A part below one has at most 60
    bits that can tell a digit, so all steps are exact in a long.
    """
    ten = 10**digits
    a = F.abs(c)
    whole = F.floor(a)
    scale = F.when(a < 0.0625, F.lit(2**60)).otherwise(F.lit(2**56))
    units = ((a - whole) * scale).cast("long") * F.lit(ten)
    rest = units % scale
    kept = whole * F.lit(ten) + ((units - rest) / scale).cast("long")
    half = (scale / 2).cast("long")
    n = kept + ((rest > half) | ((rest == half) & (kept % 2 == 1))).cast("long")
    point = [F.lit("."), F.lpad((n % F.lit(ten)).cast("string"), digits, "0")] if digits else []
    text = F.concat(F.call_function("div", n, F.lit(ten)).cast("string"), *point)
    # beyond 2^53 there is no part below one; not a number and infinities have no digits
    exact = F.concat(F.when(F.startswith(c.cast("string"), F.lit("-")), "-").otherwise(""), text)
    return F.when(a < F.lit(2.0**53), exact).when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def si_text(c: Column) -> Column:
    """Three significant digits with k, M or G: 4500 -> 4.50k."""
    a = F.abs(c)
    scaled = F.when(a >= 1e9, c / 1e9).when(a >= 1e6, c / 1e6).when(a >= 1e3, c / 1e3).otherwise(c)
    prefix = F.when(a >= 1e9, "G").when(a >= 1e6, "M").when(a >= 1e3, "k").otherwise("")
    b = F.abs(scaled)
    digits = F.when(b >= 100, fixed_text(scaled, 0)).when(b >= 10, fixed_text(scaled, 1)).otherwise(fixed_text(scaled, 2))
    return F.concat(digits, prefix)


def si_value(text: Column) -> Column:
    """4.5k -> 4500; null for other text."""
    number = F.regexp_extract(text, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([kMGmu]?)\s*$", 1)
    prefix = F.regexp_extract(text, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([kMGmu]?)\s*$", 2)
    k = F.when(prefix == "k", 1e3).when(prefix == "M", 1e6).when(prefix == "G", 1e9).when(prefix == "m", 1e-3).when(prefix == "u", 1e-6).otherwise(1.0)
    return F.when(number != "", number.cast("double") * k)


def parse_si(text: str) -> float:
    """Driver-side twin of ``si_value``; NaN for other text."""
    scale = {"k": 1e3, "M": 1e6, "G": 1e9, "m": 1e-3, "u": 1e-6}
    text = text.strip()
    try:
        return float(text[:-1]) * scale[text[-1]] if text and text[-1] in scale else float(text)
    except ValueError:
        return math.nan


def slider_value(position: Column, low: float, high: float) -> Column:
    """Value at a slider position of 0 to 1 on a logarithmic scale: m ** p + b."""
    b = low - 1
    return F.pow(F.lit(float(high - b)), position) + F.lit(float(b))


def slider_position(value: Column, low: float, high: float) -> Column:
    b = low - 1
    return F.ln(value - F.lit(float(b))) / F.lit(math.log(high - b))


def beam_repaired(candela: Column, metres: Column, most: float = 500_000.0, suspect: float = 100_000.0, short: float = 300.0) -> tuple[Column, Column]:
    """(candela, metres) that agree: intensity is trusted unless it is bogus, that is too large for any or for such a distance."""
    bogus = (candela > most) | ((candela > suspect) & (metres < short))
    return F.when(bogus, candela_from_throw(metres)).otherwise(candela), F.when(bogus, metres).otherwise(throw_from_candela(candela))
