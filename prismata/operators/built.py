"""The built table: one display row for each canonical entry.

``COLUMNS`` maps each column of the built table to an expression over an entry,
so that a caller takes the columns it needs and pruning leaves the rest unread.
An empty value is null, an empty list an empty array; lists of terms go through
their vocabularies; implausible weights and impacts count as missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import labelled, mode_strings
from ..functions.text import title_case
from .vocabulary import NORMALISERS

#: What an entry has; other columns are carried by name only where they are asked for.
ENTRY = {
    "model": "string", "brand": "string", "type": "array<string>", "led": "array<string>", "led_options": "array<string>", "led_color": "array<string>", "battery": "array<string>", "wh": "double",
    "lumens": "array<double>", "runtime_hours": "array<double>", "modes": "array<string>", "levels": "int", "blink": "array<string>", "features": "array<string>", "intensity_cd": "double", "throw_m": "double",
    "switch": "array<string>", "color": "array<string>", "length_mm": "double", "bezel_mm": "double", "body_mm": "double", "weight_g": "double", "material": "array<string>", "impact": "array<string>",
    "environment": "array<string>", "efficacy": "double", "beam_angle": "double", "year": "int", "image_urls": "array<string>", "info_urls": "array<string>", "purchase_urls": "array<string>", "price_usd": "double",
}
HEAVIEST_G, DEEPEST_FALL_M, MANY_LEVELS = 5000, 10, 6


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(ENTRY[name]))


def _plain(value: Column) -> Column:
    """A number as it is written: without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _terms(name: str, vocabulary: str) -> Column:
    return F.coalesce(NORMALISERS[vocabulary](F.col(name)), F.array().cast("array<string>"))


def _levels() -> Column:
    n = F.col("levels")
    return F.when(n.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.when(n >= MANY_LEVELS, F.lit(f"{MANY_LEVELS}+")).otherwise(n.cast("string"))))


def _measurements() -> Column:
    some = lambda c: _plain(F.when(F.col(c) > 0, F.col(c)))
    return labelled([(some("length_mm"), "{}mm"), (some("bezel_mm"), "⌀{}mm head"), (some("body_mm"), "⌀{}mm body"), (some("weight_g"), "{}g")])


def _impact() -> Column:
    first = F.get(F.col("impact"), 0)
    metres = F.regexp_extract(first, r"^\s*([0-9]+(?:\.[0-9]+)?|\.[0-9]+)", 1).try_cast("double")
    return F.when(metres <= DEEPEST_FALL_M, metres)


def _modes() -> Column:
    figures = lambda c: F.transform(_list(c), _plain)
    return mode_strings(figures("lumens"), figures("runtime_hours"), _list("modes"))


COLUMNS: dict[str, Callable[[], Column]] = {
    "model": lambda: F.col("model"),
    "_pic": lambda: F.get(F.col("image_urls"), 0),
    "info": lambda: _list("info_urls"),
    "brand": lambda: title_case(F.trim("brand")),
    "type": lambda: _list("type"),
    "led": lambda: _terms("led", "led"),
    "led_options": lambda: _terms("led_options", "led"),
    "battery": lambda: _terms("battery", "battery"),
    "wh": lambda: F.col("wh"),
    "lumens": lambda: _list("lumens"),
    "runtime": lambda: _list("runtime_hours"),
    "blink": lambda: _list("blink"),
    "levels": _levels,
    "modes": _modes,
    "features": lambda: _terms("features", "features"),
    "intensity": lambda: F.col("intensity_cd"),
    "throw": lambda: F.col("throw_m"),
    "led_color": lambda: _list("led_color"),
    "switch": lambda: _terms("switch", "switch"),
    "color": lambda: _list("color"),
    "length": lambda: F.col("length_mm"),
    "bezel_size": lambda: F.col("bezel_mm"),
    "body_size": lambda: F.col("body_mm"),
    "measurements": _measurements,
    "weight": lambda: F.when((F.col("weight_g") > 0) & (F.col("weight_g") <= HEAVIEST_G), F.col("weight_g")),
    "material": lambda: _terms("material", "material"),
    "impact": _impact,
    "environment": lambda: _list("environment"),
    "efficacy": lambda: F.col("efficacy"),
    "beam_angle": lambda: F.col("beam_angle"),
    "year": lambda: F.col("year"),
    "purchase": lambda: _list("purchase_urls"),
    "price": lambda: F.col("price_usd"),
}


def entry(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` as entries: every column of ``ENTRY``, cast, null where it is missing, and the ``keep`` columns."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in ENTRY.items()])


def built(entries: DataFrame, columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The display rows of ``entries``."""
    return entry(entries, *keep).select(*keep, *[COLUMNS[c]().alias(c) for c in columns or COLUMNS])
