"""Faceted search: filters, fuzzy words, order and facet metadata as Column expressions.

A ``Spec`` is plain data; ``predicate`` turns it into one boolean Column, so the
optimiser sees an ordinary filter.  Inactive filters give no predicate.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import as_strings, is_missing

MODES = ("any", "all", "only", "none")


@dataclass(frozen=True)
class Multi:
    column: str
    selected: tuple[str, ...]
    mode: str = "any"
    unknown: bool = False


@dataclass(frozen=True)
class YesNo:
    column: str
    yes: tuple[str, ...] = ()
    no: tuple[str, ...] = ()
    mode: str = "all"
    unknown: bool = False


@dataclass(frozen=True)
class Range:
    column: str
    low: float | None = None
    high: float | None = None
    unknown: bool = False


@dataclass(frozen=True)
class Spec:
    filters: tuple[Multi | YesNo | Range, ...] = ()
    sort: str | None = None
    descending: bool = True
    words: str = ""


@dataclass(frozen=True)
class Facet:
    """A column's description: its kind, the modes it allows (first: default), numeric bounds."""

    column: str
    kind: str = "multi"  # multi, boolean or range
    modes: tuple[str, ...] = MODES
    low: float = 0.0
    high: float = 1.0
    searchable: bool = False
    sortable: bool = False
    options: tuple[str, ...] = field(default=())


def multi(data: Column, selected: list[str], mode: str) -> Column:
    """Set logic between a cell (array<string>) and the selection; empty cells pass ``none`` only."""
    want = F.array(*[F.lit(s) for s in selected]) if selected else F.array().cast("array<string>")
    if mode == "any":
        return F.arrays_overlap(data, want) if selected else F.lit(False)
    if mode == "none":
        return ~F.arrays_overlap(data, want) if selected else F.lit(True)
    n, k = F.size(data), len(selected)
    if not selected:
        return F.lit(False)
    if mode == "all":
        return (n > 0) & (n >= k) & (F.size(F.array_except(want, data)) == 0)
    if mode == "only":
        return (n > 0) & (n <= k) & (F.size(F.array_except(data, want)) == 0)
    raise ValueError(f"unknown mode {mode}")


def one_of(c: Column, selected: list[str], mode: str) -> Column:
    """``multi`` for a plain string: the same answers as comparisons that reach the scan."""
    want = [s for s in selected if s]
    if mode == "none":
        return c.isNull() | ~c.isin(want) if want else F.lit(True)
    if not want or (mode == "all" and len(selected) > 1):
        return F.lit(False)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return c.isNotNull() & c.isin(want)


def yes_no(data: Column, yes: list[str], no: list[str], mode: str) -> Column:
    """all: every yes present and every no absent; any: one of these holds for one item."""
    tests = [F.array_contains(data, y) for y in yes] + [~F.array_contains(data, x) for x in no]
    if not tests:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), tests)


def inside(c: Column, kind: T.DataType, low: float | None, high: float | None) -> Column:
    """A number, or any item of an array, between the bounds."""

    def ok(x: Column) -> Column:
        tests = ([x >= low] if low is not None else []) + ([x <= high] if high is not None else [])
        return reduce(lambda a, b: a & b, tests, x.isNotNull())

    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: ok(x.try_cast("double"))), F.lit(False))
    if isinstance(kind, T.NumericType):
        return ok(c)  # never null, and plain enough to reach the scan
    return F.lit(False)


def active(f: Multi | YesNo | Range) -> bool:
    if isinstance(f, Multi):
        return bool(f.selected)
    if isinstance(f, YesNo):
        return bool(f.yes or f.no)
    return f.low is not None or f.high is not None


def predicate(spec: Spec, schema: T.StructType) -> Column:
    """The conjunction of a spec's active filters."""
    tests = []
    for f in spec.filters:
        if not active(f) or f.column not in schema.names:
            continue
        kind, c = schema[f.column].dataType, F.col(f.column)
        if isinstance(f, Multi):
            test = one_of(c, list(f.selected), f.mode) if isinstance(kind, T.StringType) else multi(as_strings(c, kind), list(f.selected), f.mode)
        elif isinstance(f, YesNo):
            test = yes_no(as_strings(c, kind), list(f.yes), list(f.no), f.mode)
        else:
            test = inside(c, kind, f.low, f.high)
        tests.append(test | is_missing(c, kind) if f.unknown else test)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def search_text(schema: T.StructType, columns: list[str]) -> Column:
    """Lower-cased words of the searchable cells; hidden options and links left out."""
    parts = []
    for name in columns:
        kind, c = schema[name].dataType, F.col(name)
        if isinstance(kind, T.ArrayType):
            parts.append(F.concat_ws(" ", F.filter(c.cast("array<string>"), lambda x: ~x.rlike("^(//|~|http)"))))
        else:
            parts.append(F.when(c.cast("string") != "", c.cast("string")))
    return F.lower(F.concat_ws(" ", *parts))


def fuzzy(text: Column, word: str) -> Column:
    """The word occurs; a word of 4k letters may have up to k other characters between its letters.

    A greedy subsequence test inside a window of ``len + len // 4`` characters,
    as a regular expression over each window.
    """
    extra = len(word) // 4
    exact = F.contains(text, F.lit(word))
    if not extra:
        return exact
    escape = lambda ch: ch if ch.isalnum() else "\\" + ch
    loose = "(?s)^" + ".*?".join(escape(ch) for ch in word)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - len(word) + 1 + extra, F.lit(1)))
    return exact | F.exists(starts, lambda i: F.substring(text, i, F.lit(len(word) + extra)).rlike(loose))


def words_match(text: Column, query: str) -> Column:
    """Every word of the query matches."""
    return reduce(lambda a, b: a & b, [fuzzy(text, w) for w in query.lower().split()], F.lit(True))


def sort_key(column: str, kind: T.DataType) -> Column:
    """Numbers, or the largest of an array; strings in the order of their language's letters, case and accents last, empty as null."""
    c = F.col(column)
    if isinstance(kind, T.ArrayType):
        return F.array_max(F.filter(F.transform(c, lambda x: x.try_cast("double")), lambda x: x.isNotNull()))
    if isinstance(kind, T.StringType):
        return F.collate(F.when(c != "", c), "UNICODE")
    return c


def order_by(schema: T.StructType, sort: str | None, descending: bool, row: str) -> list[Column]:
    """Descending: empty last, ties in row order.  Ascending is its exact reverse.  Without a sort: row order."""
    if sort is None:
        return [F.col(row).asc()]
    key = sort_key(sort, schema[sort].dataType)
    return [key.desc_nulls_last(), F.col(row).asc()] if descending else [key.asc_nulls_first(), F.col(row).desc()]


def query(df: DataFrame, spec: Spec, row: str, searchable: list[str] | None = None) -> DataFrame:
    """Filter, search and order; the filters come before the words."""
    out = df.where(predicate(spec, df.schema))
    if spec.words.strip():
        out = out.where(words_match(search_text(df.schema, searchable or []), spec.words))
    return out.orderBy(*order_by(df.schema, spec.sort, spec.descending, row))


def page(df: DataFrame, number: int, first: int = 50, more: int = 100) -> DataFrame:
    """Page 0 has ``first`` rows, later ones ``more``."""
    return df.limit(first) if number == 0 else df.offset(first + (number - 1) * more).limit(more)


def options(df: DataFrame, column: str) -> DataFrame:
    """value, n: distinct non-empty values other than 'unknown', with their rows."""
    kind = df.schema[column].dataType
    items = F.explode(F.array_distinct(as_strings(F.col(column), kind)))
    t = df.select(items.alias("value")).where("value <> '' and value <> 'unknown'")
    return t.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def prioritised(values: DataFrame, first: list[str], column: str = "value") -> DataFrame:
    """``values`` with ``place``: listed ones in their order, then the rest alphabetically."""
    from pyspark.sql import Window

    at = F.array_position(F.array(*[F.lit(v) for v in first]), F.col(column))
    rank = F.when(at == 0, F.lit(len(first) + 1)).otherwise(at)
    return values.withColumn("place", F.row_number().over(Window.orderBy(rank, column)).cast("long"))  # a facet's options


def bounds(df: DataFrame, column: str) -> DataFrame:
    """low, high over positive numbers and array items; (0, 1) when there are none."""
    kind = df.schema[column].dataType
    c = F.col(column)
    v = F.explode(F.transform(c, lambda x: x.try_cast("double"))) if isinstance(kind, T.ArrayType) else c.cast("double")
    t = df.select(v.alias("v")).where("v > 0")
    return t.agg(F.coalesce(F.min("v"), F.lit(0.0)).alias("low"), F.coalesce(F.max("v"), F.lit(1.0)).alias("high"))


def default_quality(score: str = "completeness", kind: str = "type") -> tuple[Multi | Range, ...]:
    """The filters of a visit without a query: complete enough and a product."""
    return (Range(score, 8, None), Multi(kind, ("accessory", "blog"), "none"))


def inverted(selection: Multi) -> Multi:
    """All other options: none of the selected ones, whatever options there are."""
    return Multi(selection.column, selection.selected, "none")
