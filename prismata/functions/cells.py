"""Cells of the catalogue: emptiness, normal form as string arrays, array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks a hidden alias of an option; matching ignores it.
ALIAS = "//"


def is_missing(c: Column, kind: T.DataType) -> Column:
    """Null, an empty string or an empty array."""
    if isinstance(kind, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    return c.isNull()


def missing_or_not_positive(c: Column) -> Column:
    return c.isNull() | (c <= 0)


def nullif_missing(c: Column, kind: T.DataType) -> Column:
    return F.when(~is_missing(c, kind), c)


def as_strings(c: Column, kind: T.DataType) -> Column:
    """A cell as array<string> without nulls; aliases lose their mark, scalar numbers give an empty array."""
    empty = F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: F.regexp_replace(x.cast("string"), f"^{ALIAS}", ""))
        return F.coalesce(F.filter(items, lambda x: x.isNotNull()), empty)
    if isinstance(kind, T.StringType):
        return F.when(c.isNull() | (c == ""), empty).otherwise(F.array(c))
    return empty


def first_item(c: Column) -> Column:
    return F.get(c, 0)


def capped(c: Column, most: int) -> Column:
    """An array longer than ``most`` becomes empty (it is not truncated)."""
    return F.when(F.size(c) > most, F.slice(c, 1, 0)).otherwise(c)


def dropped_sorted(c: Column) -> Column:
    """Non-null distinct items, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(c)))


def contains_all(a: Column, b: Column) -> Column:
    """Every item of ``b`` is in ``a``."""
    return F.size(F.array_except(b, a)) == 0


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets, case aside."""
    low = lambda x: F.array_distinct(F.transform(x, F.lower))
    return contains_all(low(a), low(b)) & contains_all(low(b), low(a))


def within_tolerance(a: Column, b: Column, share: float = 0.02) -> Column:
    """Arrays of one length whose sorted items differ by at most ``share`` of the second's."""
    pairs = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.coalesce(F.abs(x - y) <= F.abs(y) * share, F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda ok: ok)


def pairs_of(flat: Column) -> Column:
    """array [t, p, t, p, ...] as array of struct (t, p)."""
    n = F.floor(F.size(flat) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(flat, i * 2).alias("t"), F.get(flat, i * 2 + 1).alias("p")))


def expand_multiples(c: Column) -> Column:
    """Items like ``2x18650`` also give ``18650``; distinct and sorted."""
    inner = F.flatten(F.transform(c, lambda x: F.when(x.rlike("^[0-9]+x.+$"), F.array(x, F.regexp_replace(x, "^[0-9]+x", ""))).otherwise(F.array(x))))
    return F.array_sort(F.array_distinct(inner))


def demote_last(c: Column, pattern: str) -> Column:
    """If the first item matches, it goes to the end."""
    return F.when((F.size(c) > 1) & F.get(c, 0).rlike(pattern), F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))).otherwise(c)


def by_tier(c: Column, tier) -> Column:
    """Items in the order of ``tier(item)``, stable."""
    keyed = F.transform(c, lambda x, i: F.struct(tier(x).alias("tier"), i.alias("at"), x.alias("item")))
    return F.transform(F.array_sort(keyed), lambda s: s["item"])


def filled_list(own: Column, other: Column, most: int) -> Column:
    """``own`` unless it is empty, else the first ``most`` of ``other``."""
    return F.when(F.size(own) > 0, own).otherwise(F.slice(other, 1, most))
