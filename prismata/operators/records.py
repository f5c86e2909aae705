"""Records of unknown shape: VARIANT values with a corrupt-record column, checked field by field.

A record that is no JSON object is kept as it came in ``corrupt``; what stands
behind a complete object is ignored.  Of the rest,
a number counts inside its bounds (a text that says a number, too), a text up to
its length, an array with those items that are texts or numbers of the kind
asked for; an array of more items than allowed counts as not found, as does a
value of another kind.  Paths may lead into nested objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Number:
    path: str
    low: float
    high: float


@dataclass(frozen=True)
class Text:
    path: str
    longest: int


@dataclass(frozen=True)
class Items:
    """An array: texts up to ``longest``, or numbers between ``low`` and ``high``."""

    path: str
    most: int
    longest: int | None = None
    low: float | None = None
    high: float | None = None


Field = Number | Text | Items


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _value(record: Column, field: Field) -> Column:
    v = F.try_variant_get(record, field.path, "variant")
    if isinstance(field, Number):
        x = F.when(~_kind(v).rlike("^(OBJECT|ARRAY|BOOLEAN)"), F.try_variant_get(record, field.path, "double"))
        return F.when(x.between(field.low, field.high), x)
    if isinstance(field, Text):
        x = F.when(_kind(v) == "STRING", F.try_variant_get(record, field.path, "string"))
        return F.when(F.length(x) <= field.longest, x)
    items = F.try_variant_get(record, field.path, "array<variant>")
    if field.longest is not None:
        texts = F.transform(F.filter(items, lambda x: _kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
        kept = F.filter(texts, lambda x: (x != "") & (F.length(x) <= field.longest))
    else:
        numbers = F.transform(F.filter(items, lambda x: _kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE)")), lambda x: F.try_variant_get(x, "$", "double"))
        kept = F.filter(numbers, lambda x: x.between(field.low, field.high))
    return F.when(F.size(items) <= field.most, kept)


def read(df: DataFrame, json: str, fields: dict[str, Field]) -> DataFrame:
    """``df`` with a column for each field and ``corrupt``, the raw text of a record that cannot be read."""
    parsed = df.withColumn("_record", F.try_parse_json(F.col(json)))
    fine = F.coalesce(_kind(F.col("_record")).startswith("OBJECT"), F.lit(False))
    out = parsed.withColumns({name: F.when(fine, _value(F.col("_record"), f)) for name, f in fields.items()})
    return out.withColumn("corrupt", F.when(~fine, F.col(json))).drop("_record")
