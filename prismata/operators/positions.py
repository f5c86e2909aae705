"""Fields by position: values and labels of a segment with their offsets, each value matched with its nearest label.

One pattern finds labels, quantities and clock times in one pass; the gaps
between matches add up to offsets.  A value whose unit belongs to one field is
that field's.  Any other value takes the field of the nearest label before it,
at most ``REACH`` code points away, if that field can have its unit; a bare
number needs a field that is told without one.  Matching is a last-value window
over the segment's own matches, so only matches are shuffled, never texts.

Defined cases: null and empty segments give no rows; values out of a field's
bounds count as not found; equal values of a field count once where all are
listed; a length below the longest cell that the segment names is not believed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extraction import CELL_MM

REACH = 40


@dataclass(frozen=True)
class Spot:
    """How a field looks: labels, units that are its own, units it can have after a label, bounds, and which values count."""

    labels: tuple[str, ...]
    own: tuple[str, ...]
    after_label: tuple[str, ...]
    low: float
    high: float
    pick: str = "max"


# fixed values: labels, units and bounds of the fields; "" is a number without a unit
SPOTS: dict[str, Spot] = {
    "lumens": Spot(("brightness", "output", "luminous flux"), ("lumens", "lumen", "lm"), ("",), 0.1, 200_000, "all"),
    "candela": Spot(("intensity",), ("candela", "cd"), ("",), 10, 5_000_000),
    "throw_m": Spot(("beam distance", "throw", "range"), (), ("m", "meters", "metres", "ft", "feet", "yd", "yards", ""), 1, 3000),
    "runtime_h": Spot(("runtime", "run time", "lasts"), ("hours", "hour", "hrs", "h", "days", "clock"), ("minutes", "min"), 0.01, 5000, "all"),
    "length_mm": Spot(("length", "long"), (), ("mm", "cm", "in", "inches"), 15, 800),
    "bezel_mm": Spot(("head", "bezel"), (), ("mm", "cm", "in", "inches"), 5, 300),
    "body_mm": Spot(("body", "tube"), (), ("mm", "cm", "in", "inches"), 5, 200),
    "weight_g": Spot(("weight", "weighs"), ("grams", "g", "kg", "oz", "lb", "lbs"), ("",), 5, 5000, "first"),
    "cri": Spot(("cri",), (), ("",), 50, 100, "first"),
    "cct": Spot(("cct", "colour temperature", "color temperature"), ("k",), ("",), 1800, 10_000, "all"),
    "capacity_mah": Spot(("capacity",), ("mah",), ("",), 50, 100_000),
    "beam_angle": Spot(("beam angle", "spill"), ("degrees", "°"), ("",), 1, 180, "first"),
    "year": Spot(("released", "since", "copyright", "introduced"), (), ("",), 1990, 2035, "first"),
    "version": Spot(("version",), (), ("",), 0, 100, "first"),
}
#: What a unit is worth in its field's unit.
WORTH = {"ft": 0.3048, "feet": 0.3048, "yd": 0.9144, "yards": 0.9144, "minutes": 1 / 60, "min": 1 / 60, "days": 24.0, "cm": 10.0, "in": 25.4, "inches": 25.4, "kg": 1000.0, "oz": 28.3495, "lb": 453.592, "lbs": 453.592}
LABELS = {label: name for name, s in SPOTS.items() for label in s.labels}
OWN = {unit: name for name, s in SPOTS.items() for unit in s.own}
_UNITS = sorted({u for s in SPOTS.values() for u in (*s.own, *s.after_label) if u and u not in ("clock", "°")}, key=lambda u: (-len(u), u))
_LABELS = sorted(LABELS, key=lambda x: (-len(x), x))
NUMBER = r"[0-9]{1,9}(?:,[0-9]{3})*(?:\.[0-9]{1,6})?"
CLOCK = r"[0-9]{1,3}(?::[0-5][0-9]\s?h\b|h\s?[0-9]{1,2}\s?m\b)"
QUANTITY = rf"{NUMBER}(?:\s?(?:(?:{'|'.join(_UNITS)})\b|°))?"
PATTERN = rf"(?i)\b(?:{'|'.join(_LABELS)})\b|\b{CLOCK}|\b{QUANTITY}"


def marks(segments: DataFrame, key: str, text: str) -> DataFrame:
    """key, i, start, end and word (lower case) of each label, quantity and clock time; offsets in code points."""
    p = F.lit(PATTERN)
    own = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.lower(x))
    gaps = F.transform(F.split(text, PATTERN), F.length)
    t = segments.select(F.col(key).alias("key"), F.posexplode(F.arrays_zip(gaps.alias("gap"), own.alias("word"))).alias("i", "m")).where("m.word is not null")
    t = t.select("key", "i", "m.word", "m.gap", F.length("m.word").alias("n"))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("key").orderBy("i"))
    return t.select("key", "i", "word", (end - F.col("n")).alias("start"), end.alias("end"))


def _number(word: Column) -> Column:
    return F.replace(F.regexp_extract(word, NUMBER, 0), F.lit(","), F.lit("")).try_cast("double")


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), key)


def found(segments: DataFrame, key: str, text: str, reach: int = REACH) -> DataFrame:
    """key, i, field and value of each plausible value of a segment, and the rows of cells it names."""
    m = marks(segments, key, text)
    label = _lookup(LABELS, F.col("word"))
    before = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(label.isNotNull(), F.struct(label.alias("field"), F.col("end").alias("at"))), ignorenulls=True).over(before)
    m = m.withColumn("near", near).where(label.isNull())
    clock = F.col("word").rlike(f"^{CLOCK}$")
    parts = F.regexp_extract_all("word", F.lit("([0-9]+)"), F.lit(1))
    hours = F.get(parts, 0).try_cast("double") + F.get(parts, 1).try_cast("double") / 60
    unit = F.when(clock, F.lit("clock")).otherwise(F.trim(F.regexp_replace("word", f"^{NUMBER}", "")))
    m = m.select("key", "i", F.col("word"), unit.alias("unit"), F.when(F.col("start") - F.col("near.at") <= reach, F.col("near.field")).alias("near"), F.when(clock, hours).otherwise(_number(F.col("word"))).alias("number"))
    can = F.concat_ws("|", "near", "unit").isin([f"{name}|{u}" for name, s in SPOTS.items() for u in (*s.own, *s.after_label)])
    field = F.coalesce(F.when(can, F.col("near")), _lookup(OWN, F.col("unit")))
    worth = F.coalesce(_lookup(WORTH, F.col("unit")), F.lit(1.0))
    m = m.select("key", "i", field.alias("field"), (F.col("number") * worth).alias("value"), _lookup(CELL_MM, F.col("word")).alias("cell"))
    low, high = (_lookup({name: float(getattr(s, side)) for name, s in SPOTS.items()}, F.col("field")) for side in ("low", "high"))
    plausible = F.coalesce(F.col("value").between(low, high), F.lit(False))
    return m.where(plausible | F.col("cell").isNotNull()).withColumn("field", F.when(plausible, F.col("field")))


def fields(segments: DataFrame, key: str, text: str, reach: int = REACH) -> DataFrame:
    """key and a column for each field: all values from the largest, the largest, or the first; segments without any value are left out."""
    f = found(segments, key, text, reach)
    out = []
    for name, s in SPOTS.items():
        v = F.when(F.col("field") == name, F.col("value"))
        if s.pick == "all":
            out.append(F.sort_array(F.collect_set(v), asc=False).alias(name))  # the values of one segment
        elif s.pick == "first":
            out.append(F.min_by("value", F.when(F.col("field") == name, F.col("i"))).alias(name))
        else:
            out.append(F.max(v).alias(name))
    t = f.groupBy("key").agg(*out, F.max("cell").alias("cell"), F.count("field").alias("n")).where("n > 0")
    believed = F.when(F.col("cell").isNull() | (F.col("length_mm") >= F.col("cell")), F.col("length_mm"))
    return t.withColumn("length_mm", believed).drop("cell", "n")
