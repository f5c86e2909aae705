"""Data quality: required attributes, completeness, gaps, issues, verdicts, accuracy.

Every report is one partially aggregated pass: rules are Columns, so adding a
rule adds an expression, not a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_missing


def missing(df: DataFrame, fields: list[str], exempt: dict[str, Column] | None = None) -> Column:
    """Names of the required fields that are empty, in order; ``exempt`` fields may be where their rule holds."""
    tests = []
    for c in fields:
        gone = is_missing(F.col(c), df.schema[c].dataType)
        if exempt and c in exempt:
            gone = gone & ~F.coalesce(exempt[c], F.lit(False))
        tests.append(F.when(gone, F.lit(c)))
    return F.array_compact(F.array(*tests))


def completeness(tests: list[Column]) -> Column:
    """How many of the tests hold."""
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("int") for t in tests])


def histogram(df: DataFrame, score: str) -> DataFrame:
    """score, n and percent of all rows; the total is the sum of the few groups."""
    t = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    total = t.agg(F.sum("n").alias("_total"))
    return t.join(F.broadcast(total)).select(score, "n", F.round(F.col("n") * 100 / F.col("_total"), 4).alias("percent"))


def gaps(df: DataFrame, group: str, fields: list[str], least: int = 1, total: bool = False) -> DataFrame:
    """Per group its rows and how many lack each field; with ``total`` one more row, whose group is null and ``grand`` true."""
    lack = [F.count_if(is_missing(F.col(c), df.schema[c].dataType)).alias(f"no_{c}") for c in fields]
    if not total:
        return df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *lack).where(F.col("total") >= least)
    t = df.rollup(group).agg(F.grouping(group).cast("boolean").alias("grand"), F.count(F.lit(1)).alias("total"), *lack)
    return t.where(F.col("grand") | (F.col("total") >= least))


def average_gap(gap_table: DataFrame, fields: list[str]) -> Column:
    """Mean share of missing values over the fields, in percent."""
    shares = [F.col(f"no_{c}") * 100.0 / F.col("total") for c in fields]
    return F.round(reduce(lambda a, b: a + b, shares) / len(fields), 4)


def issues(df: DataFrame, id_: list[str], rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per broken rule: the id columns, the issue's name and the value that breaks it."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("issue"), value.cast("string").alias("value"))) for name, (bad, value) in rules.items()]))
    return df.select(*id_, F.explode(found).alias("_i")).select(*id_, "_i.issue", "_i.value")


def counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows each rule holds for, rules without a row included."""
    one = df.agg(*[F.count_if(c).alias(name) for name, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("_r")).select("_r.rule", "_r.n")


def consistent(a: Column, b: Column, factor: float = 2.0) -> Column:
    """The ratio of two positive numbers lies within the factor either way; unknown values are consistent."""
    return F.coalesce((a / b).between(1 / factor, factor) | (a <= 0) | (b <= 0), F.lit(True))


def cascade(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Class of the first pattern that matches."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def bottom_groups(df: DataFrame, group: str, score: str, least: int, most: int) -> DataFrame:
    """The ``most`` groups of the lowest mean score among those with at least ``least`` rows."""
    t = df.groupBy(group).agg(F.round(F.avg(score), 4).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return t.orderBy("mean", group).limit(most)


def overlap(truth: Column, found: Column) -> Column:
    """exact, partial or mismatch of two sets."""
    both = F.size(F.array_intersect(truth, found))
    return F.when((both == F.size(F.array_distinct(truth))) & (both == F.size(F.array_distinct(found))), "exact").when(both > 0, "partial").otherwise("mismatch")


def coverage(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~is_missing(F.col(c), df.schema[c].dataType)).alias(f"has_{c}") for c in fields])


def coverage_gain(before: DataFrame, after: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Per group how many more rows have each field after than before."""
    a, b = coverage(before, group, fields), coverage(after, group, fields)
    b = b.select(group, *[F.col(f"has_{c}").alias(f"_a_{c}") for c in fields])
    return a.join(b, group).select(group, *[(F.col(f"_a_{c}") - F.col(f"has_{c}")).alias(f"gain_{c}") for c in fields])


def verdicts(measures: DataFrame, targets: dict[str, float]) -> DataFrame:
    """measure, value, target, passed from one row of measures; a negative target is an upper bound."""
    rows = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(float(abs(t))).alias("target"), (F.col(m) >= t if t > 0 else F.col(m) <= -t).alias("passed")) for m, t in targets.items()]
    return measures.select(F.explode(F.array(*rows)).alias("_v")).select("_v.*")
