"""Entities: keys, matching, duplicates, merging, snapshots.

Winners are always chosen by a total order, so a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import is_missing, nullif_missing
from ..sources.shared import checkpointed


def duplicate_groups(df: DataFrame, keys: list[Column], names: list[str], id_: str) -> DataFrame:
    """Keys that stand more than once, their number, smallest id and the ids in order."""
    named = [k.alias(n) for k, n in zip(keys, names, strict=True)]
    g = df.select(*named, F.col(id_).alias("_id")).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"), F.array_sort(F.collect_list("_id")).alias("ids"))
    return g.where("n > 1")


def best_row(df: DataFrame, keys: list[str], score: Column, id_: str) -> DataFrame:
    """The row of the highest score of each group; the smallest id among equals."""
    rank = F.struct(score.isNull().alias("x"), (-score).alias("s"), F.col(id_).alias("i"))
    return _least_row(df, keys, rank)


def _least_row(df: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The row of the least ``rank`` of each group, by a partial aggregate."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), rank).alias("_r"))
    return best.select(*[F.col("_r").getField(c).alias(c) for c in df.columns])


def merged(df: DataFrame, keys: list[str], score: Column, id_: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """One row per group: scalars from the best row that has one, arrays united, the best row's id, all rows counted."""
    rank = F.struct((-score).alias("s"), F.col(id_).alias("i"))
    aggs = [F.min_by(id_, rank).alias(id_), F.count(F.lit(1)).alias("merged_rows")]
    for c in scalars:
        ok = ~is_missing(F.col(c), df.schema[c].dataType)
        aggs.append(F.min_by(c, F.when(ok, rank)).alias(c))
    for c in arrays:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def reparented(children: DataFrame, parent: str, kept: DataFrame, old: str, new: str) -> DataFrame:
    """``children`` whose parent ``old`` was merged away point to ``new``."""
    moved = children.join(kept.select(F.col(old).alias("_old"), F.col(new).alias("_new")), F.col(parent) == F.col("_old"), "left")
    return moved.withColumn(parent, F.coalesce("_new", parent)).drop("_old", "_new")


def unanimous(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per group the value of each field on which all rows that have one agree, else null."""
    aggs = []
    for c in fields:
        v = nullif_missing(F.col(c), df.schema[c].dataType)
        aggs.append(F.when(F.min(v) == F.max(v), F.min(v)).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def fill_only(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``old`` with its empty fields filled from ``new``, and ``fields_added``."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in fields])
    t = old.join(n, key, "left")
    gained = []
    for c in fields:
        kind = old.schema[c].dataType
        gained.append(F.when(is_missing(F.col(c), kind) & ~is_missing(F.col(f"_n_{c}"), new.schema[c].dataType), F.lit(c)))
    t = t.withColumn("fields_added", F.array_compact(F.array(*gained)))
    for c in fields:
        t = t.withColumn(c, F.coalesce(nullif_missing(F.col(c), old.schema[c].dataType), F.col(f"_n_{c}")))
    return t.drop(*[f"_n_{c}" for c in fields])


def upserted(old: DataFrame, new: DataFrame, key: str, scalars: list[str], arrays: dict[str, int], always: list[str], never: list[str]) -> DataFrame:
    """The snapshot after an upsert.

    Scalars: the new value unless null.  Arrays: the new one unless empty; one
    longer than its limit counts as empty.  ``always``: overwritten when the key
    comes anew; ``never``: kept once set.
    """
    o = old.select(F.col(key), F.lit(True).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in [*scalars, *arrays, *always, *never]])
    n = new.select(F.col(key), F.lit(True).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in [*scalars, *arrays, *always, *never]])
    t = o.join(n, key, "full_outer")
    out = [F.col(key)]
    out += [F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in scalars]
    out += [F.when((F.size(f"_n_{c}") > 0) & (F.size(f"_n_{c}") <= most), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c, most in arrays.items()]
    out += [F.when(F.col("_n").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in always]
    out += [F.when(F.col("_o").isNotNull(), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in never]
    return t.select(*out)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by the ``order`` columns."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("_r"))
    return last.select(*[F.col("_r").getField(c).alias(c) for c in df.columns])


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys are not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def _grams(c: Column, size: int = 3) -> Column:
    """All substrings of one to ``size`` characters, each once."""
    one = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - k + 1)), lambda i: F.substring(c, i, F.lit(k)))
    return F.array_distinct(F.flatten(F.array(*[one(k) for k in range(1, size + 1)])))


def contained(short: DataFrame, long: DataFrame, size: int = 3) -> DataFrame:
    """(_b, s, l): texts of ``short`` (_b, s) inside texts of ``long`` (_b, l) of the same block.

    A text can only stand inside one that has its first ``size`` characters
    somewhere, so both sides meet on (block, these characters).
    """
    a = short.where("s <> ''").withColumn("_g", F.substring("s", 1, size))
    b = long.select("_b", "l", F.explode(_grams(F.col("l"), size)).alias("_g"))
    return a.join(b, ["_b", "_g"]).where(F.contains("l", F.col("s"))).select("_b", "s", "l")


def tiered_match(left: DataFrame, right: DataFrame, block: str, left_name: str, right_name: str, left_id: str, right_id: str, version: Callable[[Column], Column]) -> DataFrame:
    """left_id, right_id, tier: the best match inside a block, the smallest right_id among equals.

    Tier 1: equal names; 2: one contains the other, the longest overlap first;
    3: equal without version.  Names of a block are made unique first.  Tiers 1
    and 3 are equi-joins on the name, and names meet for tier 2 through
    ``contained``, so rows of a block never meet all against all.
    """
    a = left.select(F.col(block).alias("_b"), F.col(left_id).alias("left_id"), F.col(left_name).alias("l"))
    names = a.select("_b", "l").distinct()
    b = right.groupBy(F.col(block).alias("_b"), F.col(right_name).alias("r")).agg(F.min(right_id).alias("right_id"))
    equal = names.join(b.withColumn("l", F.col("r")), ["_b", "l"]).select("_b", "l", F.lit(1).alias("tier"), F.lit(0).alias("o"), "right_id")
    inside = contained(b.select("_b", F.col("r").alias("s")), names).select("_b", "l", F.col("s").alias("r"))
    around = contained(names.select("_b", F.col("l").alias("s")), b.select("_b", F.col("r").alias("l"))).select("_b", F.col("s").alias("l"), F.col("l").alias("r"))
    overlap = inside.unionByName(around).where("l <> r").join(b, ["_b", "r"]).select("_b", "l", F.lit(2).alias("tier"), (-F.least(F.length("l"), F.length("r"))).alias("o"), "right_id")
    plain = b.groupBy("_b", version(F.col("r")).alias("_v")).agg(F.min("right_id").alias("right_id"))
    version_ = names.withColumn("_v", version(F.col("l"))).join(plain, ["_b", "_v"]).select("_b", "l", F.lit(3).alias("tier"), F.lit(0).alias("o"), "right_id")
    best = equal.unionByName(overlap).unionByName(version_).groupBy("_b", "l").agg(F.min(F.struct("tier", "o", "right_id")).alias("m"))
    return a.join(best, ["_b", "l"]).select("left_id", F.col("m.right_id").alias("right_id"), F.col("m.tier").alias("tier"))


def tiered_lookup(left: DataFrame, right: DataFrame, id_: str, keys: list[Column], value: str, right_keys: list[Column], right_id: str) -> DataFrame:
    """id, value, tier: left joins on ever looser keys, the first hit wins; each key of the right side is first made unique."""
    t = left.select(F.col(id_).alias("id"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(right_keys):
        table = right.select(k.alias(f"_k{i}"), F.col(value).alias("v"), F.col(right_id).alias("r")).where(F.col(f"_k{i}").isNotNull())
        table = table.groupBy(f"_k{i}").agg(F.min_by("v", "r").alias(f"_v{i}"))
        t = t.join(table, f"_k{i}", "left")
    tier = F.lit(None).cast("int")
    for i in reversed(range(len(keys))):
        tier = F.when(F.col(f"_v{i}").isNotNull(), F.lit(i + 1)).otherwise(tier)
    return t.select("id", F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))]).alias("value"), tier.alias("tier"))


def prefix_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: int) -> DataFrame:
    """Pairs where the left key starts with a right key of at least ``least`` characters.

    Both sides meet on the first ``least`` characters, so the join stays an
    equi-join; equal keys are left out.
    """
    a = left.withColumn("_p", F.substring(left_key, 1, least))
    b = right.where(F.length(right_key) >= least).withColumn("_p", F.substring(right_key, 1, least))
    return a.join(b, "_p").where(F.startswith(F.col(left_key), F.col(right_key)) & (F.col(left_key) != F.col(right_key))).drop("_p")


def pairs(df: DataFrame, keys: list[str], id_: str, block: int = 4096) -> DataFrame:
    """a < b: rows that share the keys, smaller id first.

    The rows of a group are cut, in order of their ids, into blocks, and each two
    blocks meet under a key of their own.  So no task holds more than two blocks
    of a group, and a large group is dealt over all tasks.
    """
    group, parts = Window.partitionBy(*keys), df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    t = df.select(*keys, F.col(id_).alias("_id")).where(" and ".join(f"`{k}` is not null" for k in [*keys, "_id"]))
    place = F.floor((F.row_number().over(group.orderBy("_id")) - 1) / block)
    last = F.floor((F.count(F.lit(1)).over(group) - 1) / block)
    t = t.withColumns({"_at": place, "_last": last})
    a = t.select(*keys, F.col("_id").alias("a"), F.col("_at").alias("_i"), F.explode(F.sequence("_at", "_last")).alias("_j"))
    b = t.select(*keys, F.col("_id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_at"))).alias("_i"), F.col("_at").alias("_j"))
    met = [*keys, "_i", "_j"]
    # a given number: the input is small beside the pairs it makes, so its size must not choose the number of tasks
    return a.repartition(int(parts), *met).join(b.repartition(int(parts), *met), met).where("a < b").drop("_i", "_j")


def without(df: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Rows whose key is not in ``gone``; nulls on either side never match."""
    return df.join(gone.select(F.col(gone_key or key).alias(key)), key, "left_anti")


def cleared(df: DataFrame, rules: dict[str, Column], allow: dict[str, Column] | None = None) -> DataFrame:
    """Values that break a column's rule become null, unless the allow rule holds."""
    for c, bad in rules.items():
        keep = (allow or {}).get(c, F.lit(False))
        df = df.withColumn(c, F.when(F.coalesce(bad, F.lit(False)) & ~F.coalesce(keep, F.lit(False)), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df


def numeric_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def united(*sources: DataFrame) -> DataFrame:
    """The rows of several sources, each once."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.distinct()


def variant_candidates(left: DataFrame, right: DataFrame, block: str, name: str, id_: str, variants: list[Column]) -> DataFrame:
    """id and ``candidate``: the smallest other id of the block whose name is one of the row's variants."""
    asked = left.select(F.col(block).alias("_b"), F.col(id_).alias("id"), F.explode(F.array_distinct(F.array(*variants))).alias("_n")).where("id is not null")
    there = right.select(F.col(block).alias("_b"), F.col(name).alias("_n"), F.col(id_).alias("c")).where("c is not null")
    # of a name the two smallest ids answer every row: its own id is one of them at most
    ranked = there.withColumn("_r", F.dense_rank().over(Window.partitionBy("_b", "_n").orderBy("c"))).where("_r <= 2")
    two = ranked.groupBy("_b", "_n").agg(F.min("c").alias("c1"), F.max("c").alias("c2"))
    other = F.when(F.col("c1") != F.col("id"), F.col("c1")).when(F.col("c2") != F.col("id"), F.col("c2"))
    return asked.join(two, ["_b", "_n"]).withColumn("c", other).where("c is not null").groupBy("id").agg(F.min("c").alias("candidate"))


def verdict_applied(df: DataFrame, verdicts: DataFrame, key: str, field: str, names: dict[str, str], ok: str, kind: str, other: str) -> DataFrame:
    """A classifier's ``verdicts`` (key, field, ok): an empty ``field`` takes its mapped value; where ``ok`` is false ``kind`` becomes ``other``."""
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    v = verdicts.select(key, F.try_element_at(table, F.col(field)).alias("_v"), F.col(ok).alias("_ok"))
    t = df.join(v, key, "left")
    t = t.withColumn(field, F.coalesce(nullif_missing(F.col(field), df.schema[field].dataType), F.col("_v")))
    return t.withColumn(kind, F.when(F.coalesce(~F.col("_ok"), F.lit(False)), F.lit(other)).otherwise(F.col(kind))).select(*df.columns)


def donor_filled(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Empty fields take the value on which all rows of the group agree."""
    d = unanimous(df, keys, fields).withColumnsRenamed({c: f"_d_{c}" for c in fields})
    t = df.join(d, keys, "left")
    return t.withColumns({c: F.coalesce(nullif_missing(F.col(c), df.schema[c].dataType), F.col(f"_d_{c}")) for c in fields}).select(*df.columns)


def cross_filled(df: DataFrame, other: DataFrame, key: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Empty values from ``other`` (one row per key) where they lie inside their bounds."""
    o = other.select(key, *[F.when(F.col(c).between(low, high), F.col(c)).alias(f"_o_{c}") for c, (low, high) in bounds.items()])
    return df.join(o, key, "left").withColumns({c: F.coalesce(c, f"_o_{c}") for c in bounds}).select(*df.columns)


def reverted(df: DataFrame, bad: DataFrame, key: str, scalars: list[str], arrays: list[str], share: float = 0.02, least: int = 2, least_arrays: int = 3) -> DataFrame:
    """``df`` and ``matches``: scalars within ``share`` of a bad source's; enough of them clear the scalars, more also the arrays."""
    b = bad.select(key, *[F.col(c).alias(f"_b_{c}") for c in scalars])
    t = df.join(b, key, "left")
    close = [F.coalesce((F.abs(F.col(c) - F.col(f"_b_{c}")) <= share * F.abs(F.col(f"_b_{c}"))).cast("int"), F.lit(0)) for c in scalars]
    t = t.withColumn("matches", sum(close[1:], close[0]))
    gone = {c: F.when(F.col("matches") < least, F.col(c)) for c in scalars}
    gone |= {c: F.when(F.col("matches") >= least_arrays, F.slice(c, 1, 0)).otherwise(F.col(c)) for c in arrays}
    return t.withColumns(gone).select(*df.columns, "matches")


def overridden(df: DataFrame, key: str, rows: dict[int, dict[str, object]], gone: list[int] = ()) -> DataFrame:
    """Single values set by hand, and rows that go."""
    changed = {c for values in rows.values() for c in values}
    for c in sorted(changed):
        value = F.col(c)
        for k, values in rows.items():
            if c in values:
                value = F.when(F.col(key) == k, F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(value)
        df = df.withColumn(c, value)
    return df.where(~F.col(key).isin(list(gone))) if gone else df


def until_unchanged(df: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Column, most: int = 20) -> DataFrame:
    """``step`` again and again until ``measure`` stays what it was, ``most`` times at most.

    Each pass is written to the session's checkpoint folder, so no lineage grows.
    """
    before = df.agg(measure).first()[0]
    for _ in range(most):
        df = checkpointed(step(df))
        now = df.agg(measure).first()[0]
        if now == before:
            break
        before = now
    return df
