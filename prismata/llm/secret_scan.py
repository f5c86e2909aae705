"""Secret scans over a trigram inverted index, with DataFrame operations only.

Method.  ``trigrams.derive`` reads each rule's regular expression and gives the
Boolean trigram query that any match fulfils.  The index holds postings
(trigram, text) for the trigrams the rule set asks for, gathered from every
whole text; posting lists are intersected as bit sets, one partially aggregated
row per distinct text.  A text whose bits fulfil a rule's query is a candidate
and goes through that rule's expression; a rule without mandatory trigrams
(long hexadecimal runs) scans every text.  The index is keyed by a 64-bit hash
of the text, so copies share their postings, and two texts that met in one key
would only be verified needlessly.

Spans count code points, end exclusive.  Within a kind matches are leftmost and
do not overlap; a match whose value is too short is dropped after matching.

Defined cases: null and empty texts have no span; null doc_ids and repeated
rows are kept; equal starts follow the order of ``RULES``; other columns are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .trigrams import Query, derive, trigrams

BITS = 62


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    value: int = 0
    least: int = 0
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern

    def query(self) -> Query:
        return derive(self.pattern, self.ignore_case)


# fixed values: the base patterns, in the order that settles equal starts
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", False, 0, 24, True),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
]
RULES = BASE_RULES + MORE_RULES
MASK = "[SECRET]"


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def vocabulary(rules: list[Rule]) -> list[str]:
    return sorted(set().union(*(trigrams(r.query()) for r in rules)))


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key): number of each wanted trigram and the hash of each text that has it."""
    low = texts.select(text_key(F.col("text")).alias("key"), F.lower("text").alias("_low"))
    has = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select("key", F.explode(has).alias("gram"))


def candidates(index: DataFrame, rules: list[Rule], grams: list[str]) -> DataFrame:
    """key and one boolean ``may_<kind>`` per rule that has a query; only keys with a true one."""
    sets = [F.bit_or(F.when((F.col("gram") >= a) & (F.col("gram") < a + BITS), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") - a)).otherwise(F.lit(0).cast("long"))).alias(f"_s{a}") for a in range(0, len(grams), BITS)]
    at = {g: i for i, g in enumerate(grams)}
    got = index.groupBy("key").agg(*sets)

    def holds(query: Query) -> Column:
        every = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for alternative in clause:
                each = F.lit(True)
                for a in range(0, len(grams), BITS):
                    mask = sum(1 << (at[g] - a) for g in alternative if a <= at[g] < a + BITS)
                    if mask:
                        each = each & (F.col(f"_s{a}").bitwiseAND(F.lit(mask)) == F.lit(mask))
                some = some | each
            every = every & some
        return every

    flags = [holds(r.query()).alias(f"may_{r.kind}") for r in rules if r.query()]
    got = got.select("key", *flags)
    anyone = F.lit(False)
    for r in rules:
        if r.query():
            anyone = anyone | F.col(f"may_{r.kind}")
    return got.where(anyone)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, rule: Column) -> Column:
    """Spans of one rule (struct kind, pattern, value, least) in a text, in order.

    Starts are running sums of the gaps between matches and the matches' own
    lengths, both in code points.
    """
    none = F.array().cast(SPANS)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def spans(whole: Column) -> Column:
        values = F.regexp_extract_all(text, rule.pattern, rule.value)
        gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
        rows = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("own"), F.transform(values, F.length).alias("kept"))

        def step(acc: Column, r: Column) -> Column:
            start = acc.at + r.gap
            here = F.array(F.struct(start.alias("start"), rule.kind.alias("kind"), (start + r.own).alias("end")))
            return F.struct((start + r.own).alias("at"), F.when(r.kept >= rule.least, F.concat(acc.out, here)).otherwise(acc.out).alias("out"))

        return F.when(F.size(whole) == 0, none).otherwise(F.aggregate(F.slice(rows, 1, F.size(whole)), zero, step, lambda acc: acc.out))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, rule.pattern, F.lit(0))), spans), F.lit(0))


def with_spans(docs: DataFrame, rules: list[Rule] = RULES, text: Column | None = None) -> DataFrame:
    """``docs`` with ``_spans``, the spans of all rules in ``text`` (by default that column; a string without nulls) by start and rule.

    The rules that a text is a candidate for are an array, and one expression
    runs over it: the plan does not grow with the rule set.
    """
    text = F.col("text") if text is None else text
    grams = vocabulary(rules)
    cands = candidates(postings(docs.select(text.alias("text")), grams), rules, grams)
    df = docs.withColumn("_key", text_key(text)).join(cands.withColumnRenamed("key", "_key"), "_key", "left")
    every = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(r.java).alias("pattern"), F.lit(r.value).alias("value"), F.lit(r.least).alias("least"), (F.coalesce(F.col(f"may_{r.kind}"), F.lit(False)) if r.query() else F.lit(True)).alias("may")) for i, r in enumerate(rules)])
    df = df.withColumn("_rules", F.filter(every, lambda r: r.may))
    df = df.withColumn("_spans", F.array_sort(F.flatten(F.transform("_rules", lambda r: matches(text, r)))))
    return df.drop("_key", "_rules", *[f"may_{r.kind}" for r in rules])


def listed(spans: Column, rules: list[Rule]) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, the number of matches of each base kind, the digest of base spans and all spans."""
    d = common.with_columns(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_spans(d, rules)
    base = [i for i, r in enumerate(rules) if r.base]
    counts = [F.size(F.array_remove(F.transform("_spans", lambda s: F.when(s.kind == F.lit(i), F.lit(1)).otherwise(F.lit(0))), 0)).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    d = d.select("doc_id", *counts, F.filter("_spans", lambda s: s.kind.isin(base)).alias("_base"), "_spans")
    return d.select("doc_id", *[f"n_{rules[i].kind}" for i in base], F.sha2(listed(F.col("_base"), rules).cast("binary"), 256).alias("base_sha256"), listed(F.col("_spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] = RULES, mask: str = MASK) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; ``n_chars``, where present, follows.

    Overlapping spans share one mask.  A null text stays null.
    """
    d = common.boxed(docs)
    own = common.inside(d, "text", "string")
    text = F.coalesce(own, F.lit(""))
    d = with_spans(d, rules, text)  # only the rows themselves are shuffled, so each text once
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc.at + 1, s.start - acc.at)
        return F.when(s.start >= acc.at, F.struct(s.end.alias("at"), F.concat(acc.out, before, F.lit(mask)).alias("out"))).otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out")))

    clean = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    hit = F.size("_spans") > 0
    d = d.withColumn("_clean", F.when(hit, clean).otherwise(own)).withColumn("_hit", hit)
    out = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c.lower() == "text":
            value = F.col("_clean")
        elif c.lower() == "n_chars":
            value = F.when(F.col("_hit"), F.length("_clean").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return d.select(*out)
