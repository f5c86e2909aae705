"""Vocabulary normalisers, each one native expression.

Power sources and emitters are read word by word: small tables give each word
its kind, and the canonical name is put together from the kinds.  The short
vocabularies are ``Rules``: lower-cased terms to their canonical form, then
(pattern, replacement) rules of which the first match wins (None drops the
value), then a fallback.  ``normalise`` gives the Column for one value and
``normalise_array`` drops, deduplicates and sorts a cell.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.cells import dropped_sorted


Normaliser = Callable[[Column], Column]


@dataclass(frozen=True)
class Rules:
    exact: dict[str, str | None] = field(default_factory=dict)
    patterns: tuple[tuple[str, str | None], ...] = ()
    longest: int | None = None
    keep_unknown: bool = True
    lower: bool = True


def normalise(c: Column, rules: Rules) -> Column:
    low = F.lower(F.trim(c))
    out = (low if rules.lower else F.trim(c)) if rules.keep_unknown else F.lit(None).cast("string")
    if rules.longest is not None:
        out = F.when(F.length(low) <= rules.longest, out)
    for pattern, replacement in reversed(rules.patterns):
        new = F.lit(None).cast("string") if replacement is None else (F.regexp_replace(low, f"^.*?(?:{pattern}).*$", replacement) if "$" in replacement else F.lit(replacement))
        out = F.when(low.rlike(pattern), new).otherwise(out)
    known = {k: v for k, v in rules.exact.items() if v is not None}
    dropped = [k for k, v in rules.exact.items() if v is None]
    if known:
        table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
        out = F.coalesce(F.try_element_at(table, low), out)
    return F.when(low.isin("", "unknown", *dropped), F.lit(None).cast("string")).otherwise(out)


def normalise_array(c: Column, how: Rules | Normaliser, multiples: bool = False) -> Column:
    """Normalised items; with ``multiples`` an item ``NxA`` is normalised inside and also gives A."""
    one = (lambda x: normalise(x, how)) if isinstance(how, Rules) else how
    if not multiples:
        return dropped_sorted(F.transform(c, one))

    def both(x: Column) -> Column:
        count = F.regexp_extract(F.lower(x), r"^\s*([0-9]+)\s*[x×*]\s*(\S.*)$", 1)
        inner = one(F.regexp_extract(F.lower(x), r"^\s*([0-9]+)\s*[x×*]\s*(\S.*)$", 2))
        return F.when(count == "1", F.array(inner)).when(count != "", F.array(inner, F.concat(count, F.lit("x"), inner))).otherwise(F.array(one(x)))

    return dropped_sorted(F.flatten(F.transform(c, both)))


def kinds_of(words: Column, table: dict[str, str]) -> Column:
    """The kind of each word by the table, ``#`` for numbers, ``?`` for the rest; as one string with blanks around each."""
    known = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    kind = lambda w: F.coalesce(F.try_element_at(known, w), F.when(w.rlike("^[0-9]"), F.lit("#")).otherwise(F.lit("?")))
    return F.concat(F.lit(" "), F.array_join(F.transform(words, kind), " "), F.lit(" "))


# fixed values: sizes of cells, and what single words of a power source mean
CELLS = "10150 10180 10220 10280 10400 10440 10880 10900 14100 14250 14300 14500 14580 16300 16340 16650 18350 18500 18650 20350 20700 21140 21700 22430 22650 26350 26650 26800 26980 32650 32700 33140 46950".split()
POWER_WORDS = {
    **dict.fromkeys(CELLS, "size"),
    **dict.fromkeys(("built", "integrated", "internal", "custom", "customized", "customised", "zithion"), "fixed"),
    **dict.fromkeys(("nbp", "nl", "arb", "inr", "ixr", "zx"), "own"),
    **dict.fromkeys(("mah", "ah", "wh"), "charge"),
    **dict.fromkeys(("v", "volt", "volts"), "volt"),
    **dict.fromkeys(("lantern", "zinc", "carbon", "sla", "sealed"), "lantern"),
    **dict.fromkeys(("battery", "batteries", "cell", "cells"), "filler"),
    **dict.fromkeys(("poly", "polymer", "pol", "po", "lipo", "lipoly"), "poly"),
    **dict.fromkeys(("li", "lithium"), "li"),
    **dict.fromkeys(("cr", "rcr"), "cr"),
    **dict.fromkeys(("2016", "2032"), "coin"),
    **dict.fromkeys(("18", "20", "21", "24", "36", "40", "56", "80"), "tool"),
    "ion": "ion", "liion": "ion", "nimh": "nimh", "nicd": "nicd", "lifepo": "iron", "alkaline": "alkaline", "rechargeable": "again", "pack": "pack", "wired": "wired",
    "lr": "lr", "44": "small", "41": "small", "123": "photo", "a": "a", "aa": "aa", "aaa": "aaa", "c": "c", "d": "d", "sub": "sub",
}
#: What a sequence of kinds means: the first that holds.  ``size`` and ``number`` stand for the words themselves.
POWER_SHAPES: list[tuple[str, str | None]] = [
    ("^ fixed | fixed pack ", "built-in"),
    (" size ", "{size}"),
    (" cr photo |^ photo a ", "CR123A"),
    (" cr coin |^ coin ", "CR{number}"),
    (" lr small ", "LR{number}"),
    (" aaa ", "AAA"),
    (" aa ", "AA"),
    ("^ sub c ", "Sub-C"),
    ("^ c (filler |alkaline )*$", "C"),
    ("^ d (filler |alkaline )*$", "D"),
    (" # volt (. )*lantern | # volt lantern ", "{number}V lantern"),
    ("^ tool volt $", None),
    (" (#|tool|small|size) (volt|charge) | own #", "built-in"),
    (" own | fixed ", "built-in"),
    (" iron ", "LiFePO4"),
    (" poly ", "Li-poly"),
    ("^ (again )?li ion (again )?$", "Li-ion"),
    ("^ again li ", "built-in"),
    (" (filler|wired) pack ", "Li-ion pack"),
    (" ion ", "Li-ion"),
    (" nimh ", "NiMH"),
    (" nicd ", "NiCd"),
    ("^ alkaline (filler )*$", "alkaline"),
    ("^ (filler |again )+$", None),
]
POWER_WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)?"
NO_VALUE = ("", "unknown", "n/a", "none")
LONGEST_POWER = 30


def battery(c: Column) -> Column:
    """A power source in its canonical form, from the kinds of its words; unknown short ones stay, None where it says nothing."""
    whole = F.trim(c)
    words = F.regexp_extract_all(F.replace(F.lower(whole), F.lit(","), F.lit("")), F.lit(POWER_WORD), F.lit(0))
    kinds = kinds_of(words, POWER_WORDS)
    size = F.get(F.filter(words, lambda w: w.isin(CELLS)), 0)
    number = F.get(F.filter(words, lambda w: w.rlike("^[0-9]")), 0)
    out = F.when(F.length(whole) > LONGEST_POWER, F.lit("built-in")).otherwise(whole)
    for shape, name in reversed(POWER_SHAPES):
        if name is None:
            new = F.lit(None).cast("string")
        elif "{" in name:
            new = F.concat(*[size if x == "{size}" else number if x == "{number}" else F.lit(x) for x in re.split(r"(\{\w+\})", name) if x])
        else:
            new = F.lit(name)
        out = F.when(kinds.rlike(shape), new).otherwise(out)
    return F.when(~F.lower(whole).isin(*NO_VALUE), out)


# fixed values: canonical terms and rules of each vocabulary
MATERIAL = Rules(
    exact={"al": "aluminum", "alu": "aluminum", "aluminium": "aluminum", "ti": "titanium", "cu": "copper", "ss": "stainless steel", "pc": "polycarbonate", "n/a": None},
    patterns=((r"alumin", "aluminum"), (r"titan", "titanium"), (r"copper", "copper"), (r"brass", "brass"), (r"stainless", "stainless steel"), (r"steel", "steel"), (r"magnes", "magnesium"), (r"polycarb", "polycarbonate"), (r"nylon", "nylon"), (r"\babs\b", "abs"), (r"plastic|polymer|resin", "polymer"), (r"rubber|silicon", "rubber"), (r"carbon", "carbon fiber"), (r"damascus", "damascus")),
    longest=50,
)
SWITCH = Rules(
    exact={"tail": "tail switch", "tailcap": "tail switch", "rear": "tail switch", "side": "side switch", "body": "side switch", "none": None},
    patterns=((r"dual|two switch", "dual switch"), (r"tail|rear|end ?cap", "tail switch"), (r"electronic|e-switch", "electronic switch"), (r"side|body", "side switch"), (r"rotar|dial|knob", "rotary"), (r"twist", "twist"), (r"magnetic ring|control ring", "magnetic ring"), (r"touch", "touch"), (r"remote", "remote"), (r"slid", "slide"), (r"push", "push button")),
    longest=30,
)
FEATURES = Rules(
    exact={"pocket clip": "clip", "belt clip": "clip", "magnet": "magnet", "magnetic base": "magnet", "magnetic tail": "magnet", "usb-c": "usb-c", "usb c": "usb-c", "type-c": "usb-c", "memory": "mode memory", "lockout": "lockout", "anduril": "anduril"},
    patterns=((r"\bclip\b", "clip"), (r"magnet", "magnet"), (r"usb.?c|type.?c", "usb-c"), (r"micro.?usb", "micro-usb"), (r"power ?bank", "powerbank"), (r"lock ?out", "lockout"), (r"memory", "mode memory"), (r"lanyard", "lanyard"), (r"holster|sheath", "holster"), (r"diffus", "diffuser"), (r"strobe", "strobe"), (r"tail ?stand", "tail stand"), (r"glow|tritium", "glow")),
    longest=50,
)
COLOURS: list[tuple[str, str]] = [("gunmetal", "gray"), ("rose gold", "pink"), ("sand", "tan"), ("olive", "green"), ("black", "black"), ("white", "white"), ("silver", "silver"), ("grey", "gray"), ("gray", "gray"), ("red", "red"), ("blue", "blue"), ("green", "green"), ("gold", "yellow"), ("yellow", "yellow"), ("orange", "orange"), ("purple", "purple"), ("pink", "pink"), ("tan", "tan"), ("brown", "brown")]


# fixed values: makers, how the identifiers of a family are built, words that tell no emitter, and names that are none of these
MAKERS = {"cree": "Cree", "luminus": "Luminus", "luminous": "Luminus", "luminux": "Luminus", "nichia": "Nichia", "osram": "Osram", "samsung": "Samsung", "luxeon": "Luxeon", "seoul": "Seoul", "nitelab": "NiteLab"}
#: (compact identifier, maker, parts): a part is a text, ``$n`` a captured group, `` $n`` or ``-$n`` one that is left out with its mark when empty.
FAMILIES: list[tuple[str, str, tuple[str, ...]]] = [
    (r"xp([a-z])([0-9]*)(hi|hd)?(?:[qrstuv][0-9])?", "Cree", ("XP-", "$1", "$2", " $3")),
    (r"xml([0-9]*)(?:[qrstuv][0-9])?", "Cree", ("XM-L", "$1")),
    (r"xhp([0-9]+(?:\.[0-9])?)(hi|hd)?", "Cree", ("XHP", "$1", " $2")),
    (r"(mc|xr)(e)", "Cree", ("$1", "-$2")),
    (r"(s[bfs]t)([0-9]+(?:\.[0-9])?)(w?)", "Luminus", ("$1", "-$2", "-$3")),
    (r"([235]19[a-z]+|e21[a-z])", "Nichia", ("$1",)),
    (r"(lh351[a-z])", "Samsung", ("$1",)),
    (r"(?:kw)?(c[su]l[a-z]{2}[0-9])(?:\.?tg)?", "Osram", ("$1", ".TG")),
    (r"(p[89])", "Osram", ("$1",)),
    (r"((?:ntg|sfq|ssq)[0-9]+)", "", ("$1",)),
]
TELLS_NOTHING = "high power performance quality output super ultra bright brightness cool warm neutral natural day white red green blue amber yellow led leds chip chips emitter emitters single others bulb w watt watts k cri hcri dd unknown".split()
#: The start of an identifier alone.
BARE = ("hi", "xp", "xhp")
#: Colour temperatures, counts, colour rendering, brightness bins.
MEASURE = r"[0-9]+|[0-9]{4,5}k|r9[05678]?[0-9]?0|[0-9]{2}cri|[qrstuvk][0-9]"
LAMPS = {"cob led": "COB", "halogen bulb": "Halogen", "xenon bulb": "Xenon"}
COUNTED = r"^([0-9]+)\s*[x*×]\s*"
BETWEEN = r"[\s,()+–]+"


def emitter(c: Column) -> Column:
    """An LED in its canonical form: maker and identifier, with its number of dies in front.

    Words are told apart by tables: makers, words and measures that name no
    emitter, and the rest, which is the identifier.  An identifier of a known
    family is put together from its parts; another name stays as it is written;
    without an identifier the value is null.
    """
    whole = F.trim(F.regexp_replace(c, r"\s+", " "))
    count = F.regexp_extract(F.lower(whole), COUNTED, 1)
    raw = F.regexp_replace(whole, "(?i)" + COUNTED, "")
    low = F.lower(raw)
    low = F.regexp_replace(low, r"\b(xhp|s[bfs]t)[\s-]+([0-9])", "$1$2")  # a size belongs to its family
    words = F.filter(F.transform(F.split(low, BETWEEN), lambda w: F.regexp_replace(w, "^-+|-+$", "")), lambda w: w != "")
    makers = F.create_map(*[F.lit(x) for pair in sorted(MAKERS.items()) for x in pair])
    said = F.get(F.filter(F.transform(words, lambda w: F.try_element_at(makers, w)), lambda m: m.isNotNull()), 0)
    names = F.filter(words, lambda w: ~w.isin(*MAKERS, *TELLS_NOTHING) & ~w.rlike(f"^(?:{MEASURE})$"))
    # the digit of a generation is no count
    joined = F.regexp_replace(F.array_join(words, " "), r"\s+(?:gen\s*2|ii)\b", ".2")
    names = F.when(joined != F.array_join(words, " "), F.filter(F.split(joined, " "), lambda w: ~w.isin(*MAKERS))).otherwise(names)
    compact = F.replace(F.array_join(names, ""), F.lit("-"), F.lit(""))
    kept = F.array_join(F.filter(F.split(raw, " "), lambda w: ~F.lower(w).isin(*MAKERS)), " ")
    out = F.when((F.size(names) > 0) & ~compact.isin(*BARE), F.concat_ws(" ", said, F.when(kept != "", kept)))
    for pattern, maker, parts in reversed(FAMILIES):
        group = lambda x: F.upper(F.regexp_extract(compact, f"^(?:{pattern})$", int(x[-1])))  # noqa: B023, E731
        texts = [F.when(group(x) != "", F.concat(F.lit(x[:-2]), group(x))).otherwise(F.lit("")) if "$" in x else F.lit(x) for x in parts]
        out = F.when(compact.rlike(f"^(?:{pattern})$"), F.concat(F.lit(f"{maker} " if maker else ""), *texts)).otherwise(out)
    lamps = F.create_map(*[F.lit(x) for pair in sorted(LAMPS.items()) for x in pair])
    out = F.coalesce(F.try_element_at(lamps, low), out)
    return F.when(count != "", F.concat(count, F.lit("x "), out)).otherwise(out)


def change_report(df: DataFrame, column: str, rules: Rules) -> DataFrame:
    """before, after: distinct values; changed, unchanged, dropped: items."""
    t = df.select(F.explode(column).alias("old")).withColumn("new", normalise(F.col("old"), rules))
    return t.agg(F.count_distinct("old").alias("before"), F.count_distinct("new").alias("after"), F.count_if(F.col("new").isNotNull() & (F.col("new") != F.col("old"))).alias("changed"), F.count_if(F.col("new") == F.col("old")).alias("unchanged"), F.count_if(F.col("new").isNull()).alias("dropped"))


NORMALISERS: dict[str, Normaliser] = {
    "battery": lambda c: normalise_array(c, battery, multiples=True),
    "material": lambda c: normalise_array(c, MATERIAL),
    "switch": lambda c: normalise_array(c, SWITCH),
    "features": lambda c: normalise_array(c, FEATURES),
    "led": lambda c: dropped_sorted(F.transform(c, emitter)),
}


ITEM: dict[str, Normaliser] = {
    "battery": battery,
    "material": lambda c: normalise(c, MATERIAL),
    "switch": lambda c: normalise(c, SWITCH),
    "features": lambda c: normalise(c, FEATURES),
    "led": emitter,
}


def once_each(df: DataFrame, column: str, how: Normaliser, name: str) -> DataFrame:
    """``df`` and ``name``: what ``how`` makes of the cell, worked out once for each different cell; null for a null cell."""
    different = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(different.select(column, how(F.col(column)).alias(name)), column, "left")


def normalised_table(df: DataFrame, columns: list[str], path: str) -> dict[str, tuple[int, int, int]]:
    """Write ``df`` with its cells normalised; gives (items, dropped, changed) of each column, observed in the same pass.

    Each column's name is that of its vocabulary.
    """
    seen = Observation("vocabularies")
    t = df
    for n in columns:
        pairs = lambda c, n=n: F.transform(c, lambda x: F.struct(x.alias("old"), ITEM[n](x).alias("new")))
        t = once_each(t, n, pairs, f"_{n}")
    t = t.withColumns({f"_{n}": F.coalesce(f"_{n}", F.array().cast("array<struct<old:string,new:string>>")) for n in columns})
    size = lambda n, test: F.sum(F.size(F.filter(f"_{n}", test))).cast("long")
    counts = []
    for n in columns:
        counts += [F.sum(F.size(f"_{n}")).cast("long").alias(f"{n}_items"), size(n, lambda p: p.new.isNull()).alias(f"{n}_dropped"), size(n, lambda p: p.new != p.old).alias(f"{n}_changed")]
    t = t.observe(seen, *counts)
    out = [dropped_sorted(F.transform(F.col(f"_{c}"), lambda p: p.new)).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    t.select(*out).write.mode("overwrite").parquet(path)
    return {n: tuple(seen.get[f"{n}_{k}"] or 0 for k in ("items", "dropped", "changed")) for n in columns}
