"""SimHash fingerprints with DataFrame operations only.

Method.  A text's terms are its pairs of neighbouring words (the last word
stands alone), each weighing as often as it occurs.  Two 64-bit hashes of a term
vote on 128 signed bits; a fingerprint bit is 1 when the votes for 1 outweigh
those for 0.  Votes are added in packed lanes: ``(h >> s) & 0x0000000100000001``
holds bits s and s + 32 of a hash in two 32-bit lanes, so 64 sums count all 128
bits inside whole-stage code and the partial aggregate sends one row per text.

``near`` finds all fingerprints within a Hamming radius r: fingerprints are cut
into r + 2 blocks, so two within r agree on two blocks at least.  One table per
pair of blocks holds the fingerprints keyed by that pair (the permutation that
puts it in front); a query joins each table on its key and checks the whole
distance.  Two agreeing blocks of r + 2 make longer, more selective keys than one
of r + 1.  A pair of fingerprints counts in the first table that agrees, so
nothing needs a distinct.  Equal fingerprints collapse to one row with their
number and smallest id before that.

``RADIUS`` is what tables of bounded number allow: it finds copies with about one
word in a hundred changed.  Texts whose five-word shingles are only 0.8 alike
differ in 10 to 13 of the 128 bits and are the Jaccard join's task.

Defined cases: a null text counts as empty, and an empty text's fingerprint is
all zeros; null doc_ids come last in the descending order; rows of one doc_id
follow each other by their text; a single row is its own next document; repeated
rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WHITE = r"[\x20\x09-\x0D]+"
RADIUS = 7
BITS = 128
QUERY_EVERY = 100
LOWEST = -(1 << 63)
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def fingerprints(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` columns and ``lo``, ``hi``: the fingerprint of each row; ``key`` must tell rows apart."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE, -1), lambda w: w != "")
    t = texts.select(*key, words.alias("_w"))
    t = t.withColumn("_x", F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))))
    t = t.select(*key, F.explode_outer(F.arrays_zip("_w", "_x")).alias("_t"))
    first, second = F.col("_t._w"), F.col("_t._x")
    t = t.select(*key, F.when(first.isNotNull(), F.xxhash64(first, second)).alias("_a"), F.when(first.isNotNull(), F.xxhash64(second, F.lit("simhash"), first)).alias("_b"))
    sums = [F.sum(F.shiftrightunsigned(c, s).bitwiseAND(F.lit(_LANES))).alias(f"{c}{s}") for c in ("_a", "_b") for s in range(32)]
    t = t.groupBy(*key).agg(F.count("_a").alias("_n"), *sums)

    def half(c: str) -> Column:
        out = F.lit(0).cast("long")
        for s in range(32):
            votes = F.col(f"{c}{s}")
            out = out.bitwiseOR(F.when(votes.bitwiseAND(F.lit(_LOW)) * 2 > F.col("_n"), F.lit(1 << s)).otherwise(F.lit(0)).cast("long"))
            high = (1 << (s + 32)) if s < 31 else LOWEST
            out = out.bitwiseOR(F.when(F.shiftrightunsigned(votes, 32) * 2 > F.col("_n"), F.lit(high)).otherwise(F.lit(0)).cast("long"))
        return out

    return t.select(*key, half("_a").alias("lo"), half("_b").alias("hi"))


def as_text(lo: Column, hi: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.bit_count(a_lo.bitwiseXOR(b_lo)) + F.bit_count(a_hi.bitwiseXOR(b_hi))


def _blocks(lo: Column, hi: Column, radius: int) -> list[Column]:
    """The fingerprint in radius + 2 blocks of whole bits."""
    edges = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        parts = []
        for c, base in ((lo, 0), (hi, 64)):
            x, y = max(a, base) - base, min(b, base + 64) - base
            if y > x:
                mask = (1 << (y - x)) - 1 if y - x < 64 else -1
                parts.append(F.shiftrightunsigned(c, x).bitwiseAND(F.lit(mask)))
        out.append(parts[0] if len(parts) == 1 else F.xxhash64(*parts))
    return out


def _tables(radius: int) -> list[tuple[int, int]]:
    """The pairs of blocks, in order."""
    return [(i, j) for i in range(radius + 2) for j in range(i + 1, radius + 2)]


def near(queries: DataFrame, all_prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """lo, hi of each distinct query fingerprint, ``n_within`` (rows of ``all_prints`` within ``radius``) and ``first_within``, their smallest doc_id.

    ``all_prints`` has lo, hi and doc_id.
    """
    bank = all_prints.groupBy(F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    asked = queries.select("lo", "hi").distinct()

    def tables(df: DataFrame, lo: str, hi: str) -> DataFrame:
        blocks = _blocks(F.col(lo), F.col(hi), radius)
        keys = F.array(*[F.xxhash64(F.lit(t), blocks[i], blocks[j]) for t, (i, j) in enumerate(_tables(radius))])
        return df.withColumn("_blocks", F.array(*blocks)).select(*df.columns, "_blocks", F.posexplode(keys).alias("table", "value"))

    a = tables(asked, "lo", "hi")
    b = tables(bank, "b_lo", "b_hi").drop("table", "_blocks")
    hit = a.join(b, "value").where(distance(F.col("lo"), F.col("hi"), F.col("b_lo"), F.col("b_hi")) <= radius)
    # the first two blocks that agree name the table in which a pair counts
    agree = [x == y for x, y in zip([F.get("_blocks", i) for i in range(radius + 2)], _blocks(F.col("b_lo"), F.col("b_hi"), radius), strict=True)]
    both = F.slice(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(agree)])), 1, 2)
    order = F.array(*[F.array(F.lit(i), F.lit(j)) for i, j in _tables(radius)])
    hit = hit.where(F.get(order, F.col("table")) == both)
    return hit.groupBy("lo", "hi").agg(F.sum("n").alias("n_within"), F.min("least").alias("first_within"))


def with_next(docs: DataFrame, value: str, order: str = "_o", ties: list[str] | None = None, cuts: list[int] | None = None, bucket: str | None = None) -> DataFrame:
    """``docs`` with ``next_<value>``: ``value`` of the following row in descending ``order``; the first row follows the last.

    Rows are dealt into ranges of ``order`` whose upper ends are values that
    occur.  Rows at such an end also go to the range before it, marked as
    sentinels, so a window inside each range sees the row that follows its last.
    """
    w = Window.partitionBy("_bucket").orderBy("_sentinel", F.col(order).desc(), *(ties or []))
    return docs.withColumn(f"next_{value}", F.lead(value).over(w))


def ranges(docs: DataFrame, order: str = "_o") -> DataFrame:
    """``docs`` with ``_bucket`` and ``_sentinel``, sentinels added (see ``with_next``)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = [i / parts for i in range(1, parts)] or [0.5]
    got = docs.agg(F.max(order), F.percentile_approx(order, share, 10 * parts)).first()
    if got[0] is None:
        cuts = [0]
    else:
        cuts = sorted({got[0], *got[1]}, reverse=True)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(c).cast("long") for c in cuts[::step]])
    fine = F.array(*[F.lit(c).cast("long") for c in cuts])
    o = F.col(order)
    big = F.size(F.filter(coarse, lambda c: c >= o)) - 1
    docs = docs.withColumn("_big", big)
    at = F.col("_big") * step + F.size(F.filter(F.slice(fine, F.col("_big") * step + 1, F.lit(step)), lambda c: c >= o)) - 1
    docs = docs.withColumn("_at", at)
    end = F.element_at(fine, F.col("_at") + 1) == o
    previous = F.pmod(F.col("_at") - 1, F.lit(len(cuts)))
    own = F.struct(F.col("_at").cast("int").alias("b"), F.lit(0).alias("s"))
    docs = docs.withColumn("_p", F.explode(F.when(end, F.array(own, F.struct(previous.cast("int").alias("b"), F.lit(1).alias("s")))).otherwise(F.array(own))))
    return docs.withColumn("_bucket", F.col("_p.b")).withColumn("_sentinel", F.col("_p.s")).drop("_p", "_big", "_at")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``edited``: the text whose last half gives way to the next document's first characters."""
    d = common.with_columns(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("_o"))
    d = with_next(ranges(d), "text", ties=["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return d.select("doc_id", "_o", "_bucket", "_sentinel", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), (n - half)), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("edited"))


def report(docs: DataFrame, radius: int = RADIUS, query_every: int = QUERY_EVERY) -> DataFrame:
    """Fingerprints of each text and its edited text, their likeness, and the near search.

    ``n_within`` and ``first_within`` are given for rows whose doc_id is divisible
    by ``query_every``: how many other rows have a fingerprint within ``radius``,
    and the smallest doc_id among them and the row; else null.
    """
    e = edited(docs).withColumn("rid", F.monotonically_increasing_id())
    e = e.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = e.select("rid", "doc_id", "_o", "_bucket", "_sentinel", "n_chars", "edited_sha256", F.xxhash64("text").alias("_tie"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("_v"))
    key = ["rid", "which", "doc_id", "_o", "_bucket", "_sentinel", "n_chars", "edited_sha256", "_tie"]
    both = both.select(*[c for c in key if c != "which"], F.col("_v.which").alias("which"), F.col("_v.t").alias("t"))
    # the edited text of a sentinel is not asked for
    prints = fingerprints(both.where("_sentinel = 0 or which = 0"), key, "t")
    rest = [c for c in key if c not in ("rid", "which")]
    pick = lambda c, which: F.max(F.when(F.col("which") == which, F.col(c)))
    wide = prints.groupBy("rid", *rest).agg(pick("lo", 0).alias("lo"), pick("hi", 0).alias("hi"), pick("lo", 1).alias("e_lo"), pick("hi", 1).alias("e_hi"))
    wide = wide.withColumn("_print", F.struct("lo", "hi"))
    wide = with_next(wide, "_print", ties=["rid"]).where("_sentinel = 0")
    wide = common.saved(wide.select("doc_id", "n_chars", "edited_sha256", "lo", "hi", "e_lo", "e_hi", F.col("next__print.lo").alias("n_lo"), F.col("next__print.hi").alias("n_hi")))
    query = F.col("doc_id") % query_every == 0
    found = near(wide.where(query), wide, radius)
    out = wide.withColumn("_q", F.coalesce(query, F.lit(False))).join(found.withColumn("_q", F.lit(True)), ["lo", "hi", "_q"], "left")
    alike = lambda x, y: 1 - distance(F.col("lo"), F.col("hi"), F.col(x), F.col(y)) / BITS
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("lo"), F.col("hi")).alias("fingerprint"),
        as_text(F.col("e_lo"), F.col("e_hi")).alias("edited_fingerprint"),
        alike("e_lo", "e_hi").alias("near_edited"),
        alike("n_lo", "n_hi").alias("near_next"),
        F.when(F.col("_q"), F.col("n_within") - 1).alias("n_within"),
        F.when(F.col("_q"), F.col("first_within")).alias("first_within"),
    )
