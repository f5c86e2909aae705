"""Target-distribution importance resampling by position-table n-grams.

Method.  The words of a text are posexploded into a position table.  For each
order up to ``orders``, a window ``lead()`` per document sets the following words
beside each word; the word and its followers, joined by one space, are a feature.
A feature's bucket is the crc32 of its UTF-8 bytes modulo ``buckets``.  Counting
buckets over all documents and over all target texts gives each bucket a gain,
the floored log ratio of the two smoothed multinomials; features join the gains
and a document's weight is their floored mean.  Gumbel noise drawn from the
document's id turns the weights into keys, and the highest keys are a sample
without replacement.

The gains table has one row per bucket, so its broadcast is bounded by
``buckets``.  Order 1 takes no follower, so the window is laid out for orders
from 2 on only; there the texts are dealt by row first, so that words of one
document need no second shuffle.  Ranks come from ranges of the keys, never from
one task.

Defined cases: null and empty texts have no feature, weight 0 and are never
drawn for want of words; a null doc_id is hashed as an empty string and loses
ties; repeated rows are rows of their own; an empty table gives no rows and
empty targets give equal target counts of 0; extra columns are ignored by
``resample`` and kept by ``drawn``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ranks import ranked_in_order

#: A run of digits, small letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDERS = 1
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
SCALE = 1000


def words(text: Column) -> Column:
    """The words of a text, A-Z (and no other letters) lower-cased."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def position_table(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, *keep: str) -> DataFrame:
    """rid, the ``keep`` columns, order and bucket: a row for each feature, and one with a null bucket for a text without any."""
    if orders > 1:
        texts = texts.repartition("rid")
    table = texts.select("rid", *keep, F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    if orders > 1:
        following = Window.partitionBy("rid").orderBy("pos")
        table = table.select("*", *[F.lead("word", i).over(following).alias(f"_w{i}") for i in range(1, orders)])
        run = lambda n: F.when(F.col("word" if n == 1 else f"_w{n - 1}").isNotNull(), F.concat_ws(" ", "word", *[f"_w{i}" for i in range(1, n)]))
        each = F.array(*[F.struct(F.lit(n).alias("order"), run(n).alias("feature")) for n in range(1, orders + 1)])
        table = table.select("rid", *keep, F.explode(each).alias("f")).where("f.feature is not null or f.order = 1").select("rid", *keep, "f.order", "f.feature")
    else:
        table = table.select("rid", *keep, F.lit(1).alias("order"), F.col("word").alias("feature"))
    return table.select("rid", *keep, "order", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"))


def counts(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    table = position_table(texts, orders, buckets)
    return table.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(raw: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: one row for each bucket that the raw texts have."""
    s = common.saved(counts(raw, orders, buckets).withColumnRenamed("n", "s"))
    t = common.saved(counts(target, orders, buckets).withColumnRenamed("n", "t"))
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long")).first()[0]
    raw_n, target_n = total(s, "s"), total(t, "t")
    d = lambda c: F.col(c).cast("double")
    got = s.join(F.broadcast(t), "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    ratio = (d("t") + 1) * F.lit(float(raw_n + buckets)) / ((d("s") + 1) * F.lit(float(target_n + buckets)))
    return got.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Floored, scaled Gumbel noise from the first 32 bits of a seeded digest of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _scored(docs: DataFrame, target: DataFrame, orders: int, buckets: int, seed: str, least_words: int, percent: int) -> DataFrame:
    """rid, doc_id, n_features, weight, score and rank of each row of ``docs``, which has rid, doc_id and text."""
    gain = gains(docs, target.select(F.monotonically_increasing_id().alias("rid"), "text"), orders, buckets)
    table = position_table(docs, orders, buckets, "doc_id").join(F.broadcast(gain), "bucket", "left")  # one row per bucket at most
    seen = table.groupBy("rid", "doc_id").agg(F.count("bucket").alias("n_features"), F.count_if((F.col("order") == 1) & F.col("bucket").isNotNull()).alias("n_words"), F.sum("gain").alias("total"))
    mean = F.expr("(total - pmod(total, n_features)) div n_features")  # floored, in integers
    weight = F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long")
    scored = seen.select("rid", "doc_id", "n_features", "n_words", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = common.saved(scored)
    enough = scored.where(F.col("n_words") >= least_words)
    take = percent * enough.count() // 100
    place = ranked_in_order(enough, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid")], "rank")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = place.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).unionByName(rest)
    return out.select("rid", "doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each row of ``docs``, a stored table."""
    d = common.with_columns(docs, doc_id="long", text="string").withColumn("rid", F.monotonically_increasing_id())
    got = _scored(d, common.with_columns(target, text="string"), orders, buckets, seed, least_words, percent)
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are drawn, their columns unchanged."""
    d = common.saved(common.boxed(docs, doc_id="long", text="string").withColumn("rid", F.monotonically_increasing_id()))
    got = _scored(d.select("rid", "doc_id", "text"), common.with_columns(target, text="string"), orders, buckets, seed, least_words, percent)
    return common.unboxed(d.join(got.where("rank is not null"), "rid", "left_semi"), docs.columns)
