"""A stored index of pairs of characters that prunes the rows of a word search.

A word of n letters may have n // 4 further characters between its letters
(``facets.fuzzy``).  Cut into n // 4 + 1 pieces, at least one piece stands in a
matching text without a break, as each further character breaks one piece at
most.  So a row can match only if its text has all character pairs of one piece;
the postings of those pairs say which rows do.  Only these candidates are read
and tested exactly.

The postings table has one row for each (pair, row): it is built once per
snapshot of the catalogue, partitioned by the hash of the pair, so that a search
reads the partitions of its pairs only.  Words with a piece of one letter prune nothing
by that piece; such words, and queries without words, test all rows.

Defined cases: rows with a null or empty text are found by no word; repeated ids
are found together; an id that is null is never found; pairs cross blanks, as
searches do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facets import words_match

SLOTS = 64


def pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.length(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.filter(each, lambda p: F.length(p) == 2))


def slot(pair: Column) -> Column:
    return F.pmod(F.xxhash64(pair), F.lit(SLOTS)).cast("int")


def build(rows: DataFrame, id_: str, text: Column, path: str) -> None:
    """Write the postings of ``rows`` below ``path``, replacing what is there.

    A row has some forty postings: the rows are dealt by id before they are
    unfolded, so no task makes them equal by a table of all of its file, and a
    partition with a frequent pair is split by its size before it is sorted.
    """
    t = rows.select(F.col(id_).alias("id"), text.alias("text")).where("id is not null and text <> ''")
    t = t.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    postings = t.select("id", F.explode(pairs(F.col("text"))).alias("pair")).withColumn("slot", slot(F.col("pair"))).distinct()
    postings.hint("rebalance", F.col("slot")).sortWithinPartitions("slot", "pair").write.mode("overwrite").partitionBy("slot").parquet(path)


def pieces(word: str) -> list[str]:
    """The word in len // 4 + 1 pieces of nearly equal length."""
    n = len(word) // 4 + 1
    return [word[i * len(word) // n : (i + 1) * len(word) // n] for i in range(n)]


def _slots_of(index: DataFrame, wanted: list[str]) -> list[int]:
    row = index.sparkSession.range(1).select(*[slot(F.lit(p)).alias(str(i)) for i, p in enumerate(wanted)]).first()
    return sorted(set(row))


def candidates(index: DataFrame, word: str) -> DataFrame | None:
    """Ids whose text has every pair of one of the word's pieces; None: the word prunes nothing."""
    cut = [sorted({p[i : i + 2] for i in range(len(p) - 1)}) for p in pieces(word)]
    if not all(cut):
        return None
    wanted = sorted({p for piece in cut for p in piece})
    hits = index.where(F.col("slot").isin(_slots_of(index, wanted)) & F.col("pair").isin(wanted))
    has = hits.groupBy("id").agg(*[F.max(F.col("pair") == p).alias(f"_{i}") for i, p in enumerate(wanted)])
    every = lambda piece: reduce(lambda a, b: a & b, [F.col(f"_{wanted.index(p)}") for p in piece])
    return has.where(reduce(lambda a, b: a | b, [every(piece) for piece in cut])).select("id")


def search(rows: DataFrame, id_: str, text: Column, query: str, index: DataFrame) -> DataFrame:
    """The rows that every word of the query matches; the exact test runs on candidates only."""
    words = query.lower().split()
    for word in sorted(words, key=len, reverse=True):
        some = candidates(index, word)
        if some is not None:
            rows = rows.join(some.select(F.col("id").alias(id_)), id_, "left_semi")
    return rows.where(words_match(text, query)) if words else rows
