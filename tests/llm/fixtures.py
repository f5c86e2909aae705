"""Rows that every operator must get through, and plain readings of texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
PROSE = "the quick brown fox jumps over the lazy dog while nine wise owls watch from an old oak tree"

EDGES = [
    (1, PROSE, "en", "web"),
    (2, PROSE, "en", "web"),
    (2, PROSE, "en", "web"),
    (3, None, None, None),
    (None, "a text without an id but with words enough to be a document of its own here", "en", "news"),
    (4, "", "de", "web"),
    (5, " \n\t ", "de", ""),
    (6, "short", None, "web"),
    (7, LONG, "en", "web"),
    (8, LONG + " end", "en", "web"),
    (100, "Ünïcödé texts — 東京タワー 🗼🗼 und Straßen, ærø. " * 3, "xx", "news"),
    (-200, "x" * 5000, "xx", "news"),
    (9, "line one is here\nline one is here\nline one is here\nand another one", "en", "books"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside; a table may have them too.
CLASHES = ["score", "kept", "rid", "_rid", "_row", "_key", "_rank", "_block", "_src", "_position", "node", "label", "found", "length"]


def edge_docs(spark: SparkSession) -> DataFrame:
    rows = [(*r, len(r[1]) if r[1] is not None else None, *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(EDGES)]
    return spark.createDataFrame(rows, SCHEMA + ", n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, k: int = 5) -> frozenset[tuple[str, ...]]:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
