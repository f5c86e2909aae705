"""Vector code compression: product codes by integer k-means over broadcast kd-trees.

Method.  A component x becomes the integer floor(``SCALE`` * x).  A vector is cut
into ``parts`` consecutive parts, each with a codebook of its own; the codebooks
start as the parts of the ``entries`` smallest vec_ids.  Each round broadcasts one
kd-tree per codebook.  A part's nearest entry (squared Euclidean distance) is
searched by branch and bound: the near side first, then the far side unless the
plane between lies farther than the best distance.  A far side at exactly the
best distance is visited too, and among equal distances the lower index wins, so
ties end as in a search of all entries.  Tasks return integer sums and counts per
(part, entry), summed by Spark; an entry becomes the floored mean of its parts
and an unused entry stays.  All arithmetic is in 64-bit integers, so the codes do
not depend on how rows are dealt.

The driver and each broadcast hold the codebooks only: parts x entries x part
length integers, whatever the number of vectors.  Every round scans ``vectors``
anew, so that should be a stored table.

Defined cases: rows whose vector is null or has null or non-finite components
are dropped; integer components are clamped to +-``LIMIT``, so that no sum of
squares overflows; a vector whose length differs from that of the smallest
vec_id's keeps its row with null code and error (and adds 0 to its label's
error); a length that ``parts`` does not divide is cut as evenly as can be; with
fewer vectors than ``entries`` the codebooks are smaller; null vec_ids come after
all others, equal ones in the order of their components; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LIMIT = 1 << 26
LEAF = 2

#: An inner node: (split component, split value, left, right); a leaf: its entries' indexes, ascending.
Tree = tuple | np.ndarray
Codebook = tuple[np.ndarray, Tree]


def kd_tree(entries: np.ndarray, index: np.ndarray | None = None) -> Tree:
    """Halve the entries at the median of the component that spreads most."""
    index = np.arange(len(entries)) if index is None else index
    mine = entries[index]
    spread = mine.max(0) - mine.min(0) if len(mine) else np.zeros(1, np.int64)
    if len(index) <= LEAF or not spread.any():
        return np.sort(index)
    axis = int(spread.argmax())
    order = index[np.argsort(mine[:, axis], kind="stable")]
    half = len(order) // 2
    return axis, int(entries[order[half], axis]), kd_tree(entries, order[:half]), kd_tree(entries, order[half:])


def nearest(codebook: Codebook, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each query's nearest entry, the lower index of equals."""
    entries, tree = codebook
    best = np.full(len(queries), np.iinfo(np.int64).max)
    at = np.full(len(queries), len(entries))

    def visit(node: Tree, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for e in node.tolist():
                d = ((queries[rows] - entries[e]) ** 2).sum(1)
                better = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
                best[rows[better]], at[rows[better]] = d[better], e
            return
        axis, split, left, right = node
        off = queries[rows, axis] - split
        near = off < 0
        for side, other, mine in ((left, right, rows[near]), (right, left, rows[~near])):
            visit(side, mine)
            gap = (queries[mine, axis] - split) ** 2
            visit(other, mine[gap <= best[mine]])  # equal bounds too: a lower index may lie there

    visit(tree, np.arange(len(queries)))
    return at, best


def cuts(width: int, parts: int) -> list[int]:
    return [i * width // parts for i in range(parts + 1)]


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of the vectors of each length, all of them non-null and finite."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    for width in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == width)
        yield rows, whole[first[rows][:, None] + np.arange(width)]


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), label of the rows whose vector has finite components only."""
    d = common.with_columns(vectors, vec_id="long", embedding="array<double>", label="string")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return d.where(F.col("embedding").isNotNull() & finite)


def _sums(books, parts: int):
    """part, entry, count and component sums of each task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = sum(c[0].shape[1] for c in books.value)
        at = cuts(width, parts)
        count = [np.zeros(len(c[0]), np.int64) for c in books.value]
        total = [np.zeros(c[0].shape, np.int64) for c in books.value]
        for batch in batches:
            for _, m in integers(batch.column("embedding")):
                if m.shape[1] != width:
                    continue
                for p in range(parts):
                    x = m[:, at[p] : at[p + 1]]
                    near, _ = nearest(books.value[p], x)
                    np.add.at(total[p], near, x)
                    count[p] += np.bincount(near, minlength=len(count[p]))
        rows = [(p, e, int(count[p][e]), total[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(count[p]).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "sums"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    return run


def _coded(books, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = sum(c[0].shape[1] for c in books.value)
        at = cuts(width, parts)
        for batch in batches:
            n = batch.num_rows
            codes, errors = np.full(n, None, object), np.full(n, None, object)
            for rows, m in integers(batch.column("embedding")):
                if m.shape[1] != width:
                    continue
                code, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
                for p in range(parts):
                    code[:, p], d = nearest(books.value[p], m[:, at[p] : at[p + 1]])
                    error += d
                codes[rows] = ["".join(f"{c:02x}" for c in r) for r in code.tolist()]
                errors[rows] = error
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part: one row of integers for each entry."""
    if entries > 256:
        raise ValueError("a code has two hex digits, so at most 256 entries")
    d = kept(vectors)
    common.workers_import(d.sparkSession)
    first = d.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    first = [np.clip(np.floor(np.array(r["embedding"], np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64) for r in first]
    if not first:
        return []
    first = [v for v in first if len(v) == len(first[0])]
    at = cuts(len(first[0]), parts)
    books = [np.array([v[at[p] : at[p + 1]] for v in first]) for p in range(parts)]
    for _ in range(rounds):
        told = d.sparkSession.sparkContext.broadcast([(b, kd_tree(b)) for b in books])
        sums = d.select("embedding").mapInArrow(_sums(told, parts), "part int, entry int, n long, sums array<long>")
        sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in sums.collect():  # one row for each component of the codebooks
            books[r["part"]][r["entry"], r["i"]] = r["x"] // r["n"]
        told.destroy()
    return books


def encoded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of each kept vector."""
    d = kept(vectors)
    common.workers_import(d.sparkSession)
    if not books:
        return d.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    told = d.sparkSession.sparkContext.broadcast([(b, kd_tree(b)) for b in books])
    return d.select("vec_id", "label", "embedding").mapInArrow(_coded(told, len(books)), "vec_id long, label string, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def report(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept vector."""
    books = trained(vectors, parts, entries, rounds)
    coded = common.saved(encoded(vectors, books))
    labels = coded.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
