"""N-gram Jaccard self join: MinHash LSH forest, then exact verification.

Method.  Each text becomes its set of five-word shingles (64-bit hashes of all
words under a key drawn for the run; a text of one to four words is one shingle).  Equal sets collapse first,
by a partially aggregated group on a 128-bit key of the set, so thousands of
copies are one node afterwards.  Each node gets ``TREES`` label sequences of
``DEPTH`` MinHash values.  A tree is the trie of its sorted sequences; two nodes
meet in it when they share a prefix.

Matched prefixes start at ``DEPTH`` and are shortened until a pair at the
threshold meets in some tree with probability ``RECALL``: 1 - prod(1 -
threshold ** depth).  ``base_depth`` is the common depth at which all trees
together reach it.  A node whose prefixes of that depth are shared by at most
``CROWD`` nodes shortens all trees to it.  A node in a more crowded prefix
shortens one tree after the other, trees without a crowd first and then that with
the fewest nodes under its next prefix, and stops as soon as the recall is
reached, so its most crowded trees keep longer prefixes.  The bound holds for every node by itself, whatever
its partner has chosen.

Verification is exact.  A node belongs to the smallest node it shares a base
prefix with, so that a group of near copies lies together, and such a group is
dealt into blocks of about ``BLOCK`` nodes.  Two blocks that share a prefix meet in
one task, with those nodes only that share one (all of a block's nodes under a
crowded prefix), so a pair is compared once however many trees it shares, and a
crowded prefix is split over tasks.  Shingle sets are intersected as numbers, and a task
gives back per node its count of links and one edge towards the smallest linked
node, never the pairs.  Components over those edges give the classes.

Links: two documents whose shingle sets have a Jaccard similarity of at least
``THRESHOLD``.  ``n_links`` counts a document's links to other documents,
copies included; ``n_texts`` those to other shingle sets.  ``class_id`` is the
smallest doc_id reachable over links; members of a class may be less alike than
the threshold among themselves.

Defined cases: null and empty texts have no shingle and no link and are their
own class; a null doc_id stays null and, alone in its class, gives a null
class_id; repeated rows are copies of each other; extra columns are ignored by
``classes`` and kept by ``one_per_class``.  Rows are numbered once, in a stored
table; a text that does not give its node's key again raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.999
CROWD = 64
BLOCK = 256


def base_depth(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Shorten all prefixes from ``depth`` until a pair at the threshold is met often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shortened(under: np.ndarray, base: int, threshold: float = THRESHOLD, recall: float = RECALL) -> np.ndarray:
    """Depth of each tree for each node; ``under[node, tree, i]`` counts the nodes under its prefix of depth ``base + i``.

    From the longest prefix on, the tree whose next prefix has the fewest nodes
    is shortened, until the recall is reached or all are at ``base``.
    """
    n, trees, levels = under.shape
    at = np.full((n, trees), levels - 1)
    miss = np.log1p(-(threshold ** (base + np.arange(levels))))
    goal = np.log(1 - recall)
    row = np.arange(n)
    for _ in range(trees * (levels - 1)):
        open_ = (miss[at].sum(1) > goal) & (at > 0).any(1)
        if not open_.any():
            break
        ahead = np.where(at > 0, np.take_along_axis(under, np.maximum(at - 1, 0)[:, :, None], 2)[:, :, 0], np.iinfo(np.int64).max)
        tree = ahead.argmin(1)
        at[row[open_], tree[open_]] -= 1
    return at + base


def shingle_sets(buf: np.ndarray, off: np.ndarray, key: tb.Key, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a chunk's texts: (text number, hash)."""
    h, _, _, text = tb.word_hashes(buf, off, key=key)
    win, at = tb.windows(h, text, k)
    owner = text[at]
    n = len(off) - 1
    count = np.bincount(text, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(text, short)
        x = np.zeros(len(short), tb.U64)
        for j in range(k - 1):
            more = count[short] > j
            x[more] = x[more] * tb.U64(tb.BASE) + h[first[more] + j]
        win = np.concatenate([win, tb.mix(x ^ tb.U64(0x5DEECE66D))])
        owner = np.concatenate([owner, short])
    order = np.argsort(win)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    win, owner = win[order], owner[order]
    new = np.ones(len(win), bool)
    new[1:] = (win[1:] != win[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], win[new]


def set_keys(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's set, and its size."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        c = np.zeros(len(h) + 1, tb.U64)
        np.cumsum(tb.mix(h + tb.U64(salt)), out=c[1:])
        at = np.searchsorted(owner, np.arange(n + 1))
        out.append(tb.mix(c[at[1:]] - c[at[:-1]]).view(np.int64))
    return out[0], out[1], np.diff(at)


def _features(trees: int, depth: int, base: int, k: int, key: tb.Key):
    rng = np.random.default_rng(8191)
    mult = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in tb.chunks(batch.column("text")):
                owner, h = shingle_sets(buf, off, key, k)
                n = b - a
                k1, k2, size = set_keys(owner, h, n)
                full = np.flatnonzero(size)
                first = np.searchsorted(owner, full)
                labels = np.zeros((n, trees), np.uint64)
                deeper = np.zeros((n, trees, depth - base), np.uint32)
                for t in range(trees if len(full) else 0):
                    x = np.zeros(len(full), np.uint64)
                    for d in range(depth):
                        i = t * depth + d
                        value = np.minimum.reduceat((h * mult[i] + add[i]) >> np.uint64(16), first)
                        if d < base:
                            x = tb.mix(x + value)
                        else:
                            deeper[full, t, d - base] = tb.mix(value).astype(np.uint32)
                    labels[full, t] = x
                lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (m.size // n)), pa.array(m.reshape(-1).view(kind)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").slice(a, n), batch.column("doc_id").slice(a, n), pa.array(k1), pa.array(k2), pa.array(size.astype(np.int64)), lists(labels, np.int64), lists(deeper, np.int32)],
                    names=["rid", "doc_id", "k1", "k2", "size", "labels", "deeper"],
                )

    return run


def _depths(trees: int, depth: int, base: int, threshold: float, recall: float):
    """The prefixes that each node asks for in its crowded trees, from (at, key, under) of their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, levels = batch.num_rows, depth - base + 1
            lists = batch.column("k")
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            at, key, count = (lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            keys, under = np.zeros((2, n, trees * levels), np.int64)
            keys[row, at], under[row, at] = key, count
            chosen = shortened(under.reshape(n, trees, levels), base, threshold, recall) - base
            place = np.arange(trees) * levels + chosen
            keys, told = np.take_along_axis(keys, place, 1), np.take_along_axis(under, place, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys[told > 0]))], names=["key"])

    return run


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j), i from ``left`` and j from ``right``; i < j where both are one list.

    Intersections are counted as products of 0/1 matrices over slabs of the
    shingles that more than one set has.
    """
    size = np.array([len(s) for s in sets], np.int64)
    same = left is right
    if len(left) * len(right) <= 64:
        for i in left:
            for j in right:
                if (i < j if same else True) and min(size[i], size[j]) >= threshold * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both and both + 1e-9 >= threshold * (size[i] + size[j] - both):
                        yield np.array([i]), np.array([j])
        return
    owner = np.repeat(np.arange(len(sets)), size)
    _, term, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[term] > 1
    owner = owner[shared]
    term = np.unique(term[shared], return_inverse=True)[1]
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    both = np.zeros((len(left), len(right)), np.float32)
    row = np.full(len(sets), -1)
    row[left] = np.arange(len(left))
    col = np.full(len(sets), -1)
    col[right] = np.arange(len(right))
    top = int(term[-1]) + 1 if len(term) else 0
    for a in range(0, top, 1024):
        lo, hi = np.searchsorted(term, [a, a + 1024])
        x = np.zeros((len(left), 1024), np.float32)
        y = np.zeros((len(right), 1024), np.float32)
        o, t = owner[lo:hi], term[lo:hi] - a
        x[row[o][row[o] >= 0], t[row[o] >= 0]] = 1
        y[col[o][col[o] >= 0], t[col[o] >= 0]] = 1
        both += x @ y.T
    near = (both > 0) & (both + 1e-6 >= threshold * (size[left][:, None] + size[right][None, :] - both))
    i, j = np.nonzero(near)
    if same:
        i, j = i[i < j], j[i < j]
    yield left[i], right[j]


def _verify(threshold: float, k: int, secret: tb.Key):
    def group(key: tuple, nodes: list, copies: list, blocks: list, sets: list) -> pa.RecordBatch | None:
        block = np.array(blocks)
        left = np.flatnonzero(block == key[0])
        right = left if key[0] == key[1] else np.flatnonzero(block == key[1])
        if not len(left) or not len(right):
            return None
        texts, docs, root = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), list(range(len(nodes)))
        copies = np.array(copies, np.int64)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in links_within(sets, left, right, threshold):
            np.add.at(texts, i, 1)
            np.add.at(texts, j, 1)
            np.add.at(docs, i, copies[j])
            np.add.at(docs, j, copies[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
        at = np.flatnonzero(texts)
        if not len(at):
            return None
        ids = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[[find(i) for i in at.tolist()]]), pa.array(texts[at]), pa.array(docs[at])], names=["node", "hub", "n_texts", "n_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, ([], [], [], [])
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("i", "j")), strict=True))
            node, k1, k2, copies, block = (batch.column(c).to_pylist() for c in ("node", "k1", "k2", "copies", "block"))
            for a, b, buf, off in tb.chunks(batch.column("text")):
                owner, h = shingle_sets(buf, off, secret, k)
                k1s, k2s, _ = set_keys(owner, h, b - a)
                at = np.searchsorted(owner, np.arange(b - a + 1))
                for r in range(b - a):
                    if keys[a + r] != key:
                        if key is not None and (out := group(key, *rows)) is not None:
                            yield out
                        key, rows = keys[a + r], ([], [], [], [])
                    if (k1s[r], k2s[r]) != (k1[a + r], k2[a + r]):
                        raise ValueError(f"row {node[a + r]} is not the text its keys were taken from")
                    for into, value in zip(rows, (node[a + r], copies[a + r], block[a + r], h[at[r] : at[r + 1]].copy()), strict=True):
                        into.append(value)
        if key is not None and (out := group(key, *rows)) is not None:
            yield out

    return run


def candidates(nodes: DataFrame, trees: int, depth: int, base: int, threshold: float, recall: float, crowd: int, block: int, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(i, j, node): which nodes meet in the task of which two blocks; and (node, block)."""
    member = nodes.select("node", F.posexplode("labels").alias("tree", "label")).select("node", "tree", F.xxhash64("tree", "label").alias("key"))
    shared = scratch.saved(member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1"))
    member = scratch.saved(member.join(shared.hint("merge"), "key"))  # tables of their own, so that joins can split a frequent prefix
    hubs = scratch.saved(member.groupBy("node").agg(F.min("hub").alias("hub"), F.max("n").alias("n")))
    sizes = hubs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    placed = hubs.join(sizes, "hub").select("node", F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"), (F.col("n") > crowd).alias("crowded"))
    placed = scratch.saved(placed)
    pair = lambda x, y: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))

    few = member.where(F.col("n") <= crowd).select("key", "node").join(placed, "node")
    few = few.groupBy("key").agg(F.collect_list(F.struct("node", "block")).alias("m"), F.collect_set("block").alias("blocks"))  # at most ``crowd`` nodes
    few = few.select(F.explode("m").alias("m"), "blocks").select("m.node", "m.block", F.explode("blocks").alias("other"))
    fine = few.select(pair(F.col("block"), F.col("other")).alias("p"), "node").select("p.i", "p.j", "node").distinct()

    # the crowded prefixes of each node, their longer ones in the same tree, and how many nodes are under each
    crowded = placed.where("crowded").select("node", "block")
    levels = depth - base
    base_keys = member.where(F.col("n") > crowd).select("node", "tree", "key", F.col("n").alias("under"))
    base_keys = scratch.saved(base_keys.join(crowded, "node"))
    longer = lambda l: F.struct(F.lit(l).alias("level"), F.xxhash64(F.lit(l), "key", F.slice("deeper", F.col("tree") * levels + 1, F.lit(l))).alias("key"))
    deeper = base_keys.join(nodes.select("node", "deeper"), "node")
    deeper = deeper.select("node", "block", "tree", F.explode(F.array(*[longer(l) for l in range(1, levels + 1)])).alias("x")).select("node", "block", "tree", "x.level", "x.key") if levels else base_keys.select("node", "block", "tree", F.lit(0).alias("level"), "key").limit(0)
    deeper = scratch.saved(deeper)
    under = scratch.saved(deeper.groupBy("key").agg(F.count(F.lit(1)).alias("under")))
    every = deeper.join(under, "key").unionByName(base_keys.withColumn("level", F.lit(0)))
    every = scratch.saved(every.select("node", "block", (F.col("tree") * (levels + 1) + F.col("level")).alias("at"), "key", "under"))
    asked = every.groupBy("node").agg(F.collect_list(F.struct("at", "key", "under")).alias("k"))  # one entry per tree and depth
    asked = asked.select("k").mapInArrow(_depths(trees, depth, base, threshold, recall), "key long").distinct()
    groups = every.join(asked, "key").groupBy("key").agg(F.collect_set("block").alias("blocks")).select("blocks").distinct()
    two = groups.select(F.explode("blocks").alias("i"), "blocks").select("i", F.explode("blocks").alias("j")).where("i <= j").distinct()
    two = scratch.saved(two)
    sides = two.withColumn("block", F.col("i")).unionByName(two.where("i < j").withColumn("block", F.col("j")))
    coarse = sides.join(crowded, "block").select("i", "j", "node")
    return fine.unionByName(coarse).distinct(), placed.select("node", "block")


def labelled(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """rid, doc_id, class_node, class_id, n_links, n_texts of each row of ``docs``, a stored table with rid, doc_id and text."""
    spark = docs.sparkSession
    common.workers_import(spark)
    base = base_depth(trees, depth, threshold, recall)
    key = tb.Key()  # drawn for this run, so that no text can be written to collide
    rows = common.saved(docs.select("rid", "doc_id", "text").mapInArrow(_features(trees, depth, base, shingle, key), "rid long, doc_id long, k1 long, k2 long, size long, labels array<long>, deeper array<int>"))
    nodes = rows.where("size > 0").groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("labels", "deeper"), "rid").alias("s"))
    nodes = nodes.select("k1", "k2", "node", "doc_id", "copies", "s.labels", "s.deeper")
    nodes = common.saved(nodes)

    scratch = common.Scratch(spark)
    meet, placed = candidates(nodes, trees, depth, base, threshold, recall, crowd, block, scratch)
    meet = scratch.saved(meet)
    wanted = meet.select("node").distinct().join(nodes.select("node", "k1", "k2", "copies"), "node").join(placed, "node")
    # joins that carry texts or all labels are sort-merge joins at every size, so that a plan seen on little data holds on much
    wanted = scratch.saved(docs.select(F.col("rid").alias("node"), "text").join(wanted.hint("merge"), "node"))
    meet = meet.join(wanted.hint("merge"), "node").select("i", "j", "node", "k1", "k2", "copies", "block", "text")
    meet = meet.repartition("i", "j").sortWithinPartitions("i", "j", "node")
    found = common.saved(meet.mapInArrow(_verify(threshold, shingle, key), "node long, hub long, n_texts long, n_docs long"))
    scratch.release()  # texts and prefixes; the links are all that is still asked for

    classes = components(found.where("node <> hub"), "node", "hub")
    degree = found.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    told = nodes.select("k1", "k2", "node", "doc_id", "copies").join(classes, "node", "left").join(degree, "node", "left")
    told = told.select("k1", "k2", "node", "copies", F.coalesce("root", "node").alias("class_node"), "doc_id", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    least = told.groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
    told = told.drop("doc_id").join(least, "class_node")
    out = rows.where("size > 0").select("rid", F.col("doc_id").alias("own"), "k1", "k2").join(told, ["k1", "k2"])
    out = out.select("rid", F.col("own").alias("doc_id"), "class_node", "class_id", (F.col("n_docs") + F.col("copies") - 1).alias("n_links"), F.col("n_texts").cast("long").alias("n_texts"))
    none = rows.where("size = 0").select("rid", "doc_id", F.lit(None).cast("long").alias("class_node"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"))
    return out.unionByName(none)


def classes(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id, n_links, n_texts: one row per row of ``docs``."""
    d = common.saved(common.with_columns(docs, doc_id="long", text="string").withColumn("rid", F.monotonically_increasing_id()))
    return labelled(d, **parameters).select("doc_id", "class_id", "n_links", "n_texts")


def one_per_class(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id, of equal ones the first row.

    A class is a chain of links, so a row may go although it is less alike to
    the kept one than the threshold.  Texts without a shingle are kept.
    """
    d = common.saved(common.boxed(docs).withColumn("rid", F.monotonically_increasing_id()))  # each text once: the table lies on the disk until the stages after it are done
    told = labelled(d.select("rid", common.inside(d, "doc_id", "long").alias("doc_id"), common.inside(d, "text", "string").alias("text")), **parameters)
    best = told.where("class_node is not null").groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("b"))
    keep = best.select("b.rid").unionByName(told.where("class_node is null").select("rid"))
    return common.unboxed(d.join(keep, "rid", "left_semi"), docs.columns)
