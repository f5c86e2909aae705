"""Mixing sources to target weights by Pfair scheduling.

Method.  Each source's documents form blocks of ``BLOCK_DOCS``.  With integer
weights a_s and Q their sum, block k of source s is released at slot
``floor(k Q / a_s)`` and due at ``ceil((k + 1) Q / a_s)``; one block runs per
slot and the earliest deadline goes first.  The weights fill the slots exactly,
so every block runs inside its window and no source is ever a whole block away
from its share.  The schedule repeats after Q slots, so one period is laid out
(whatever the number of documents) and a block's slot follows by arithmetic.
When a source has no block left, the others share its weight in proportion and
a new period is laid out; there are at most as many such phases as sources.

Target weights are read as exact decimals and brought to integers without
rounding.  Weights so fine that a period would have more than ``MOST_SLOTS``
slots are refused with an error that says so, never rounded.  Without given weights a source's target is
its size to the power ``TEMPER``, in whole shares out of ``SHARES``.  The driver
holds one size per source and the periods of the phases (sources x period
numbers at most); it is made for sources in the hundreds.

Documents are numbered inside their source without gathering a source in a
task (``common.ranked``), in an order seeded by their doc_id's hash.  Nothing is
dropped or repeated: a source with much more than its share forms the tail.

Defined cases: a null source is a source of its own; null and repeated doc_ids
keep their rows; a source missing from given weights gets weight 1; an empty
table gives no rows; extra columns are ignored by ``schedule`` and kept by
``mixed``.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_DOCS = 16
SHARES = 1000
#: The longest period that is laid out for given weights.
MOST_SLOTS = 100_000
#: Exponent that turns a source's size into its default weight.
TEMPER = 0.5
#: So many entries of the plan (8 bytes each) are broadcast at most; a larger plan is joined by a shuffle.
BROADCAST_ENTRIES = 1_000_000

Plan = tuple[str, int, int, int, int, int, int, list[int]]


def shares(sizes: dict[str, int], weights: dict[str, float] | None = None, most: int = MOST_SLOTS) -> dict[str, int]:
    """Integer weights in exactly the proportions wanted; without ``weights``, the tempered sizes in whole shares."""
    if weights:
        want = {s: Fraction(str(weights.get(s, 1))) for s in sizes}
        if any(w <= 0 for w in want.values()):
            raise ValueError("target weights must be positive")
        scale = math.lcm(*[w.denominator for w in want.values()])
        whole = {s: int(w * scale) for s, w in want.items()}
        common_ = math.gcd(*whole.values())
        whole = {s: w // common_ for s, w in whole.items()}
        if sum(whole.values()) > most:
            raise ValueError(f"these weights need a period of {sum(whole.values())} slots, more than {most}; give coarser ones")
        return whole
    tempered = {s: n**TEMPER for s, n in sizes.items()}
    scale = SHARES / sum(tempered.values()) if tempered else 0
    return {s: max(1, round(w * scale)) for s, w in tempered.items()}


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(weights) slots."""
    q = sum(weights.values())
    names = sorted(weights)
    release = [(0, i, 0) for i in range(len(names))]
    heapq.heapify(release)
    ready: list[tuple[int, int, int]] = []
    out: dict[str, list[int]] = {s: [] for s in names}
    for slot in range(q):
        while release and release[0][0] <= slot:
            _, i, k = heapq.heappop(release)
            heapq.heappush(ready, (-(-(k + 1) * q // weights[names[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        out[names[i]].append(slot)
        if k + 1 < weights[names[i]]:
            heapq.heappush(release, ((k + 1) * q // weights[names[i]], i, k + 1))
    return out


def plan(blocks: dict[str, int], weights: dict[str, int]) -> list[Plan]:
    """(source, phase, first block, end block, first slot, period, weight, slots) of each source and phase."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    out: list[Plan] = []
    slot0 = phase = 0
    while left:
        w = {s: weights[s] for s in left}
        q = sum(w.values())
        slots = period(w)
        end = min((n - 1) // w[s] * q + slots[s][(n - 1) % w[s]] + 1 for s, n in left.items())
        for s in sorted(left):
            ran = end // q * w[s] + sum(x < end % q for x in slots[s])
            out.append((s, phase, done[s], done[s] + ran, slot0, q, w[s], slots[s][:ran]))
            done[s] += ran
            left[s] -= ran
        left = {s: n for s, n in left.items() if n}
        slot0 += end
        phase += 1
    return out


def _placed(docs: DataFrame, weights: dict[str, float] | None, block_docs: int) -> DataFrame:
    spark = docs.sparkSession
    d = docs.withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("?")))
    sizes = {r["_src"]: r["n"] for r in d.groupBy("_src").agg(F.count(F.lit(1)).alias("n")).collect()}
    named = {f"={s}" if s is not None else "?": w for s, w in weights.items()} if weights else None
    rows = plan({s: -(-n // block_docs) for s, n in sizes.items()}, shares(sizes, named))
    kind = "_src string, _phase int, _k0 long, _k1 long, _slot0 long, _q long, _w long, _slots array<int>"
    p = spark.createDataFrame(rows, kind) if rows else spark.createDataFrame([], kind)
    if sum(len(r[7]) for r in rows) <= BROADCAST_ENTRIES:
        p = F.broadcast(p)
    d = common.ranked(d, "_src", ["doc_id"], "_rank").withColumn("_block", F.floor(F.col("_rank") / block_docs))
    d = d.join(p, ["_src"]).where((F.col("_block") >= F.col("_k0")) & (F.col("_block") < F.col("_k1")))
    j = F.col("_block") - F.col("_k0")
    slot = F.col("_slot0") + F.floor(j / F.col("_w")) * F.col("_q") + F.get("_slots", F.pmod(j, F.col("_w")).cast("int"))
    return d.withColumn("_slot", slot.cast("long")).withColumn("_place", F.pmod("_rank", F.lit(block_docs)).cast("long"))


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, phase, block, slot, place and position (increasing, unique) of each row.

    ``weights`` by source (None as a key for the null source); without them a
    source weighs its size to the power ``TEMPER``.
    """
    d = _placed(common.with_columns(docs, doc_id="long", source="string"), weights, block_docs)
    return d.select("doc_id", "source", F.col("_phase").alias("phase"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"), (F.col("_slot") * block_docs + F.col("_place")).alias("position"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` in mixed order, its columns unchanged."""
    d = _placed(common.boxed(docs, doc_id="long", source="string"), weights, block_docs).withColumn("_position", F.col("_slot") * block_docs + F.col("_place"))
    d = d.repartitionByRange("_position").sortWithinPartitions("_position")
    return common.unboxed(d, docs.columns)
