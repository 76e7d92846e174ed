"""Mixing sources to target weights by Pfair scheduling.

The texts of a source are cut into blocks of about ``block_chars`` characters (whole
documents; a document belongs to the block in which it begins). A source with weight w
releases its k-th block (from 0) at slot floor(k / w), and the block is due by
ceil((k + 1) / w). In every slot, of the blocks already released, the one with the earliest
deadline comes next. At every slot each source has then had its share of the slots so far
to within one block.

Weights are whole numbers that add up to a period. The period grows with the square of the
slots of the run, so rounding adds less than 0.05 blocks to the deviation from the exact
targets, and less the longer the run is.

The run is cut into pieces that are spelled out in parallel, and they are exactly the pieces of
the one schedule. All that a piece needs to know of the slots before it is which sources still
have a released block waiting, one bit a source. Earliest deadline first serves a basis of a
matroid: the best sets of blocks that the slots can take, in the order of deadlines. So a piece is
first tried without any waiting block. The blocks that were waiting may stand in any of its
slots, and with them the piece serves as many of both as it has slots, earliest deadlines
first; the others wait on. From the tries, one bit a source and piece, the driver finds the
waiting blocks of every piece in turn, and then all pieces are spelled out.

Each slice of a source joins the slots of its blocks, at most ``CHUNK`` epochs at a time.

A source that is used up before the others starts over (``epoch`` 1, 2, ...), until the
source with the most periods has given all its blocks. So the shares hold to the end and no
document is left out.

Defined results: documents without a source form a source of their own; null and empty
texts take no room and stay; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import islice
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import code_points, staged

BLOCK_CHARS = 20_000
#: Slots of a period, at least.
PERIOD = 1000
#: Documents of one slice when positions within a source are counted.
SLICE = 2_000
#: Sources at most: their totals and weights are held by the driver and the scheduling task.
MAX_SOURCES = 100_000
#: Slots of a piece, at least, and at least for each source: what the pieces tell the driver is
#: less than a bit for every 64 slots of the run.
PIECE, PIECE_PER_SOURCE = 20_000, 64
#: Epochs of a block in one cell; a source with more of them is dealt to several groups.
CHUNK = 64
#: Without given weights: shares in proportion to characters to this power.
TEMPER = 0.7


def period_of(weights: Mapping, slots: int = PERIOD) -> dict:
    """Slots per period for each source, one at least, by largest remainder."""
    slots = max(slots, 4 * len(weights))
    total = sum(map(Fraction, weights.values())) or 1
    exact = {s: Fraction(w) / total * slots for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] % 1), str(s)))
    k = 0
    while sum(out.values()) < slots and order:
        out[order[k % len(order)]] += 1
        k += 1
    return out


def shares_for(weights: Mapping, n_blocks: Mapping, slots: int = PERIOD) -> dict:
    """``period_of`` with a period that suits the run in which each source gives its blocks.

    A share is off by less than one slot a period, which in a run of L slots makes L / period
    blocks. A source with a block to give has more than a slot of such a period.
    """
    total = sum(map(Fraction, weights.values()))
    run = max((ceil(n * total / Fraction(weights[s])) for s, n in n_blocks.items()), default=0)
    return period_of(weights, slots * max(1, run * run // slots))


def turns(slots: Mapping) -> Iterator[tuple[object, int, int]]:
    """Slot by slot without end, earliest deadline first: (source, block, slot). Of equal
    deadlines the source that comes first by name is served."""
    period = sum(slots.values())
    waiting = [(0, i) for i in range(len(slots))]
    names, given = sorted(slots, key=lambda s: (s is None, str(s))), [0] * len(slots)
    ready: list[tuple[int, int]] = []
    t = 0
    while names:
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            p = slots[names[i]]
            heapq.heappush(ready, (-(-(given[i] + 1) * period // p), i))
        deadline, i = heapq.heappop(ready)
        assert deadline > t
        yield names[i], given[i], t
        given[i] += 1
        heapq.heappush(waiting, (given[i] * period // slots[names[i]], i))
        t += 1


def schedule(slots: Mapping) -> list[tuple[object, int, int]]:
    """One period of ``turns``."""
    return list(islice(turns(slots), sum(slots.values())))


def run_of(shares: Mapping, n_blocks: Mapping) -> Iterator[tuple[object, int, int]]:
    """``turns`` until every source has given all its blocks once."""
    left = sum(n > 0 for n in n_blocks.values())
    for s, k, t in turns(shares) if left else ():
        yield s, k, t
        left -= k + 1 == n_blocks[s]
        if not left:
            return


class Piece:
    """Slots ``first`` to ``last`` - 1 of the schedule of sources with ``shares`` (in their order)
    of ``period`` slots. ``waiting`` has the sources with a block released before and not served."""

    def __init__(self, shares: Sequence[int], period: int, first: int, last: int, waiting: Iterable[int] = ()):
        self.shares, self.period, self.first, self.last = shares, period, first, last
        self.waiting = set(waiting)
        self.idle = 0
        #: Sources with a block that was released before ``last`` and isn't served, after ``turns``.
        self.left: set[int] = set()

    def released(self, i: int, slot: int) -> int:
        """Blocks of a source that are released before a slot."""
        return -(-slot * self.shares[i] // self.period)

    def deadline(self, i: int, block: int) -> int:
        return -(-(block + 1) * self.period // self.shares[i])

    def turns(self) -> Iterator[tuple[int, int, int]]:
        """(source, block, slot), earliest deadline first; of equal ones the first source."""
        period, shares, last = self.period, self.shares, self.last
        block = [self.released(i, self.first) - (i in self.waiting) for i in range(len(shares))]
        ready = [(self.deadline(i, block[i]), i) for i in self.waiting]
        later = [(block[i] * period // shares[i], i) for i in range(len(shares)) if i not in self.waiting]
        heapq.heapify(ready)
        heapq.heapify(later)
        t = self.first
        while t < last:
            while later and later[0][0] <= t:
                _, i = heapq.heappop(later)
                heapq.heappush(ready, (-(-(block[i] + 1) * period // shares[i]), i))
            if not ready:
                until = min(later[0][0], last) if later else last
                self.idle += until - t
                t = until
                continue
            _, i = heapq.heappop(ready)
            yield i, block[i], t
            block[i] += 1
            heapq.heappush(later, (block[i] * period // shares[i], i))
            t += 1
        self.left = {i for i in range(len(shares)) if block[i] < self.released(i, last)}

    def wait_on(self, idle: int, left: set[int]) -> set[int]:
        """Sources with a waiting block at ``last``, when a try without waiting blocks had ``idle``
        slots and ``left`` over."""
        surplus = len(self.waiting) - idle
        over = []
        for i in range(len(self.shares)) if surplus > 0 else ():
            block = self.released(i, self.last) - 1
            deadline = self.deadline(i, block)
            # may wait: released before, due later, and served by the try or waiting from before
            if i not in left and deadline > self.last and (block >= self.released(i, self.first) or i in self.waiting):
                over.append((deadline, i))
        return left | {i for _, i in heapq.nlargest(max(surplus, 0), over)}


def pieces_of(shares: Sequence[int], period: int, end: int, length: int) -> list[tuple[int, int]]:
    return [(t, min(t + length, end)) for t in range(0, end, length)]


def spelled(spark: SparkSession, shares: Sequence[int], end: int, length: int) -> DataFrame:
    """(_i, _k, _slot): the schedule of the slots before ``end``, in pieces of ``length`` slots."""
    period = sum(shares)
    bounds = pieces_of(shares, period, end, length)

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for j in batch["j"]:
                piece = Piece(shares, period, *bounds[j])
                for _ in piece.turns():
                    pass
                yield pd.DataFrame({"j": [j], "idle": [piece.idle], "left": [bits(piece.left, len(shares))]})

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for j, waiting in zip(batch["j"], batch["waiting"], strict=True):
                turns_ = Piece(shares, period, *bounds[j], ones(waiting)).turns()
                while rows := list(islice(turns_, 50_000)):
                    yield pd.DataFrame(rows, columns=["_i", "_k", "_slot"])

    waiting: set[int] = set()
    rows = []
    if len(bounds) > 1:
        every = spark.range(0, len(bounds) - 1, 1, len(bounds) - 1).withColumnRenamed("id", "j")
        found = {r.j: r for r in every.mapInPandas(tried, "j long, idle long, left binary").collect()}
    for j, (first, last) in enumerate(bounds):
        rows.append((j, bits(waiting, len(shares))))
        if j + 1 < len(bounds):
            waiting = Piece(shares, period, first, last, waiting).wait_on(found[j].idle, set(ones(found[j].left)))
    # a bit a source and piece
    pieces = spark.createDataFrame(rows, "j long, waiting binary").repartition(len(bounds), "j")
    return pieces.mapInPandas(spell, "_i int, _k long, _slot long")


def bits(places: Iterable[int], n: int) -> bytes:
    out = np.zeros(n, dtype=bool)
    out[list(places)] = True
    return np.packbits(out).tobytes()


def ones(packed: bytes) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8))).tolist()


def blocks_of(docs: DataFrame, source: str, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with ``_d``, ``_k``, ``_slice``; slices with ``_start``, ``_sum``; totals by source).

    The position of a document within its source is a running sum. A source is cut into
    slices by a hash of the id, so a source with a third of all rows is summed in many tasks.
    ``_g`` is the source in a struct: such keys are equal where both are null.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), F.struct(F.col(source).alias("s")).alias("_g"),
        F.col(key).alias("_k"), code_points(F.col(text)).alias("_size"), F.xxhash64(key, text).alias("_h"))
    slices = max(1, docs.count() // SLICE)
    packed = packed.withColumn("_slice", F.pmod("_h", F.lit(slices)))
    sums = staged(packed.groupBy("_g", "_slice").agg(F.sum("_size").alias("_sum")), "mix-slices")
    before = Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    return packed, starts, sums.groupBy("_g").agg(F.sum("_sum").alias("_chars"))


def mix(docs: DataFrame, weights: Mapping | None = None, source: str = "source", key: str = "doc_id",
        text: str = "text", block_chars: int = BLOCK_CHARS, slots: int = PERIOD, temper: float = TEMPER) -> DataFrame:
    """(``_d``, ``_s``, ``_block``, ``_epoch``, ``_slot``): documents at their slots.

    ``weights`` has the target of every source (any scale, above 0); without it, the characters
    of a source to the power ``temper``. A source that ``weights`` doesn't name is an error, and
    so are more than ``MAX_SOURCES`` sources.
    """
    packed, starts, totals = blocks_of(docs, source, key, text)
    sizes = {r["_g"]["s"]: r["_chars"] for r in totals.limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    if weights is not None and (unknown := set(sizes) - set(weights)):
        raise ValueError(f"no target weight for {sorted(map(str, unknown))[:5]}")
    targets = {s: max(1.0, float(n)) ** temper if weights is None else weights[s] for s, n in sizes.items()}
    if any(w <= 0 for w in targets.values()):
        raise ValueError("target weights must be above 0")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[source]
    # blocks by source; a document may begin where the last block ends, hence one more
    n_blocks = {s: n // block_chars + 1 for s, n in sizes.items()}
    shares = shares_for(targets, n_blocks, slots)
    order = sorted(shares, key=lambda s: (s is None, str(s)))
    schema = f"_g struct<s: {kind}>, _i int, _n long, _chunks int"
    if not order:
        names = spark.createDataFrame([], schema)
        run = spark.createDataFrame([], "_i int, _k long, _slot long")
    else:
        period = sum(shares.values())
        # the source that takes longest has its last block by then
        end = max(-(-n_blocks[s] * period // shares[s]) for s in order)
        epochs = {s: -(-end * shares[s] // period) // n_blocks[s] + 1 for s in order}
        names = spark.createDataFrame([((s,), i, n_blocks[s], -(-epochs[s] // CHUNK)) for i, s in enumerate(order)], schema)
        run = staged(spelled(spark, [shares[s] for s in order], end, max(PIECE, PIECE_PER_SOURCE * len(order))), "mix-run")
    numbered = run.join(names.select("_i", "_n"), "_i").select(
        "_i", (F.col("_k") % F.col("_n")).alias("_b"), F.floor(F.col("_k") / F.col("_n")).alias("_epoch"), "_slot", "_k", "_n")
    over = numbered.filter(F.col("_k") == F.col("_n") - 1).agg(F.max("_slot")).first()[0]
    turns_ = numbered.filter(F.col("_slot") <= F.lit(-1 if over is None else over)).withColumn(
        "_chunk", F.floor(F.col("_epoch") / CHUNK).cast("int"))
    runs = turns_.groupBy("_i", "_b", "_chunk").agg(F.collect_list(F.struct("_epoch", "_slot")).alias("_runs"))
    first, last = (F.floor(x / F.lit(block_chars)).cast("long") for x in (F.col("_start"), F.col("_start") + F.col("_sum")))
    cover = starts.join(names, "_g").select("_g", "_slice", "_start", "_i", F.explode(F.sequence(first, last)).alias("_b"))
    plan = cover.join(runs, ["_i", "_b"]).groupBy("_g", "_slice", "_chunk", "_start").agg(
        F.array_sort(F.collect_list(F.struct("_b", "_runs"))).alias("_at"))
    # sources that come round very often, at most MAX_SOURCES of them; their rows are copied before they
    # are dealt out, so that no group holds all of their turns
    often = F.broadcast(names.filter("_chunks > 1").select("_g", "_chunks"))
    copies = packed.join(often, "_g", "left").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
    within = Window.partitionBy("_g", "_slice", "_chunk").orderBy("_k", "_h").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    rows = placed.join(plan, ["_g", "_slice", "_chunk"]).withColumn(
        "_block", F.floor((F.col("_start") + F.col("_before")) / F.lit(block_chars)).cast("long"))
    own = F.get("_at", (F.col("_block") - F.col("_at")[0]["_b"]).cast("int"))["_runs"]
    again = rows.select("_d", F.col("_g.s").alias("_s"), "_k", "_block", F.explode(own).alias("_r"))
    return again.select("_d", "_s", "_k", "_block", "_r._epoch", "_r._slot")
