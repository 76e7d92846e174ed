"""SimHash near-duplicates, found exactly with a forest of vantage-point trees.

A plain vantage-point tree over all 64-bit fingerprints cannot prune: the distances between
unrelated fingerprints lie around 32 with a deviation of 4, so at radius 4 about two thirds
of all points overlap every boundary. The first level of the forest therefore partitions by
*bands* of the bits. With 5 bands, two fingerprints that differ in at most 4 bits agree on one
whole band (with k bands, on some k - 4 of them), so all linked pairs meet in some shard of equal
bands. ``bands_for`` takes more bands as there are more fingerprints, so shards stay small.

Within a shard stands a vantage-point tree. A node takes, of a few sampled vantage points and all
distances from them, the boundary that leaves the fewest comparisons. Points up to the boundary
and ``RADIUS`` beyond it go to the inner side, points beyond the boundary to the outer one: a pair
of linked points on either side of a boundary lies, by the triangle inequality, within
``RADIUS`` of it, so its points meet on the inner side. The walk goes down until a leaf is small
or no boundary saves more comparisons than it costs to find, as among unrelated points. In a leaf points are sorted by their distance to a vantage point, and only
points whose rings are at most ``RADIUS`` apart are compared.

A shard with more than ``BLOCK`` fingerprints is cut into blocks, and every two blocks of it meet
in one task. Only links that join two groups are emitted (a spanning forest), never all pairs.

Defined results: a text without a word (also null) has fingerprint 0 and is linked like any
other; rows with one text share a fingerprint and collapse before the search; a null id
never is the smallest id unless its whole component has no other. Very long texts are hashed as a
whole; an empty table gives no rows; ``keep_one`` keeps all columns, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from quirework.operators.skew import salted_join

from .common import bounded_batches, meetings, staged, whole_groups
from .forest import Forest
from .graph import components

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of one leaf that are compared in one task.
BLOCK = 4096
#: Mean number of fingerprints in a shard from which on one more band is used.
LEAF = 1000
#: Points that a node of a tree is split from, vantage points that it tries, and comparisons for
#: each of its points that a split must save.
SPLIT, VANTAGES, SAVED = 128, 4, 24


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes; signed, as Spark's long."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    width = min(width, len(words))
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist(), strict=False)),
        dtype="<u8", count=len(words) - width + 1)
    totals = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 100_000 + 1):
        totals += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def bands_for(n: int, radius: int = RADIUS) -> int:
    """Bands so that a leaf holds ``LEAF`` fingerprints on average, if they spread evenly."""
    bands = radius + 1
    while bands < 2 * radius + 2 and n / 2 ** (BITS * (bands - radius) // bands) > LEAF:
        bands += 1
    return bands


def leaf_masks(bands: int, radius: int = RADIUS) -> list[int]:
    """For each tree the bits that all points of a leaf have in common."""
    cuts = [BITS * i // bands for i in range(bands + 1)]
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(bands)]
    signed = [sum(c) for c in combinations(masks, bands - radius)]
    assert len(signed) == comb(bands, radius)
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in signed]


def tree_leaves(fp: np.ndarray, radius: int = RADIUS) -> list[np.ndarray]:
    """Leaves of a vantage-point tree as places in ``fp``. Every two points within ``radius`` of each
    other are together in a leaf; a point near a boundary is in several."""
    leaves, nodes = [], [np.arange(len(fp))]
    while nodes:
        at = nodes.pop()
        best = None
        if len(at) > SPLIT:
            for v in at[np.linspace(0, len(at) - 1, VANTAGES).astype(int)]:
                distance = np.bitwise_count(fp[at] ^ fp[v]).astype(np.int64)
                up_to = np.bincount(distance, minlength=BITS + radius + 1).cumsum()
                cost = up_to[radius:] ** 2 + (len(at) - up_to[: len(up_to) - radius]) ** 2
                boundary = int(cost.argmin())
                if best is None or cost[boundary] < best[0]:
                    best = int(cost[boundary]), distance, boundary
        if best is None or len(at) ** 2 - best[0] < SAVED * len(at):
            leaves.append(at)
        else:
            _, distance, boundary = best
            nodes += [at[distance <= boundary + radius], at[distance > boundary]]
    return leaves


def search_leaves(shard: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links of many shards at once. ``shard`` numbers the groups in order; ``side`` is the block of
    a row. Rows of one block are compared with each other only where a shard holds one block,
    since another task does that for the shard's other pairs of blocks."""
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    sizes = np.diff(np.r_[first, len(shard)])
    number = np.repeat(np.arange(len(first)), sizes)
    crossing = (np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first))[number]
    # row: the places in the shards; leaf: the leaf that an entry is in
    whole = (sizes <= SPLIT)[number]
    rows, leaves = [np.flatnonzero(whole)], [number[whole]]
    n_leaves = len(first)
    for i in np.flatnonzero(sizes > SPLIT):
        for at in tree_leaves(fp[first[i]: first[i] + sizes[i]], radius):
            rows.append(at + first[i])
            leaves.append(np.full(len(at), n_leaves))
            n_leaves += 1
    row, leaf = np.concatenate(rows), np.concatenate(leaves)
    order = np.argsort(leaf, kind="stable")
    row, leaf = row[order], leaf[order]
    start = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    size = np.diff(np.r_[start, len(leaf)])
    ring = np.bitwise_count(fp[row] ^ np.repeat(fp[row[start]], size)).astype(np.int16)
    order = np.lexsort((ring, leaf))
    row, ring = row[order], ring[order]
    last = np.repeat(start + size, size)
    found = Forest(len(fp))
    at, lag = np.arange(len(row)), 1
    while len(at):
        at = at[at + lag < last[at]]
        at = at[ring[at + lag] - ring[at] <= radius]  # the triangle bound: later rows are farther still
        a, b = row[at], row[at + lag]
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (~crossing[a] | (side[a] != side[b]))
        if near.any():
            found.link(a[near], b[near])
        lag += 1
    if not found.links:
        return np.zeros((0, 2), dtype="<i8")
    pairs = np.array(found.links)
    return fp[pairs].view("<i8")


def links_between(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, bands: int | None = None) -> DataFrame:
    """(a, b) links that connect all distinct ``fp`` within ``radius`` as pairs would."""
    masks = leaf_masks(bands or bands_for(fps.count(), radius), radius)
    rows = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("tree", "mask"))
    rows = rows.select("fp", "tree", F.col("fp").bitwiseAND(F.col("mask")).alias("leaf"))
    crowded = rows.groupBy("tree", "leaf").agg(F.count("*").alias("n")).filter("n > 1")
    rows = meetings(rows, crowded, ["tree", "leaf"], "fp", block)
    keys = ["tree", "leaf", "low", "high"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, keys):
            columns = [group.column(k).to_numpy() for k in keys]
            changed = np.zeros(group.num_rows, dtype=np.int64)
            for c in columns:
                changed[1:] |= c[1:] != c[:-1]
            fp = group.column("fp").to_numpy().view("<u8")
            pairs = search_leaves(np.cumsum(changed), fp, group.column("side").to_numpy(), radius)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long").distinct()


def fingerprint_components(marked: DataFrame) -> DataFrame:
    """(fp, component_id, keeper) from rows (id, fp, row): the smallest id that can be reached from a
    fingerprint, and the row of the component that is to stay, the same for all of it."""
    best = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row"))  # null ids come last
    own = staged(marked.groupBy("fp").agg(best.alias("own")), "fingerprints")
    comp = components(links_between(own.select("fp")))
    with_root = own.join(comp, own.fp == comp.node, "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    smallest = with_root.groupBy("root").agg(F.min("own").alias("best"))
    return staged(salted_join(with_root.drop("own"), smallest, ["root"], ["fp"]).select(
        "fp", F.col("best.id").alias("component_id"), F.col("best.row").alias("keeper")), "components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row."""
    bounded_batches(docs)
    marked = staged(docs.select(F.col(key).alias("id"), fingerprints(F.col(text)).alias("fp")), "simhash")
    comp = fingerprint_components(marked.withColumn("row", F.lit(0))).select("fp", "component_id")
    return salted_join(marked, comp, ["fp"], ["id"]).select("id", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component (its smallest id), with all its columns. Fingerprints are made
    once; the rows that stay are found again by id and a hash of id and text."""
    bounded_batches(docs)
    row = F.xxhash64(key, text)
    marked = staged(docs.select(F.col(key).alias("id"), row.alias("row"), fingerprints(F.col(text)).alias("fp")), "simhash")
    keep = fingerprint_components(marked).select(F.col("component_id").alias("id"), F.col("keeper").alias("row")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), F.col(key).alias("_id"), row.alias("_row"))
    kept = packed.join(keep, (packed._row == keep.row) & packed._id.eqNullSafe(keep.id), "left_semi")
    # rows that repeat an id and a text: one of them
    return kept.groupBy("_row", "_id").agg(F.first("_d").alias("_d")).select("_d.*")
