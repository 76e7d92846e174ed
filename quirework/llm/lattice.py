"""Embedding near-duplicates by E8 lattice hashing.

A vector of unit length is projected to eight dimensions by a random matrix and decoded to
the nearest point of the E8 lattice, once for each of several tables. Near vectors fall on
the same or a neighbouring point, so each vector is entered at its own point and at the
neighbours it lies closest to. Vectors that meet at a point are compared by cosine in double
precision; nothing below the threshold is ever linked.

Equal vectors of one label collapse to one row before the search, and count as many times as
they occur. A pair may meet at several points; it is counted at the first of them in the order
of tables and points, which both vectors know from their own keys. So a meeting returns
sums and a spanning forest of its links, never the pairs. A crowded point is cut into blocks
that meet two by two.

Defined results: a null label, and a vector that is null, empty, zero or holds a null or a
non-finite component, links with nothing; vectors of different lengths do not link; rows may
repeat an id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirework.operators.skew import salted_join

from .common import meetings, staged, whole_groups
from .forest import Forest
from .graph import components

THRESHOLD = 0.98
TABLES = 4
PROBES = 2
SCALE = 1.1
SEED = 8
#: Vectors of one lattice point that are compared in one task.
BLOCK = 2048


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    for signs in product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: whole numbers with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 together with D8 moved by one half."""
    one, two = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - one) ** 2).sum(1) <= ((x - two) ** 2).sum(1)
    return np.where(closer[:, None], one, two)


def projections(dim: int, tables: int, scale: float, seed: int) -> np.ndarray:
    """(tables, dim, 8), the same everywhere."""
    return np.random.default_rng([seed, dim]).normal(scale=scale, size=(tables, dim, 8))


def point_keys(points: np.ndarray) -> np.ndarray:
    """A 64-bit key of lattice points (..., 8)."""
    odd = np.random.default_rng(SEED).integers(1, 2**63, size=8, dtype=np.uint64) | np.uint64(1)
    mixed = (np.rint(points * 2).astype(np.int64).view(np.uint64) * odd).sum(-1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def lattice_keys(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
                 seed: int = SEED) -> np.ndarray:
    """(n, tables, 1 + probes) keys of the own point and the closest neighbours."""
    short = minimal_vectors()
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.int64)
    for t, matrix in enumerate(projections(unit.shape[1], tables, scale, seed)):
        for a in range(0, len(unit), 8192):
            x = unit[a: a + 8192] @ matrix
            own = nearest_point(x)
            lean = (x - own) @ short.T  # the larger, the closer the neighbour
            best = np.argsort(-lean, axis=1, kind="stable")[:, :probes]
            points = np.concatenate([own[:, None], own[:, None] + short[best]], axis=1)
            out[a: a + 8192, t] = point_keys(points)
    return out


def unit_rows(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    v = flat.reshape(len(column), -1)
    v = v / np.abs(v).max(1, keepdims=True)  # very large or small components neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def count_links(unit: np.ndarray, keys: np.ndarray, times: np.ndarray, table: int, key: int, side: np.ndarray,
                threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of the vectors that meet at one point: for each how many others it is linked to
    (each counted as often as it occurs), and links that connect what is linked. Pairs that
    meet earlier are left to that meeting; pairs within a block too, where two blocks meet."""
    sums, forest = np.zeros(len(unit), dtype=np.int64), Forest(len(unit))
    two = side.min() != side.max()
    for a in range(0, len(unit), 512):
        near = unit[a: a + 512] @ unit[a:].T >= threshold
        i, j = np.nonzero(near)
        pick = i < j
        i, j = i[pick] + a, j[pick] + a
        if two:
            other = side[i] != side[j]
            i, j = i[other], j[other]
        for t in range(table):
            if not len(i):
                break
            met = (keys[i, t][:, :, None] == keys[j, t][:, None, :]).any((1, 2))
            i, j = i[~met], j[~met]
        if len(i):
            mine, theirs = keys[i, table], keys[j, table]
            shared = (mine[:, :, None] == theirs[:, None, :]).any(2)
            first = np.where(shared, mine, np.iinfo(np.int64).max).min(1) == key
            i, j = i[first], j[first]
            np.add.at(sums, i, times[j])
            np.add.at(sums, j, times[i])
            forest.link(i, j)
    return sums, forest.links


def search(reps: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES,
           scale: float = SCALE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(a, b, links) from rows (uid, label, dim, embedding, times): ``links`` to add to ``a``
    where b is null, else a link of the spanning forest."""
    entry = reps.select("uid", "label", "dim", "embedding")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                keys = lattice_keys(unit_rows(part.column("embedding")), tables, probes, scale, seed)
                n, each = len(keys), tables * (1 + probes)
                yield pa.RecordBatch.from_pydict({
                    "uid": np.repeat(part.column("uid").to_numpy(), each),
                    "label": np.repeat(part.column("label").to_numpy(), each),
                    "dim": np.full(n * each, dim, dtype=np.int32),
                    "place": np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n),
                    "point": keys.reshape(-1)})

    places = entry.mapInArrow(enter, "uid long, label long, dim int, place int, point long")
    keys = ["label", "dim", "place", "point"]
    # points with one vector need no task
    crowded = places.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    met = meetings(places, crowded, keys, "uid", block)
    rows = met.join(reps.select("uid", "embedding", "times"), "uid")
    order = [*keys, "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, order):
            uid, times, side = (group.column(c).to_numpy() for c in ("uid", "times", "side"))
            columns = np.array([group.column(c).to_numpy() for c in order], dtype=np.int64)
            ends = np.r_[np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1, group.num_rows]
            unit: dict[int, tuple] = {}  # by first row: the vectors of one length and their keys
            dims = np.r_[0, np.flatnonzero(columns[1, 1:] != columns[1, :-1]) + 1, group.num_rows]
            for x, y in zip(dims[:-1].tolist(), dims[1:].tolist(), strict=True):
                v = unit_rows(group.column("embedding").slice(x, y - x).combine_chunks())
                unit[x] = v, lattice_keys(v, tables, probes, scale, seed)
            at, base, out = 0, 0, []
            for end in ends.tolist():
                base = at if at in unit else base
                v, own = (part[at - base: end - base] for part in unit[base])
                sums, links = count_links(v, own, times[at:end], int(columns[2, at]), int(columns[3, at]),
                                          side[at:end], threshold)
                ids = uid[at:end]
                out += [(int(ids[i]), None, int(sums[i])) for i in np.flatnonzero(sums)]
                out += [(int(ids[i]), int(ids[j]), 0) for i, j in links]
                at = end
            if out:
                a, b, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long, links long")


def near_classes(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    whole = dict(vectors.dtypes)[label] in ("tinyint", "smallint", "int", "bigint")
    # labels of other types are told apart by a hash
    marked = F.col(label).cast("long") if whole else F.when(F.col(label).isNotNull(), F.xxhash64(label))
    rows = vectors.select(F.col(key).alias("id"), marked.alias("label"), F.col(embedding).alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = (F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine)
             & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    # one class for equal vectors of a label; the digest stands for the vector from here on
    d = F.col("embedding")
    same = {"h1": F.xxhash64(d), "h2": F.xxhash64(F.lit(1), d), "dim": F.size(d)}
    good = rows.filter("valid").withColumns(same)
    classes = good.groupBy("label", "h1", "h2", "dim").agg(
        F.count("*").alias("times"), F.min("id").alias("id"), F.first("embedding").alias("embedding"))
    classes = staged(classes.withColumn("uid", F.monotonically_increasing_id()), "vector-classes")
    found = staged(search(classes.select("uid", "label", "dim", "embedding", "times"), threshold, **options), "vector-links")
    comp = components(found.filter("b IS NOT NULL").select("a", "b"))
    sums = found.groupBy("a").agg(F.sum("links").alias("links"))
    whole = (classes.select("label", "h1", "h2", "dim", "times", "id", "uid")
             .join(sums, F.col("uid") == F.col("a"), "left").join(comp, F.col("uid") == F.col("node"), "left")
             .withColumn("root", F.coalesce("root", "uid")))
    smallest = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    whole = whole.join(smallest, "root").select(
        "label", "h1", "h2", "dim", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    names = ["label", "h1", "h2", "dim"]
    linked = salted_join(good.select("id", *names), whole, names, ["id"]).select("id", "n_links", "component_id")
    alone = rows.filter("NOT valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
