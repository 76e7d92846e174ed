"""Interaction audit of filters with decision diagrams.

Every document fails some of a few filters; its failures are one bit mask. Per part (here the
language) the documents are counted by mask, and the counts form a decision diagram: one level
a filter, at each node a branch for documents that pass and one for those that fail, and the
counts at the ends. Equal nodes of a level are one node, and every node knows the weight of
all documents below it. An order of the filters is an order of the levels. The path on which
every filter passes gives the steps of that order: the fail branch beside the path is what the
filter removes there, the pass branch what it keeps. Two neighbouring levels are swapped in
place, and each of the orders differs from the one before by one such swap.

The corpus is read once: a row of a few bytes for each document is written to the shared
folder, and all that follows (copies, labels, counts) works on those rows. A part ends as at
most 2 ** filters counts, and only these form a group.

The five filters, on words ``[^\\x20\\x09-\\x0D]+``: A under 200 words; B different words under
half of all words; C capitals A-Z above 3 % of the code points; D any of ``#$%&*|``; E the same
text as a document with a smaller id, anywhere in the table.

Defined results: a null text is an empty one (it fails A, and E behind a smaller id with an
empty or null text); a null language is the part ''; a document without an id neither fails E
nor makes another fail it, nor has labels; rows with the same id and text don't make each other
fail; labels that repeat an id count if any of them is 1; an empty table has no parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import salted_join
from .common import bounded_batches, staged

FILTERS = "ABCDE"
MIN_WORDS, MIN_DIFFERENT, MAX_CAPITALS = 200, 50, 3

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
#: Bytes of a UTF-8 text that don't begin a code point.
FOLLOWING = bytes(range(0x80, 0xC0))


def own_failures(data: bytes) -> int:
    """Bits 0 to 3: which of A, B, C and D a text fails."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    points = len(data.translate(None, FOLLOWING))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DIFFERENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS * points) << 2
        | (len(data.translate(None, MARKS)) < len(data)) << 3
    )


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, good, toxic): a row for each document; bit i of ``mask`` is set if it
    fails filter i."""
    bounded_batches(docs)
    kind = dict(docs.dtypes)[key]
    source = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"),
                 pa.array([own_failures(x) for x in texts], pa.int32()),
                 pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary()),
                 pa.array(range(row, row + len(texts)), pa.int64())],
                names=["doc_id", "part", "mask", "digest", "row"])
            row += len(texts)

    rows = staged(source.mapInArrow(measure, f"doc_id {kind}, part string, mask int, digest binary, row long"), "audit")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    known = labels.groupBy(F.col("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic")).filter("doc_id IS NOT NULL")
    # merged, never broadcast: the planner sees a few MB of packed files, not the rows times salts that the driver would hold
    found = salted_join(rows, copies.drop("_n").hint("merge"), ["digest"], ["row"], "left")
    found = salted_join(found, known.hint("merge"), ["doc_id"], ["row"], "left")
    copied = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).cast("int")
    return found.select(
        "doc_id", "part", (F.col("mask") + F.shiftleft(copied, 4)).alias("mask"),
        F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"))


def counts(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures."""
    return rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"),
        F.sum(F.col("toxic").cast("long")).alias("toxic"))


def neighbours(n: int) -> list[int]:
    """Swaps of neighbouring places that lead through all orders of n things, each once: the
    last thing walks through every order of the others, to and fro."""
    if n < 2:
        return []
    left, right = list(range(n - 2, -1, -1)), list(range(n - 1))
    out = list(left)
    for i, k in enumerate(neighbours(n - 1)):
        at_front = i % 2 == 0
        out += [k + at_front, *(right if at_front else left)]
    return out


class Diagram:
    """Weighted decision diagram over masks; a weight is a tuple of counts.

    ``levels[i]`` has the nodes of level i as (pass, fail): places of nodes of the next level,
    in the last level places in ``ends``. ``weight[i]`` has the weights of these nodes.
    """

    def __init__(self, weights: dict[int, tuple[int, ...]], n: int):
        self.order = list(range(n))
        zero = tuple(0 for _ in next(iter(weights.values()), ()))
        self.ends, ids = unique([weights.get(m, zero) for m in range(1 << n)])
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.weight: list[list[tuple[int, ...]]] = [[] for _ in range(n)]
        # the last level splits by the last filter: masks are halved from the highest bit down
        for i in reversed(range(n)):
            half = len(ids) // 2
            self.levels[i], ids = unique([(ids[m], ids[m + half]) for m in range(half)])
            self.weight[i] = self.weights_of(i)

    def below(self, i: int) -> list[tuple[int, ...]]:
        return self.weight[i] if i < len(self.levels) else self.ends

    def weights_of(self, i: int) -> list[tuple[int, ...]]:
        under = self.below(i + 1)
        return [tuple(map(sum, zip(under[p], under[f], strict=True))) for p, f in self.levels[i]]

    def swap(self, i: int) -> None:
        """Exchange levels i and i + 1. Nodes above keep their places, nodes below are as before."""
        lower = self.levels[i + 1]
        parts = []
        for p, f in self.levels[i]:
            (pp, pf), (fp, ff) = lower[p], lower[f]
            parts += [(pp, fp), (pf, ff)]
        self.levels[i + 1], ids = unique(parts)
        self.levels[i] = list(zip(ids[::2], ids[1::2], strict=True))
        self.weight[i + 1] = self.weights_of(i + 1)
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Along the path on which every filter passes: (kept, removed) of each level."""
        at = 0
        for i, level in enumerate(self.levels):
            under = self.below(i + 1)
            at, out = level[at]
            yield under[at], under[out]


def unique(items: list) -> tuple[list, list[int]]:
    """The different items, and the place of each item among them."""
    places: dict = {}
    ids = [places.setdefault(x, len(places)) for x in items]
    return list(places), ids


def table(weights: dict[int, tuple[int, int, int]], names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique fails, good lost, toxic lost, shapley)."""
    n = len(names)
    diagram = Diagram(weights, n)
    found = []
    for swap in [None, *neighbours(n)]:
        if swap is not None:
            diagram.swap(swap)
        found.append((tuple(diagram.order), list(diagram.steps())))
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for order, steps in found:
        for f, (_, removed) in zip(order, steps, strict=True):
            shapley[f] += removed[0]
        fails[order[0]] = steps[0][1][0]
        alone[order[-1]] = steps[-1][1][0]
    return [
        ("".join(names[f] for f in order), step, kept[0], removed[0], fails[f] - removed[0], alone[f],
         removed[1], removed[2], shapley[f])
        for order, steps in found
        for step, (f, (kept, removed)) in enumerate(zip(order, steps, strict=True), 1)]


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(counted: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """Steps of every order of the filters in each part, from the ``counts``.

    A group is one part: at most 2 ** len(names) rows.
    """
    names = "".join(names)

    def audit(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        weights = dict(zip(rows["mask"], zip(rows["n"], rows["good"], rows["toxic"], strict=True), strict=True))
        columns = list(zip(*table(weights, names), strict=True))
        part = pa.array([rows["part"][0]] * len(columns[0]), pa.string())
        return pa.Table.from_arrays(
            [part, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()),
             *[pa.array(c, pa.int64()) for c in columns[2:]]],
            names=["part", "filter_order", "step", *COLUMNS])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)
    return counted.groupBy("part").applyInArrow(audit, schema)
