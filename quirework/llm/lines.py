"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

State. ``reference_counts`` holds, for every line key, in how many documents it occurs. The
key is kept as a 128-bit digest (h1, h2). The counts are sums, so documents can be added
and removed at any time (``change_counts``). Keys in ``min_docs`` documents or more are
duplicates; each shard (by h1) has a cuckoo filter of its duplicate keys, and the exact
keys behind it. When counts change, ``change_shards`` inserts the keys that have become
duplicates and deletes those that no longer are. A filter that would be more than ``LOAD`` full
grows: it is built again, with more buckets, from the exact keys behind it.

Use. The keys of all documents are dealt to the shards; the filter answers "no" for nearly
all of them, and the exact keys confirm the rest. Copies of a shard go to as many salts as
keep a group at about ``GROUP_ROWS`` occurrences, so a line that a third of all documents
share is probed in many tasks, and few duplicate keys do not mean few tasks.

Defined results: a null text is one empty line; a line of white space alone is never a
duplicate; each row is a document of its own, also with a null or repeated id; an empty table
gives an empty result; other columns of a document are kept in ``_d``, whatever they are called.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import SPACE_BYTES, bounded_batches, longs, staged

MIN_DOCS = 10
#: Occurrences that are probed together, about.
GROUP_ROWS = 50_000
#: Salts at least, so that a single hot line is spread even where there are few rows.
SALTS = 16
#: Duplicate keys that one shard should hold, about.
SHARD_KEYS = 50_000
SLOTS = 4
MAX_KICKS = 500
#: Share of a filter's slots that may be taken.
LOAD = 0.85


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()  # bytes.lower() knows A-Z only


def digests(keys: list[bytes]) -> np.ndarray:
    """(n, 2) signed 64-bit halves of each key's 128-bit digest."""
    raw = b"".join([xxhash.xxh3_128_digest(k) for k in keys])
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


# ---------------------------------------------------------------- cuckoo filter

class CuckooFilter:
    """16-bit fingerprints in buckets of four; two buckets for each key.

    Keys that find no place go to a stash, so membership has no false negatives whatever
    the keys are. ``delete`` takes away one copy of a key that was inserted before.
    """

    def __init__(self, buckets: np.ndarray, stash: set[tuple[int, int]]):
        self.buckets, self.stash = buckets, stash

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        n = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((n, SLOTS), dtype="<u2"), set())

    def has_room(self, keys: int) -> bool:
        return keys <= LOAD * self.buckets.size

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of (n, 2) digests."""
        top = np.uint64(len(self.buckets) - 1)
        u = h.astype("<i8").view("<u8")
        mark = ((u[:, 1] >> np.uint64(48)) | np.uint64(1)).astype("<u2")
        first = (u[:, 1] & top).astype(np.int64)
        return mark, first, first ^ self.jump(mark)

    def jump(self, mark: np.ndarray) -> np.ndarray:
        """What leads from one bucket of a fingerprint to the other."""
        mixed = mark.astype("<u8") * np.uint64(0x5BD1E995) >> np.uint64(7)
        return (mixed & np.uint64(len(self.buckets) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(h)
        found = (self.buckets[one] == mark[:, None]).any(1) | (self.buckets[two] == mark[:, None]).any(1)
        if self.stash:
            found |= np.fromiter(((int(a), int(b)) in self.stash for a, b in h), bool, len(h))
        return found

    def insert(self, h: np.ndarray) -> None:
        """Keys go to free slots in rounds, one key a bucket in each; what finds none kicks others out."""
        mark, *buckets = self.places(h)
        left = np.arange(len(h))
        for at in buckets:
            for _ in range(SLOTS):
                free = self.buckets[at[left]] == 0
                able = np.flatnonzero(free.any(1))
                if not len(able):
                    break
                _, first = np.unique(at[left[able]], return_index=True)
                chosen = able[first]
                self.buckets[at[left[chosen]], free[chosen].argmax(1)] = mark[left[chosen]]
                left = np.delete(left, chosen)
        rng = np.random.default_rng(len(h))
        for i in left:
            self.kick(h[i], mark[i], buckets[0][i], rng)

    def kick(self, key: np.ndarray, mark: int, at: int, rng: np.random.Generator) -> None:
        path = []
        for slot in rng.integers(SLOTS, size=MAX_KICKS):
            path.append((at, slot, self.buckets[at, slot]))
            mark, self.buckets[at, slot] = self.buckets[at, slot], mark
            at ^= int(self.jump(np.array([mark], dtype="<u2"))[0])
            free = np.flatnonzero(self.buckets[at] == 0)
            if len(free):
                self.buckets[at, free[0]] = mark
                return
        for where, slot, old in reversed(path):  # no place: leave all as it was
            self.buckets[where, slot] = old
        self.stash.add((int(key[0]), int(key[1])))

    def delete(self, h: np.ndarray) -> None:
        for key, mark, one, two in zip(h, *self.places(h), strict=True):
            exact = (int(key[0]), int(key[1]))
            if exact in self.stash:
                self.stash.remove(exact)
                continue
            for at in (one, two):
                slot = np.flatnonzero(self.buckets[at] == mark)
                if len(slot):
                    self.buckets[at, slot[0]] = 0
                    break

    def row(self) -> tuple[bytes, bytes]:
        return self.buckets.tobytes(), np.array(sorted(self.stash), dtype="<i8").tobytes()

    @classmethod
    def from_row(cls, buckets: bytes, stash: bytes) -> CuckooFilter:
        pairs = np.frombuffer(stash, dtype="<i8").reshape(-1, 2)
        return cls(np.frombuffer(buckets, dtype="<u2").reshape(-1, SLOTS).copy(),
                   {(int(a), int(b)) for a, b in pairs})


# ---------------------------------------------------------------- state

@F.pandas_udf(ArrayType(longs("h1", "h2")))
def distinct_keys(text: pd.Series) -> pd.Series:
    """The digests of a text's different line keys."""
    out = []
    for t in text:
        keys = {line_key(x) for x in (t or "").encode().split(b"\n")}
        keys.discard(b"")
        out.append([{"h1": a, "h2": b} for a, b in digests(list(keys)).tolist()] if keys else [])
    return pd.Series(out, dtype=object)


def row_key(id: Column, text: Column) -> Column:
    """Stands for a document while its lines are looked up. Rows with one id and one text share
    it, and rarely others do; each then gets the lines of all, which does no harm, since all
    of them are duplicates. So a null or repeated id makes no large group."""
    return F.xxhash64(id, text)


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, h1, h2): one row per document and different line key."""
    row = row_key(F.col(key), F.col(text))
    return docs.select(row.alias("row"), F.explode(distinct_keys(F.col(text))).alias("k")).select(
        "row", "k.h1", "k.h2"
    )


def reference_counts(occ: DataFrame) -> DataFrame:
    return occ.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))


def change_counts(counts: DataFrame, added: DataFrame | None = None,
                  removed: DataFrame | None = None) -> DataFrame:
    """Counts after documents (as ``occurrences``) were added and removed."""
    parts = counts.select("h1", "h2", "n_docs")
    for occ, sign in ((added, 1), (removed, -1)):
        if occ is not None:
            parts = parts.unionByName(
                reference_counts(occ).withColumn("n_docs", F.col("n_docs") * sign))
    return parts.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")).filter("n_docs > 0")


def shard_count(counts: DataFrame, min_docs: int = MIN_DOCS) -> int:
    n = counts.filter(F.col("n_docs") >= min_docs).count()
    return 1 << max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS))))


def salt_count(counts: DataFrame, n_shards: int, rows: int = GROUP_ROWS) -> int:
    """Salts per shard, from the occurrences of all keys."""
    n = counts.agg(F.sum("n_docs")).first()[0] or 0
    return max(SALTS, -(-int(n) // (rows * n_shards)))


def _shard(n_shards: int):
    return F.pmod(F.col("h1"), F.lit(n_shards)).cast("int")


def _as_row(shard: int, f: CuckooFilter, keys: np.ndarray) -> pd.DataFrame:
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    buckets, stash = f.row()
    return pd.DataFrame({"shard": [shard], "buckets": [buckets], "stash": [stash], "keys": [keys.tobytes()]})


SHARD_ROW = "shard int, buckets binary, stash binary, keys binary"


def build_shards(counts: DataFrame, n_shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per shard: its cuckoo filter and the sorted exact keys behind it."""
    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame[["h1", "h2"]].to_numpy("<i8")
        f = CuckooFilter.sized(len(keys))
        f.insert(keys)
        return _as_row(key[0], f, keys)

    many = counts.filter(F.col("n_docs") >= min_docs)
    return many.select(_shard(n_shards).alias("shard"), "h1", "h2").groupBy("shard").applyInPandas(one, SHARD_ROW)


def change_shards(shards: DataFrame, before: DataFrame, after: DataFrame, n_shards: int,
                  min_docs: int = MIN_DOCS) -> DataFrame:
    """Shards after the counts changed: keys that crossed the bound are inserted into or
    deleted from the filters; no other key is touched, unless a filter has to grow."""
    def many(counts: DataFrame, sign: int) -> DataFrame:
        return counts.filter(F.col("n_docs") >= min_docs).select("h1", "h2", F.lit(sign).alias("way"))

    moved = (many(after, 1).unionByName(many(before, -1)).groupBy("h1", "h2")
             .agg(F.sum("way").alias("way")).filter("way != 0")
             .select(_shard(n_shards).alias("shard"), "h1", "h2", "way"))

    def one(key: tuple, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        came = change.loc[change.way > 0, ["h1", "h2"]].to_numpy("<i8").reshape(-1, 2)
        went = change.loc[change.way < 0, ["h1", "h2"]].to_numpy("<i8").reshape(-1, 2)
        if len(old):
            f = CuckooFilter.from_row(old.buckets[0], old.stash[0])
            keys = np.frombuffer(old["keys"][0], dtype="<i8").reshape(-1, 2)
        else:
            f, keys = CuckooFilter.sized(len(came)), np.zeros((0, 2), dtype="<i8")
        gone = set(map(tuple, went.tolist()))
        keys = np.array([k for k in map(tuple, keys.tolist()) if k not in gone], dtype="<i8").reshape(-1, 2)
        keys = np.concatenate([keys, came])
        if f.has_room(len(keys)):
            f.delete(went)
            f.insert(came)
        else:
            f = CuckooFilter.sized(len(keys))
            f.insert(keys)
        return _as_row(key[0], f, keys)

    return shards.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(one, SHARD_ROW)


# ---------------------------------------------------------------- use

def duplicate_occurrences(occ: DataFrame, shards: DataFrame, n_shards: int,
                          salts: int) -> DataFrame:
    """The occurrences whose key is a duplicate."""
    def one(_: tuple, rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(shard):
            return rows.iloc[:0][["row", "h1", "h2"]]
        h = rows[["h1", "h2"]].to_numpy("<i8")
        maybe = np.flatnonzero(CuckooFilter.from_row(shard.buckets[0], shard.stash[0]).contains(h))
        exact = set(map(tuple, np.frombuffer(shard["keys"][0], dtype="<i8").reshape(-1, 2).tolist()))
        sure = [i for i, k in zip(maybe, map(tuple, h[maybe].tolist()), strict=True) if k in exact]
        return rows.iloc[sure][["row", "h1", "h2"]]

    left = occ.select("row", "h1", "h2", _shard(n_shards).alias("shard"),
                      F.pmod(F.xxhash64("row", "h2"), F.lit(salts)).cast("int").alias("salt"))
    right = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(
        one, "row long, h1 long, h2 long")


@F.pandas_udf(longs("n_lines", "n_dropped").add("kept", StringType()))
def without(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
    """A text without the lines whose key is in ``drop``."""
    rows = []
    for t, gone in zip(text, drop, strict=True):
        lines = (t or "").encode().split(b"\n")
        kept = lines
        if gone is not None and len(gone):
            marks = {(g["h1"], g["h2"]) for g in gone}
            keys = digests([line_key(x) for x in lines]).tolist()
            kept = [x for x, k in zip(lines, keys, strict=True) if tuple(k) not in marks]
        rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def drop_lines(docs: DataFrame, duplicates: DataFrame, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_lines`` (n_lines, n_dropped, kept)."""
    lists = duplicates.groupBy("row").agg(F.collect_set(F.struct("h1", "h2")).alias("_drop"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"),
                         row_key(F.col(key), F.col(text)).alias("row"))
    joined = packed.join(lists, "row", "left")
    return joined.select("_d", without(F.col(f"_d.`{text}`"), F.col("_drop")).alias("_lines"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``_d``: the document's columns, ``_lines``: n_lines, n_dropped, kept text)."""
    bounded_batches(docs)
    occ = occurrences(docs, key, text)
    counts = staged(reference_counts(occ), "line-counts")
    n = shard_count(counts, min_docs)
    found = duplicate_occurrences(occ, build_shards(counts, n, min_docs), n, salt_count(counts, n))
    return drop_lines(docs, found, key, text)
