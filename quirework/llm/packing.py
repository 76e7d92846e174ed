"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces longer than
capacity / (k + 1) and at most capacity / k, and a bin of class k is full with exactly k
pieces, so no bin is ever searched and each task fills its bins on its own. Since documents
may be cut, they are cut at the class bounds capacity, capacity / 2, ... capacity / ``SPLIT``,
where a bin of k pieces has no waste but rounding; only the last piece of a document, shorter
than capacity / ``SPLIT``, is as long as it happens to be. What remains in open bins when a
task ends is laid end to end and cut at the capacity, and the last such sequence at powers of
two, which need no padding.

Each task sees its own rows once and keeps open bins only, so memory does not grow with the
input; nothing is shuffled. A retried task makes the same sequences again.

Defined results: a null or empty text is the closing id alone; repeated ids are packed row
by row; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

CAPACITY = 1024
SPLIT = 8
END_ID = 0

#: Characters of which both regular expression engines agree what is a letter, a number or
#: white space (tests compare all of them): Latin, general punctuation, currency.
PLAIN = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")

_loaded: dict = {}


class Encoder:
    """Ids of the tokenizer file. Texts in plain characters take a faster implementation of
    the same vocabulary (``ranks``), which gives the same ids."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or not PLAIN.search(text)):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4")
            except BaseException as e:  # its expression engine gives up on some very long runs
                if type(e).__name__ != "PanicException":  # a BaseException of its own
                    raise
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    key = (path, ranks, pattern)
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]


def cuts(n: int, capacity: int = CAPACITY, split: int = SPLIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    out, at = [], 0
    for k in range(1, split + 1):
        size = capacity // k
        while n - at >= size:
            out.append((at, size))
            at += size
    if at < n:
        out.append((at, n - at))
    return out


class Packer:
    """Open bins of one task. A piece is (row, start, length, crc, doc_tokens); ``take`` and
    ``finish`` return full bins as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open = capacity, defaultdict(list)

    def take(self, piece: tuple) -> list[tuple] | None:
        k = self.capacity // piece[2]
        bin_ = self.open[k]
        bin_.append(piece)
        return self.open.pop(k) if len(bin_) == k else None

    def finish(self) -> list[list[tuple]]:
        """The rest, as (piece, from, to) parts laid end to end."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        left = sum(p[2] for p in rest)
        rooms = [self.capacity] * (left // self.capacity)
        rooms += [1 << b for b in reversed(range(self.capacity.bit_length())) if left % self.capacity >> b & 1]
        out, i, done = [], 0, 0
        for room in rooms:
            parts = []
            while room:
                size = min(room, rest[i][2] - done)
                parts.append((rest[i], done, done + size))
                room, done = room - size, done + size
                if done == rest[i][2]:
                    i, done = i + 1, 0
            out.append(parts)
        return out


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None,
         key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(docs)
    kind = dict(docs.dtypes)[key]
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names)
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, pattern)
        packer, bins = Packer(capacity), TaskContext.get().partitionId() << 40
        id_type = None
        rows: list[tuple] = []

        def emit(parts: list[tuple]) -> None:
            nonlocal bins
            offset = 0
            for (doc, start, _, crc, tokens), size in parts:
                rows.append((doc, start, size, crc, tokens, bins, offset))
                offset += size
            bins += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], type=id_type), *[pa.array(c, type=pa.int64()) for c in columns[1:]]],
                names=["doc_id", *names])

        kept: dict[int, np.ndarray] = {}  # ids of waiting pieces, for tails that are cut again
        number = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(x.as_py()), np.uint32(end_id)).astype("<u4")
                for start, size in cuts(len(ids), capacity):
                    part = ids[start: start + size]
                    number += 1
                    kept[number] = part.copy()
                    full = packer.take((number, start, size, doc, len(ids)))
                    if full:
                        emit([((d, s, n, zlib.crc32(kept.pop(i)), t), n) for i, s, n, d, t in full])
                if len(rows) > 50_000:
                    yield flush()
        for parts in packer.finish():
            emit([((d, s + a, b - a, zlib.crc32(kept[i][a:b].tobytes()), t), b - a)
                  for (i, s, _, d, t), a, b in parts])
        if rows:
            yield flush()

    return source.mapInArrow(run, schema)
