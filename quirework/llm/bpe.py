"""Byte-pair encoding and decoding of whole texts, with tree concatenation of long ones.

A text of up to ``LEAF`` characters is encoded at once. A longer one is cut into leaves, which
are encoded in parallel wherever Spark puts them, and then joined two by two, level by level,
until one node holds the whole text. The ids of a node are those of its text on its own; a join
has to find out how far the cut between two nodes was felt on both sides:

- **Words.** The expression that splits a text into words goes from left to right and remembers
  nothing at a word's start. So the words of the left node hold up to a few characters before
  the cut (``margin``). From there the text is split again in a window that grows to the right
  until a word ends where one ends in the right node too; from there on both agree for good.
- **Ids.** A word across the cut may be of any length, since text without spaces is never
  split. Its ids are joined the same way: the last k ids on the left and the first k on the
  right are encoded again as one window, and k doubles until the window begins with the id
  that the left side begins it with and ends with the one that the right side ends it with.
  Then every two neighbouring ids also stand next to each other in some encoding, and a chain
  of ids is the encoding of its bytes if and only if this is so: the first merge across a
  boundary between two ids would cross it in these two alone as well.

Long texts are told apart by key and a digest of the text; repeated rows are encoded once. A
level joins ``FAN`` nodes of one text in one task, so no task holds more of a text than the
node that it makes.

Defined results: a null text is empty and has no ids; ids that the vocabulary lacks are skipped
in decoding, and bytes that are no UTF-8 become U+FFFD, as in the tokenizers library; strings
of special tokens in a text become their ids; repeated keys and rows stay rows of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, staged
from .packing import PLAIN

#: Characters of a leaf, and nodes that one task joins.
LEAF, FAN = 16_384, 64
#: Words whose ids a worker remembers, and characters of such a word.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Bytes of texts or ids that go to a Python worker at once, about.
BATCH_BYTES = 4 << 20
#: Ids on either side of a cut that are encoded again at first.
REACH = 8

_loaded: dict = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the other bytes in order from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Words(dict):
    """Packed ids (little-endian, 32 bits) of words, found when they are first asked for."""

    def __init__(self, bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        packed = self.bpe(word.encode()).tobytes()
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


class Coder:
    """A byte-level tokenizer file. ``pattern`` is the expression that splits texts; without it,
    and for texts with characters other than ``PLAIN`` ones, the library splits (tests compare
    both on every plain character)."""

    def __init__(self, path: str, pattern: str | None = None):
        import regex
        from tokenizers import Tokenizer

        self.file = Tokenizer.from_file(path)
        self.find = regex.compile(pattern).findall if pattern else None
        self.shown = dict(enumerate(byte_characters()))
        added = self.file.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()) or json.loads(self.file.to_str())["normalizer"]:
            raise ValueError("only added tokens that are taken as they stand, and no normalizer")
        self.special = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.longest = max(map(len, self.special), default=1)
        #: Characters before a cut whose words may change.
        self.margin = self.longest + 2
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.bytes_of = bytes_of_ids(path)
        self.packed = Words(self.bpe)

    def bpe(self, data: bytes) -> np.ndarray:
        """Ids of bytes that are one word, or a part of one."""
        mapped = data.decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.file.model.tokenize(mapped)], dtype="<u4")

    def words(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.special):
            out = []
            for part in self.split_special.split(text):
                out += [part] if part in self.special else self.plain_words(part)
            return out
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if self.find is not None and (text.isascii() or not PLAIN.search(text)):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.file.pre_tokenizer.pre_tokenize_str(text)]

    def ids_of(self, words: list[str]) -> list[bytes]:
        if self.special and any(s in self.special for s in words):
            return [self.special.get(w) or self.packed[w] for w in words]
        return list(map(self.packed.__getitem__, words))

    def encode(self, text: str) -> bytes:
        return b"".join(self.ids_of(self.words(text)))

    def text_bytes(self, ids: np.ndarray) -> bytes:
        return bytes_of_packed(self.bytes_of, ids)

    def decode(self, ids: np.ndarray) -> str:
        return self.text_bytes(ids).decode(errors="replace")


class Node:
    """Ids of a piece of text, and which of them begin a word."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray):
        self.ids, self.begins = ids, begins

    @classmethod
    def of(cls, packed: Sequence[bytes]) -> Node:
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        sizes = np.fromiter((len(p) // 4 for p in packed), dtype=np.int64, count=len(packed))
        begins = np.zeros(len(ids), dtype=np.uint8)
        begins[np.cumsum(sizes) - sizes] = 1
        return cls(ids, begins)

    def __getitem__(self, part: slice) -> Node:
        return Node(self.ids[part], self.begins[part])


def concat(nodes: Sequence[Node]) -> Node:
    return Node(np.concatenate([n.ids for n in nodes]), np.concatenate([n.begins for n in nodes]))


def join_ids(coder: Coder, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of a word from those of its two parts."""
    k = REACH
    while True:
        a, b = left[max(0, len(left) - k):], right[:k]
        window = coder.bpe(coder.text_bytes(a) + coder.text_bytes(b))
        if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
            return np.concatenate([left[: len(left) - len(a)], window, right[len(b):]])
        k *= 2


def join(coder: Coder, left: Node, right: Node) -> Node:
    """The node of the text of both."""
    if not len(left.ids) or not len(right.ids):
        return left if len(left.ids) else right
    starts = np.flatnonzero(left.begins)
    k = len(starts) - 1  # from the word starts[k] on, the left side is split again
    tail = coder.decode(left.ids[starts[k]:])
    while k > 0 and len(tail) < coder.margin:
        k -= 1
        tail = coder.decode(left.ids[starts[k]: starts[k + 1]]) + tail
    heads = np.append(np.flatnonzero(right.begins), len(right.ids))
    reach = REACH
    while True:
        last = min(reach, len(heads) - 1)
        own = [coder.decode(right.ids[heads[i]: heads[i + 1]]) for i in range(last)]
        words = coder.words(tail + "".join(own))
        whole = last == len(heads) - 1
        met = meeting(words, own, len(tail), 0 if whole else coder.margin)
        if met is not None:
            break
        reach *= 2
    n_words, n_own = met
    again = []
    at = 0
    for w in words[:n_words]:
        end = at + len(w)
        if at < len(tail) < end:
            again.append(across(coder, w, left, right, heads, int(starts[-1]), end - len(tail), own))
        else:
            again.append(Node.of(coder.ids_of([w])))
        at = end
    return concat([left[: int(starts[k])], *again, right[int(heads[n_own]):]])


def meeting(words: list[str], own: list[str], cut: int, margin: int) -> tuple[int, int] | None:
    """How many of ``words`` and of the right side's ``own`` words come before the first place
    behind the cut where a word ends in both and which the window's end doesn't touch."""
    total = sum(map(len, words))
    ends = {}
    at = cut
    for i, w in enumerate(own, 1):
        at += len(w)
        ends[at] = i
    at = 0
    for i, w in enumerate(words, 1):
        at += len(w)
        if at > total - margin:
            return None
        if at in ends:
            return i, ends[at]
    return None


def across(coder: Coder, word: str, left: Node, right: Node, heads: np.ndarray, start: int,
           behind: int, own: list[str]) -> Node:
    """Ids of a word that the cut goes through, ``behind`` characters of it on the right. If its
    parts were one word on either side, their ids are joined."""
    if len(own[0]) == behind and coder.decode(left.ids[start:]) == word[: len(word) - behind]:
        ids = join_ids(coder, left.ids[start:], right.ids[: int(heads[1])])
        begins = np.zeros(len(ids), dtype=np.uint8)
        begins[0] = 1
        return Node(ids, begins)
    return Node.of(coder.ids_of([word]))


def join_all(coder: Coder, nodes: list[Node]) -> Node:
    """Neighbours are joined two by two until one node is left."""
    while len(nodes) > 1:
        pairs = [join(coder, a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
        nodes = pairs + nodes[len(pairs) * 2:]
    return nodes[0]


def bytes_of_ids(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level tokenizer file stands for."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    added = {t["id"]: t["content"].encode() for t in file["added_tokens"]}
    tokens = {i: bytes(byte_of[c] for c in t) for t, i in file["model"]["vocab"].items() if i not in added} | added
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def bytes_of_packed(table: list[bytes], ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) >= len(table):
        ids = ids[ids < len(table)]
    return b"".join(map(table.__getitem__, ids.tolist()))


def coder(path: str, pattern: str | None) -> Coder:
    key = (path, pattern)
    if key not in _loaded:
        _loaded[key] = Coder(*key)
    return _loaded[key]


# --- tables ---------------------------------------------------------------------------


def encode(docs: DataFrame, path: str, pattern: str | None = None, key: str = "doc_id", text: str = "text",
           leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(doc_id, ids): the ids of each row's text, packed as little-endian unsigned 32-bit numbers."""
    bounded_batches(docs, size=BATCH_BYTES)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            ids = pa.array([c.encode(x.as_py()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    short = rows.filter(F.length("text") <= leaf).mapInArrow(whole, f"doc_id {kind}, ids binary")
    long = _long(rows.filter(F.length("text") > leaf), kind, path, pattern, leaf, fan)
    return short if long is None else short.unionByName(long)


def _long(rows: DataFrame, kind: str, path: str, pattern: str | None, leaf: int, fan: int) -> DataFrame | None:
    pieces = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).select(
        "doc_id", "digest", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0))).alias("node", "piece"))
    spread = pieces.groupBy("doc_id", "digest", "node").agg(F.first("piece").alias("piece"), F.count(F.lit(1)).alias("copies"))
    schema = f"doc_id {kind}, digest binary, node int, copies long, ids binary, begins binary"
    keys = ("doc_id", "digest", "node", "copies")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            nodes = [Node.of(c.ids_of(c.words(x.as_py()))) for x in batch.column("piece")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array([n.ids.tobytes() for n in nodes], pa.binary()),
                 pa.array([n.begins.tobytes() for n in nodes], pa.binary())], names=[*keys, "ids", "begins"])

    def joined(group: pa.Table) -> pa.Table:
        c = coder(path, pattern)
        group = group.sort_by("node")
        nodes = [Node(np.frombuffer(i.as_py(), dtype="<u4"), np.frombuffer(b.as_py(), dtype=np.uint8))
                 for i, b in zip(group.column("ids"), group.column("begins"), strict=True)]
        top = join_all(c, nodes)
        first = group.slice(0, 1)
        return pa.Table.from_arrays(
            [first.column("doc_id"), first.column("digest"), pa.array([first.column("node")[0].as_py() // fan], pa.int32()),
             first.column("copies"), pa.array([top.ids.tobytes()], pa.binary()), pa.array([top.begins.tobytes()], pa.binary())],
            names=[*keys, "ids", "begins"])

    nodes = staged(spread.mapInArrow(leaves, schema), "bpe-leaves")
    last = nodes.agg(F.max("node")).first()[0]
    if last is None:
        return None
    while last:
        nodes = nodes.groupBy("doc_id", "digest", F.floor(F.col("node") / fan)).applyInArrow(joined, schema)
        last //= fan
    # the digest is not an id of a row: equal rows were one until here
    return nodes.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with packed ids replaced by the text that they stand for."""
    rest = [c for c in encoded.columns if c != ids]
    kinds = dict(encoded.dtypes)
    bounded_batches(encoded, size=BATCH_BYTES)
    source = encoded.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(ids), F.unhex(F.lit(""))).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = bytes_of_ids(path)
        for batch in batches:
            texts = [bytes_of_packed(found, np.frombuffer(x.as_py(), dtype="<u4")).decode(errors="replace")
                     for x in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(rest))], pa.array(texts, pa.string())], names=[*rest, text])

    return source.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], f"`{text}` string"]))
