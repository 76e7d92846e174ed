"""Phrase collocations, scored from sorted streams of counts.

**Counting.** Unigrams first, then phrases of two words, three, and so on, one pass over the
texts each; the last two lengths share a pass. A phrase can be frequent only if the two phrases one word shorter within it are,
so a pass counts only occurrences whose two shorter phrases may be frequent. It knows that from
a bit table of hashes of the frequent shorter phrases, at most ``MAX_BITS`` bits: where hashes
meet, a few occurrences too many are counted, none is left out, and counts are of the phrases
themselves. Tasks add up before anything is shuffled.

**Estimation.** The frequent phrases of all lengths are laid out as two sorted streams. In
prefix order a phrase follows all its prefixes, so one walk with a stack as deep as the
longest phrase gives the count of every prefix, and the largest count of a phrase one word
longer on the right. In suffix order (words reversed) the same walk gives counts of suffixes
and extensions on the left. The two streams then run in lockstep in a merge join by phrase;
nothing is looked up in a hash table. A stream is cut into ranges of keys; a phrase whose
extensions reach into further ranges is copied to these, so walks need nothing from each other.

**Scores.** A phrase of count a cut into parts of counts l and r scores
floor(1000 * a * n / (l * r)), in decimals of 38 digits (more would be an error; that takes
10^17 words of one language); its lowest cut counts. A phrase inside
a longer one of the same count is dropped: counts can't grow with a phrase, so it is enough to
look at extensions by one word.

Defined results: a null text is empty, a null language is ``und``; words are taken as bytes, so
nothing but A-Z changes case; repeated rows count again; an empty table gives no phrases. A very
long text is read in chunks that end where a piece ends.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import salted_join
from .common import bounded_batches, staged

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Bytes of a text that are split at once, at least.
CHUNK = 1 << 22
#: Different phrases that a task holds before it hands them on.
HELD = 400_000
#: Bits of a table of frequent phrases: per phrase, and at most (16 MB).
BITS_PER_PHRASE, MAX_BITS = 16, 1 << 27
#: Phrases of a range of a sorted stream, about.
RANGE = 100_000
#: Parts of a language whose best phrases are found first.
SALTS = 64

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(SEPARATORS + b"\t", b"\n" * len(SEPARATORS) + b" ")
BREAK = b"."  # never a word


def chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with ``BREAK`` between pieces."""
    data = data.lower().translate(TABLE)
    at = 0
    while at < len(data):
        cut = len(data)
        if cut - at > CHUNK:
            cut = data.rfind(b"\n", at, at + CHUNK)
            cut = cut if cut >= 0 else data.find(b"\n", at + CHUNK)
            cut = cut if cut >= 0 else len(data)
        yield data[at:cut].replace(b"\n", b" . ").split()
        at = cut + 1


def source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def streams(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    """Words by language; texts are a break apart."""
    out: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        words = out[lang]
        for more in chunks(text.as_py()):
            words += more
            words.append(BREAK)
    return out


def counted(source: DataFrame, phrases) -> DataFrame:
    """(lang, phrase, f): counts of what ``phrases()(lang, words)`` finds in streams of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        of = phrases()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                c.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()),
                     pa.array(c.values(), pa.int64())], names=["lang", "phrase", "f"])
            found.clear()

        for batch in batches:
            for lang, words in streams(batch).items():
                found[lang].update(of(lang, words))
            if sum(map(len, found.values())) > HELD:
                yield from flush()
        yield from flush()

    rows = source.mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


# --- tables of frequent phrases -----------------------------------------------------

MIX = np.uint64(0x9E3779B97F4A7C15)


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from hashes of all words but the last, and of the last."""
    x = (h ^ (h >> np.uint64(29))) * MIX + word
    return x ^ (x >> np.uint64(32))


class Codes(dict):
    """Hash of each word of a language, below 2 ** 63; 0 for a break and for words that are not
    in the table. Only words of the table are remembered: the others are mostly met once."""

    def __init__(self, lang: str, table: np.ndarray | None = None):
        super().__init__({BREAK: 0})
        self.seed = xxhash.xxh32_intdigest(lang.encode())
        self.bits = None if table is None else table.astype("<u8").tobytes()
        self.mask = 0 if table is None else len(table) * 64 - 1

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed) >> 1 or 1
        if self.bits is not None:
            bit = h & self.mask
            if not self.bits[bit >> 3] >> (bit & 7) & 1:
                return 0
        if len(self) < HELD:
            self[word] = h
        return h


def held(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64(len(table) * 64 - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_table(frequent: DataFrame, words: int) -> np.ndarray:
    """Bits of the hashes of ``frequent``, as words of 64 bits. Its size follows the number of
    phrases up to ``MAX_BITS``, and no more than the table itself reaches the driver."""
    bits = min(MAX_BITS, max(64, 1 << (BITS_PER_PHRASE * frequent.count()).bit_length()))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, Codes] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            codes |= {lang: Codes(lang) for lang in set(langs) - set(codes)}
            rows = [codes[lang] for lang in langs]
            parts = [p.as_py().encode().split(b" ") for p in batch.column("phrase")]
            h = np.array([c[p[0]] for c, p in zip(rows, parts, strict=True)], dtype=np.uint64)
            for k in range(1, words):
                h = longer(h, np.array([c[p[k]] for c, p in zip(rows, parts, strict=True)], dtype=np.uint64))
            bit = h & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((bit >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["at", "mask"])

    found = frequent.select("lang", "phrase").mapInArrow(hashes, "at long, mask long").groupBy("at").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return table


def unigrams():
    return lambda lang, words: words


def of_length(m: int, known: np.ndarray, shorter: np.ndarray | None, longer_too: bool = False):
    """Phrases of m words all of which ``known`` may hold, and whose two phrases of m - 1 words
    ``shorter`` may hold; with ``longer_too`` also those of m + 1 words whose two phrases of m words
    are among these."""
    def make():
        codes: dict[str, Codes] = {}

        def find(lang: str, words: list[bytes]) -> list[bytes]:
            if lang not in codes:
                codes[lang] = Codes(lang, known)
            code = np.fromiter(map(codes[lang].__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)
            n = len(words) - m + 1
            if n <= 0:
                return []
            ok = code != 0
            good = ok[:n].copy()
            for k in range(1, m):
                good &= ok[k: n + k]
            at = np.flatnonzero(good)
            if shorter is not None and len(at):
                first, second = code[at], code[at + 1]
                for k in range(1, m - 1):
                    first, second = longer(first, code[at + k]), longer(second, code[at + k + 1])
                at = at[held(shorter, first) & held(shorter, second)]
            out = [b" ".join(words[i: i + m]) for i in at.tolist()]
            if longer_too:
                out += [b" ".join(words[i: i + m + 1]) for i in at[:-1][np.diff(at) == 1].tolist()]
            return out

        return find

    return make


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                     text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, words, f) of all phrases found ``min_count`` times, (lang, n) with all words)."""
    bounded_batches(docs)
    texts = source(docs, text, lang)
    single = staged(counted(texts, unigrams), "phrases-1")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [single.filter(F.col("f") >= min_count)]
    known, shorter = bit_table(found[0], 1), None
    for m in range(2, max_words + 1):
        last_two = m == max_words - 1 and m > 2
        more = counted(texts, of_length(m, known, shorter, last_two)).filter(F.col("f") >= min_count)
        found.append(staged(more, f"phrases-{m}"))
        if last_two:
            break
        if m < max_words:
            shorter = bit_table(found[-1], m)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("lang", F.split("phrase", " ").alias("words"), "f"), totals


# --- sorted streams -----------------------------------------------------------------


class Walk:
    """A walk over phrases in order. ``take`` and ``finish`` give, when all that extends a phrase
    has been seen, (lang, words, f or None for a copy, counts inside, largest extension)."""

    def __init__(self):
        self.at, self.stack = None, []

    def take(self, at, words: tuple[str, ...], f: int, own: bool) -> Iterator[tuple]:
        if at != self.at:
            yield from self.finish()
            self.at = at
        while self.stack and words[: len(self.stack)] != self.stack[-1][0]:
            yield self.close()
        if len(self.stack) != len(words) - 1:
            raise ValueError("a prefix of a frequent phrase is missing")
        if self.stack:
            self.stack[-1][3] = max(self.stack[-1][3], f)
        self.stack.append([words, f, own, 0])

    def close(self) -> tuple:
        inside = [s[1] for s in self.stack[:-1]]
        words, f, own, longest = self.stack.pop()
        return self.at[1], words, f if own else None, inside if own else None, longest

    def finish(self) -> Iterator[tuple]:
        while self.stack:
            yield self.close()


def walked(frequent: DataFrame, backwards: bool, max_words: int, rows: int = RANGE) -> DataFrame:
    """(lang, words, f, inside, longest): for each phrase the counts of the phrases that it begins
    with (backwards: ends with), shortest first, and the largest count of one that extends it."""
    order = F.reverse("words") if backwards else F.col("words")
    stream = frequent.select("lang", order.alias("words"), "f")
    ranges = frequent.count() // rows + 1
    bounds: list[tuple[str, tuple[str, ...]]] = []
    if ranges > 1:
        firsts = stream.repartitionByRange(ranges, "lang", "words").groupBy(F.spark_partition_id()).agg(
            F.min(F.struct("lang", "words")).alias("b")).collect()
        bounds = sorted((r.b.lang, tuple(r.b.words)) for r in firsts)[1:]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, words, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "f")), strict=True):
                key = (lang, tuple(words))
                own = last = bisect_right(bounds, key)
                if len(words) < max_words:  # ranges that begin inside the extensions of the phrase
                    last = bisect_right(bounds, key, lo=own, key=lambda b, m=len(words): (b[0], b[1][:m]))
                out += [(r, lang, words, f, r == own) for r in range(own, last + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, TYPES, strict=True)],
                names=["range", "lang", "words", "f", "own"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Walk()

        def pack(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, DONE, strict=True)],
                names=["lang", "words", "f", "inside", "longest"])

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("range", "lang", "words", "f", "own")]
            for r, lang, words, f, own in zip(*columns, strict=True):
                out += state.take((r, lang), tuple(words), f, own)
            yield pack(out)
        yield pack(list(state.finish()))

    dealt = stream.mapInArrow(deal, "range long, lang string, words array<string>, f long, own boolean")
    done = dealt.repartition("range").sortWithinPartitions("range", "lang", "words").mapInArrow(
        walk, "lang string, words array<string>, f long, inside array<long>, longest long")
    whole = F.reverse("words") if backwards else F.col("words")
    return done.groupBy("lang", whole.alias("words")).agg(
        F.max("f").alias("f"), F.max("inside").alias("inside"), F.max("longest").alias("longest"))


TYPES = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_()]
DONE = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 text: str = "text", lang: str = "lang", rows: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of each language."""
    frequent, totals = frequent_phrases(docs, min_count, max_words, text, lang)
    left = walked(frequent, False, max_words, rows).withColumnsRenamed({"inside": "before", "longest": "on_right"})
    right = walked(frequent, True, max_words, rows).select(
        "lang", "words", F.col("inside").alias("behind"), F.col("longest").alias("on_left"))
    both = left.hint("merge").join(right, ["lang", "words"]).filter(F.size("words") > 1)
    open_ = both.filter((F.col("on_right") < F.col("f")) & (F.col("on_left") < F.col("f")))
    rated = salted_join(open_, totals, ["lang"], ["words"])

    def cut(k):
        # parts of k words and of the rest; behind has the suffixes, shortest first
        l, r = F.get("before", k - 1), F.get("behind", F.size("words") - k - 1)
        return F.struct(score("f", "n", l, r).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))
    scored = rated.withColumn("_best", best).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "_best.l", "_best.r", "n", "_best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = Window.partitionBy("lang", "_salt").orderBy(*order)
    few = salted.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).drop("rank", "_salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def score(a: str, n: str, l, r):
    """floor(1000 * a * n / (l * r)), exact."""
    wide = "decimal(38,0)"
    product = F.lit(1000).cast(wide) * F.col(a).cast(wide) * F.col(n).cast(wide)
    return F.call_function("div", product, l.cast(wide) * r.cast(wide))
