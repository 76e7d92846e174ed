"""Language identification in two steps: family first, then languages of the family.

Texts become hashed byte n-grams of their lower-cased letters. Linear support vector
machines tell the families apart (one against the rest); within a family, one machine for
each pair of languages votes. The score is the product of both steps' confidences.

The machines are fitted on a bounded sample of labelled texts (``SAMPLE`` documents over all
languages, drawn by a hash of the text; copies count once); every text is then read as a whole. A language without an
entry in ``FAMILIES`` is a family of its own.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if nothing is labelled; with a single label every other text gets it. Very long texts
are read as a whole; rows with equal ids stay separate; an empty table gives no rows; columns
other than the ones named are not read, whatever they are called.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructType

from .common import bounded_batches, staged

SAMPLE = 1600
FOLDS = 5
BITS = 12
EPOCHS = 12
REGULAR = 1e-4
#: Characters of the short piece that is taken from each training text as well.
PIECE = 60
UNKNOWN = "und"

# fixed values: families of widely used languages by ISO code
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ca ro gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indic": "hi bn ur mr ne gu pa si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter becomes a space.
LETTERS_ONLY = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0], f"only {lang}")


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Square roots of n-gram counts (n = 1 to 4), scaled to length one."""
    raw = text.lower().encode().translate(LETTERS_ONLY).split()
    b = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8).astype(np.uint32)
    total = np.zeros(1 << bits, dtype=np.float64)
    code = np.zeros(len(b), dtype=np.uint32)
    for n in range(4):
        if n >= len(b):
            break
        code = (code[: len(b) - n] << np.uint32(8)) | b[n:]
        mixed = (code + np.uint32(n * 0x3C6EF372)) * np.uint32(2654435761)
        total += np.bincount(mixed >> np.uint32(32 - bits), minlength=1 << bits)
    total = np.sqrt(total)
    return total / np.linalg.norm(total)


def fit(x: np.ndarray, positive: np.ndarray, epochs: int = EPOCHS, regular: float = REGULAR) -> np.ndarray:
    """A linear support vector machine by averaged stochastic subgradient steps. Both sides
    weigh the same, however many rows they have."""
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * len(y)
    rng, w, mean, step = np.random.default_rng(len(y)), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    start = len(y)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step += 1
            rate = 1.0 / (regular * (step + start))
            w *= 1.0 - rate * regular
            if y[i] * (x[i] @ w) < 1.0:
                w += (rate * weight[i] * y[i] / 10) * x[i]
            mean += (w - mean) / step
    return mean


class Model:
    """Family machines and, by family, its languages and machines for their pairs."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        known, label = sorted(set(langs)), np.array(langs)
        self.languages: dict[str, list[str]] = defaultdict(list)
        for lang in known:
            self.languages[family_of(lang)].append(lang)
        self.families = sorted(self.languages)
        family = np.array([family_of(s) for s in langs])
        self.family_machines = np.array([fit(x, family == f) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f, members in self.languages.items():
            for a, b in combinations(members, 2):
                rows = (label == a) | (label == b)
                self.pairs[f, a, b] = fit(x[rows], label[rows] == a)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        f, sure = self.families[0], 1.0
        if self.family_machines is not None:
            margins = self.family_machines @ v
            best = int(margins.argmax())
            f, sure = self.families[best], sigmoid(margins[best] - np.delete(margins, best).max())
        members = self.languages[f]
        votes = dict.fromkeys(members, 0)
        margins = dict.fromkeys(members, 0.0)
        least = dict.fromkeys(members, 1.0)
        for a, b in combinations(members, 2):
            m = float(self.pairs[f, a, b] @ v)
            votes[a if m >= 0 else b] += 1
            margins[a] += m
            margins[b] -= m
            least[a], least[b] = min(least[a], sigmoid(2 * m)), min(least[b], sigmoid(-2 * m))
        lang = max(members, key=lambda s: (votes[s], margins[s]))
        return lang, float(sure * least[lang])


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -30, 30))))


def fold(key: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


@F.pandas_udf(BinaryType())
def training_rows(text: pd.Series) -> pd.Series:
    """Features of the whole text and of a short piece from its middle."""
    out = []
    for t in text:
        middle = max(0, len(t) // 2 - PIECE // 2)
        piece = t[middle: middle + PIECE]
        out.append(np.concatenate([features(t), features(piece)]).astype("<f2").tobytes())
    return pd.Series(out)


def first_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the rows with one ``lang`` and ``h``, the first that this task meets."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        new = []
        for pair in zip(batch["lang"], batch["h"], strict=True):
            new.append(pair not in seen)
            seen.add(pair)
        yield batch[new]


def draw(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, h): of the different texts of each language those with the smallest hashes, up
    to its share. Cut within tasks first, so no language's texts go to one task."""
    texts = staged(rows.select("lang", "h").distinct(), "language-texts")
    share = max(2, sample // max(1, texts.select("lang").distinct().count()))
    parts = texts.withColumn("_part", F.spark_partition_id())
    for by in (["lang", "_part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        parts = parts.withColumn("_rank", rank).filter(F.col("_rank") <= share)
    return staged(parts.select("lang", "h"), "language-sample")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` different texts, as many from each language as there are, up
    to its share."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # at most ``sample`` rows, or two a language
    drawn = rows.join(F.broadcast(draw(rows, sample)), ["lang", "h"]).select("lang", "h", "text")
    once = drawn.mapInPandas(first_copies, drawn.schema).dropDuplicates(["lang", "h"])
    langs, rows = [], once.select("lang", "h", training_rows("text").alias("x")).collect()
    if not rows:
        return None
    x = np.empty((2 * len(rows), 1 << BITS), dtype=np.float32)
    for r in sorted(rows, key=lambda r: (r["h"], r["lang"])):
        x[len(langs): len(langs) + 2] = np.frombuffer(r["x"], dtype="<f2").reshape(2, -1)
        langs += [r["lang"]] * 2
    del rows
    return Model(x, langs)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row; only the text is looked at."""
    kind = StructType().add("lang", StringType()).add("score", DoubleType())

    @F.pandas_udf(kind)
    def guess(texts: pd.Series) -> pd.DataFrame:
        out = [
            (UNKNOWN, 0.0) if model is None or t is None or not LETTER.search(t) else model.predict(features(t))
            for t in texts
        ]
        return pd.DataFrame(out, columns=["lang", "score"])

    return docs.select(F.col(key).alias("doc_id"), guess(F.col(text)).alias("_g")).select(
        "doc_id", F.col("_g.lang").alias("lang_pred"), F.col("_g.score").alias("score"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows outside fold 0, predict all."""
    bounded_batches(docs)
    model = train(docs.filter(fold(F.col(key)) != 0), text, lang)
    return predict(docs, model, key, text).withColumn("held_out", fold(F.col("doc_id")) == 0)
