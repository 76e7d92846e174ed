"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps what was measured and one
bit per failed rule; a policy is a named mask of rules, so a new policy version or an
ablation only combines bits and never reads a text again.

Defined results: a null text counts as empty (it has no words and fails ``few_words``);
rows with equal ids stay separate rows; an empty table gives an empty ledger. Only the id
and the text are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_BYTES, bounded_batches, longs

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_ascii_letters", "n_shouts", "n_other_letters")

#: Rules in bit order. Never reorder: stored ledgers hold these bits.
RULES = ("few_words", "repeats", "symbols", "dup_lines", "capitals", "shouts", "word_length")

#: Policies by version; a document is rejected if it fails any rule of the policy.
POLICIES = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "dup_lines"),
    "v2": RULES,
}
CURRENT = "v2"

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII = re.compile(r"[\x00-\x7f]+")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words that occurs twice or more."""
    n = len(words)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    key = ids[: n - width + 1]
    for k in range(1, width):
        key = key * len(numbers) + ids[k: n - width + 1 + k]
        if k + 1 < width:  # keep the numbers small, however many words there are
            key = np.unique(key, return_inverse=True)[1]
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[where] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(width):
        covered[k: n - width + 1 + k] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode()
    size = len(raw)
    words = raw.split()
    upper = size - len(raw.translate(None, UPPER))
    seen: set[bytes] = set()
    lines = raw.split(b"\n")
    again = 0
    for line in lines:
        if line in seen:
            again += 1
        elif line.strip(SPACE_BYTES):
            seen.add(line)
    return (
        len(words),
        len(text) - (size - len(raw.translate(None, SPACE_BYTES))),
        size - len(raw.translate(None, b"#*$%&|<>")),
        again,
        repeated_words(words),
        len(lines),
        upper,
        upper + size - len(raw.translate(None, UPPER.lower())),
        raw.count(b"!!"),
        0 if len(text) == size else sum(map(str.isalpha, ASCII.sub("", text))),
    )


@F.pandas_udf(longs(*MEASURES))
def measurements(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES), dtype="int64")


def rule_bits(m: Column) -> Column:
    """Failure bits from a struct of measurements."""
    fails = (
        m["n_words"] < 50,
        m["n_repeat_words"] * 100 > m["n_words"] * 50,
        m["n_symbols"] * 100 > m["n_words"] * 25,
        m["n_dup_lines"] * 100 > m["n_lines"] * 50,
        # of the letters of all scripts: an acronym in a Cyrillic text is no shouting
        m["n_upper"] * 100 > (m["n_ascii_letters"] + m["n_other_letters"]) * 50,
        m["n_shouts"] * 100 > m["n_words"] * 25,
        (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 20),
    )
    bits = F.lit(0).cast("long")
    for i, failed in enumerate(fails):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, measurements, ``failures`` (one bit per failed rule)."""
    bounded_batches(docs)
    measured = docs.select(F.col(key), measurements(F.col(text)).alias("_m"))
    return measured.select(key, "_m.*", rule_bits(F.col("_m")).alias("failures"))


def accepted(failures: Column, policy: str = CURRENT) -> Column:
    return failures.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policies(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """A ledger with one boolean column ``kept_<version>`` for each policy."""
    return rows.select("*", *[
        (F.col("failures").bitwiseAND(F.lit(mask(rules)).cast("long")) == 0).alias(f"kept_{name}")
        for name, rules in policies.items()
    ])


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: how many documents fail it, fail only it (and
    would come back without it), and how many the policy rejects.

    The ledger is first counted by its failure bits, which are at most 2^rules rows; the
    rest is bit arithmetic on that small table.
    """
    patterns = rows.groupBy("failures").agg(F.count("*").alias("_n"))
    steps = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"),
                 F.lit(mask(rules)).cast("long").alias("all"), F.lit(mask((r,))).cast("long").alias("one"))
        for p, rules in policies.items() for r in rules
    ])
    hit = F.col("failures").bitwiseAND(F.col("_s.all"))
    return (
        patterns.withColumn("_s", F.explode(steps))
        .groupBy(F.col("_s.policy").alias("policy"), F.col("_s.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("_s.one")) != 0, F.col("_n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("_s.one"), F.col("_n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(hit != 0, F.col("_n")).otherwise(0)).alias("n_rejected"),
        )
    )


def keep_good(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that pass the policy, with all their columns."""
    bounded_batches(docs)
    names = docs.columns
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_d"),
                         measurements(F.col(text)).alias("_m"))
    return scored.filter(accepted(rule_bits(F.col("_m")), policy)).select("_d.*")
