"""Personal data: fixed forms, and identifiers found by bootstrapped context.

The four fixed forms (email, ip, card, phone) are always reported, and they are the seeds.
The word before a seed is a lexical pattern. Patterns and identifier-like tokens form a
graph (an edge says that the token occurred after the word), and scores go around it: a
pattern is worth the share of its occurrences *in the whole corpus* that are followed by
known identifiers; a token is worth what the patterns around it say together. Tokens above
the threshold become known and lend their score to further patterns in the next round.
Only patterns that nearly always announce an identifier get anywhere; common words do not.

Defined results: a null text counts as empty; rows with equal ids stay separate; an empty
table gives no rows; very long texts are scanned as a whole; columns other than the ones named
are not read, whatever they are called. Patterns are single words of less than 48 characters
(``spans.CONTEXT``): what stands farther before a match is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirework.functions.expr import let
from quirework.operators.skew import salted_join

from .common import staged
from .spans import joined, matches, named, with_row_ids

KINDS = ("email", "ip", "card", "phone", "context")
EMAIL, IP, CARD, PHONE, CONTEXT = range(5)

# fixed values: the base forms. Runs that cannot succeed from their start cannot from within,
# so a lookbehind (or the end of the match before) keeps long runs linear.
EMAIL_FORM = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_FORM = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_FORM = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE_FORM = r"\+[0-9][\x20().0-9-]+[0-9]"
# what an unseen identifier may look like: six digits or more, with letters and dashes
TOKEN_FORM = r"(?<![A-Za-z0-9.@+/-])(?:[A-Z]{1,4}-?)?[0-9]{2,}+(?:[-/][0-9A-Z]{2,}+){0,4}+(?![A-Za-z0-9@]|[.,/-][0-9A-Za-z])"

ROUNDS = 3
#: Score from which a token counts as an identifier, and from which a pattern speaks at all.
THRESHOLD = 0.5
PATTERN_FLOOR = 0.1
#: Occurrences a pattern needs, and different known identifiers after it.
MIN_COUNT = 5
MIN_KNOWN = 3


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return let(F.reverse(number), lambda r: F.pmod(F.aggregate(
        F.sequence(F.lit(1), F.length(r)), F.lit(0),
        lambda a, i: a + let(F.substring(r, i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(
            F.when(d > 4, d * 2 - 9).otherwise(d * 2)))), F.lit(10)) == 0)


def is_card(hit: Column) -> Column:
    return let(digits(hit), lambda d: F.length(d).between(13, 19) & luhn(d))


def parts_in_range(hit: Column) -> Column:
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3  # noqa: E731  leading zeros don't count
    return F.forall(F.split(hit, r"\."), lambda p: part(p) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))


def candidates(text: Column) -> Column:
    whole = lambda m: m["hit"]
    token = lambda m: ((F.length(digits(m["hit"])) >= 6) & ~is_card(m["hit"])
                       & ~m["left"].rlike(r"\+[0-9][\x20().0-9-]*$|[0-9][\x20-]$"))
    return F.concat(
        named(matches(text, EMAIL_FORM, text.contains("@")), EMAIL, whole, lambda m: F.lit(True)),
        named(matches(text, IP_FORM, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), IP, whole,
              lambda m: parts_in_range(m["hit"])),
        named(matches(text, CARD_FORM, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), CARD, whole, lambda m: is_card(m["hit"])),
        named(matches(text, PHONE_FORM, text.contains("+")), PHONE, whole,
              lambda m: F.length(digits(m["hit"])).between(9, 15)),
        named(matches(text, TOKEN_FORM, text.rlike("[0-9]{2}")), CONTEXT, whole, token),
    )


def pattern_of(left: Column) -> Column:
    """The word right before a match, in lower case; null if there is none."""
    word = F.regexp_extract(F.lower(left), r"(\S+)\s+$", 1)
    return F.when(word != "", word)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """How often every word of the corpus occurs."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("pattern"))
    return words.filter("pattern <> ''").groupBy("pattern").agg(F.count("*").alias("n_all"))


def bootstrap(occurrences: DataFrame, totals: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(value, score) of newly known identifiers, from rows (value, pattern, seed)."""
    edges = staged(
        occurrences.filter("pattern IS NOT NULL").groupBy("pattern", "value")
        .agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-graph")
    totals = staged(totals.join(edges.select("pattern").distinct(), "pattern", "left_semi")
                    .filter(F.col("n_all") >= MIN_COUNT), "pii-words")
    known = edges.filter("seed").select("value", F.lit(1.0).alias("score")).distinct()
    for _ in range(rounds):
        scored = edges.join(known, "value").groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("score")).alias("mass"), F.count("*").alias("n_known"))
        worth = F.least(F.col("mass") / F.col("n_all"), F.lit(1.0))
        patterns = (scored.filter(F.col("n_known") >= MIN_KNOWN).join(totals, "pattern")
                    .select("pattern", worth.alias("worth")).filter(F.col("worth") >= PATTERN_FLOOR))
        # together: 1 - product of (1 - worth) over the patterns before the token
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("worth"), F.lit(1e-9)))))
        found = (salted_join(edges.filter("NOT seed"), patterns, ["pattern"], ["value"])
                 .groupBy("value").agg((1 - doubt).alias("score")).filter(F.col("score") >= threshold))
        known = staged(edges.filter("seed").select("value", F.lit(1.0).alias("score")).distinct()
                       .unionByName(found), "pii-known")
    seeds = edges.filter("seed").select("value").distinct()
    return known.join(seeds, "value", "left_anti")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id and ``spans``, an array of (kind, start, end) by kind, then
    start."""
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_t"))
    found = F.transform(candidates(F.col("_t")), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.sha2(s["value"], 256).alias("value"), pattern_of(s["left"]).alias("pattern")))
    base = staged(with_row_ids(whole.select("doc_id", found.alias("found"))), "pii")
    rows = base.filter(F.size("found") > 0).select("rid", F.explode("found").alias("s")).select("rid", "s.*")
    known = bootstrap(rows.select("value", "pattern", (F.col("kind") != CONTEXT).alias("seed")),
                      word_counts(docs, text), rounds)
    added = salted_join(rows.filter(F.col("kind") == CONTEXT), known, ["value"], ["rid", "start"])
    lists = added.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    fixed = F.array_sort(F.transform(F.filter("found", lambda s: s["kind"] != CONTEXT),
                                     lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return base.join(lists, "rid", "left").select("doc_id", F.when(
        F.col("added").isNull(), fixed).otherwise(F.concat(fixed, "added")).alias("spans"))


def digest(rows: DataFrame) -> DataFrame:
    spans = F.col("spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in (EMAIL, IP, CARD, PHONE)],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != CONTEXT), KINDS), 256).alias("base_sha256"),
        joined(spans, KINDS).alias("spans"))
