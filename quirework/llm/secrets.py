"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every text, their values hashed, and the hashes counted over the
whole corpus: in how many repositories and for how many owners does each value occur? A
value that many owners share has been copied from documentation and the like; a value of
one or two owners looks like a live credential. Matches of the three fixed forms (assign,
access, hex) are always reported; opaque tokens are added where ownership says "live".

Defined results: a null text counts as empty; a null owner or repository counts as one;
rows with equal ids stay separate; an empty table gives no rows; very long texts are scanned as
a whole; columns other than the ones named are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirework.operators.skew import salted_join

from .common import staged
from .spans import joined, matches, named, with_row_ids

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN, ACCESS, HEX, OPAQUE = range(4)

# fixed values: the forms of the three base kinds (possessive where nothing is given back)
ASSIGN_FORM = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS_FORM = r"AKIA[A-Z0-9]++"
HEX_FORM = r"[0-9a-f]{32,}+"
# long runs of letters and digits that no base form covers
OPAQUE_FORM = r"[A-Za-z0-9_-]{20,}+"
ASSIGNED = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/.=]*$"

#: Owners up to which a value looks like somebody's own.
MAX_OWNERS = 2


def candidates(text: Column) -> Column:
    """All candidate spans of a text (not null), as (start, end, kind, value, left)."""
    whole = lambda m: m["hit"]
    assigned = lambda m: F.regexp_extract(m["hit"], ASSIGN_FORM, 1)
    return F.concat(
        named(matches(text, ASSIGN_FORM, text.rlike("(?i:passw|secret|token|api_?key)")), ASSIGN, assigned,
              lambda m: F.length(assigned(m)) >= 8),
        named(matches(text, ACCESS_FORM, text.contains("AKIA")), ACCESS, whole, lambda m: F.length(m["hit"]) >= 16),
        named(matches(text, HEX_FORM, text.rlike("[0-9a-f]{32}")), HEX, whole, lambda m: F.lit(True)),
        named(matches(text, OPAQUE_FORM, text.rlike("[A-Za-z0-9_-]{20}")), OPAQUE, whole, looks_random),
    )


def looks_random(m: Column) -> Column:
    """Upper case, lower case and several digits mixed, and not part of a base match."""
    hit = m["hit"]
    letters = F.array_size(F.array_distinct(F.split(hit, "")))
    return (hit.rlike("[A-Z]") & hit.rlike("[a-z]") & hit.rlike("[0-9][^0-9]*[0-9][^0-9]*[0-9]") & (letters >= 12)
            & ~hit.startswith("AKIA") & ~m["left"].rlike(ASSIGNED))


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos) from rows (value, owner, repo). Three rounds of partial
    aggregation, so a value that is everywhere is never gathered in one task."""
    each = found.groupBy("value", "owner", "repo").agg(F.count("*").alias("_n"))
    owners = each.groupBy("value", "owner").agg(F.count("*").alias("_repos"))
    return owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("_repos").alias("n_repos"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
         max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per document: doc_id and ``spans``, an array of (start, kind, end, value, n_owners,
    n_repos, live) in the order of start, then kind. ``value`` is a hash of the secret."""
    whole = docs.select(F.col(key).alias("doc_id"), F.col(owner).alias("owner"), F.col(repo).alias("repo"),
                        F.coalesce(text, F.lit("")).alias("_t"))
    found = F.transform(candidates(F.col("_t")), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value")))
    base = staged(with_row_ids(whole.select("doc_id", "owner", "repo", found.alias("found"))), "secrets")
    rows = base.filter(F.size("found") > 0).select("rid", "doc_id", "owner", "repo", F.explode("found").alias("s"))
    rows = rows.select("rid", "doc_id", "owner", "repo", "s.*")
    counted = salted_join(rows, ownership(rows), ["value"], ["rid", "start"])
    live = (F.col("n_owners") <= max_owners).alias("live")
    span = F.struct("start", "kind", "end", "value", "n_owners", "n_repos", live)
    kept = counted.filter((F.col("kind") != OPAQUE) | (F.col("n_owners") <= max_owners))
    lists = kept.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    # texts whose candidates all turned out to be examples have no list
    some = base.filter(F.size("found") > 0).select("rid", "doc_id").join(lists.drop("doc_id"), "rid", "left")
    kind = dict(lists.dtypes)["spans"]
    none = F.array().cast(kind)
    return some.select("doc_id", F.coalesce("spans", none).alias("spans")).unionByName(
        base.filter(F.size("found") == 0).select("doc_id", none.alias("spans")))


def digest(rows: DataFrame) -> DataFrame:
    """The report row of each document."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != OPAQUE)

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id", count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"), count(HEX).alias("n_hex"),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(spans, KINDS).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_copied"))
