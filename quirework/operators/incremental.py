"""Variants of a corpus, cleaned only where a book's content or a variant's switches changed.

A store is a folder with

- ``plans/version=N``: a row ``(book_id, switches, content, run)`` for every book and different
  group of switches: a digest of the book's sections, and the run whose results stand for them;
- ``results/run=N``: cleaned items of the sections that run N had to clean, by switches;
- ``versions``: the versions that are complete. Readers see the last one.

A refresh writes the plan first, cleans what the plan gives to its own run, and enters the
version last. If it fails on the way, the store is as before, and the next refresh writes the
same folders again. Everything is read and written through Spark.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import settings as S
from . import books as B
from .skew import salted_join
from .variants import texts_digest

#: Raise it when cleaning changes: all results are then made anew.
RULES = "1"
KEYS = ("book_id", "switches")


class Refresh(NamedTuple):
    version: int
    books: int
    #: Books of which at least one group of switches was cleaned, and pairs of book and group.
    cleaned_books: int
    cleaned_pairs: int


def switches_of(flags: dict[str, Column], drop_notes: bool) -> Column:
    """The switches of a group as a string; equal strings give equal results."""
    marks = [F.when(c, "1").otherwise("0") for c in flags.values()]
    return F.concat(F.lit(f"{RULES}{int(drop_notes)}-"), *marks)


def with_switches(groups: DataFrame, drop_notes: bool) -> DataFrame:
    return groups.withColumn("switches", switches_of({c: F.col(c) for c in S.VARIANT_COLUMNS[2:]}, drop_notes))


def book_contents(sections: DataFrame) -> DataFrame:
    """``(book_id, content)``: a digest of a book's sections, their numbers, headings and HTML. Tasks
    add up digests of sections; the sections of a book never meet."""
    text = F.concat_ws("\x1f", F.coalesce("heading", F.lit("")), F.coalesce("html", F.lit("")))
    return sections.groupBy("book_id").agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), texts_digest(F.col("section_idx"), text)).alias("content"))


def compare_contents(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(book_id, status)`` of two results of ``book_contents``: new, changed, unchanged, removed."""
    old = before.select("book_id", F.col("content").alias("_before"))
    both = old.join(now.select("book_id", "content"), "book_id", "full")
    status = (
        F.when(F.col("_before").isNull(), "new").when(F.col("content").isNull(), "removed")
        .when(F.col("_before") == F.col("content"), "unchanged").otherwise("changed"))
    return both.select("book_id", status.alias("status"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_version(spark: SparkSession, store: str) -> int:
    """The last complete version, or 0."""
    versions = _read(spark, f"{store}/versions")
    return 0 if versions is None else versions.agg(F.max("version")).first()[0] or 0


def plan_of(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{store}/plans/version={version}")


def refresh(sections: DataFrame, groups: DataFrame, store: str, drop_notes: bool = False) -> Refresh:
    """Bring the store up to date with ``sections`` under ``groups`` (``settings.variant_groups``).

    Books that are gone leave the plan. Pairs whose content and switches an earlier plan has keep
    their results; an anti-join finds the others before anything is cleaned or fanned out.
    """
    spark = sections.sparkSession
    version = last_version(spark, store) + 1
    marked = with_switches(groups, drop_notes)
    # a fixed table of a few rows
    wanted = book_contents(sections).crossJoin(F.broadcast(marked.select("switches").distinct()))
    if version > 1:
        known = plan_of(spark, store, version - 1)
        plan = wanted.join(known, [*KEYS, "content"], "left").withColumn("run", F.coalesce("run", F.lit(version)))
    else:
        plan = wanted.withColumn("run", F.lit(version))
    plan.select(*KEYS, "content", "run").write.mode("overwrite").parquet(f"{store}/plans/version={version}")
    plan = plan_of(spark, store, version)
    todo = plan.filter(F.col("run") == version)
    counts = plan.agg(
        F.countDistinct("book_id").alias("books"), F.countDistinct(F.when(F.col("run") == version, F.col("book_id"))).alias("cleaned"),
        F.count(F.when(F.col("run") == version, 1)).alias("pairs")).first()
    if counts.pairs:
        results = clean_pairs(sections, todo, marked, drop_notes)
        results.write.mode("overwrite").parquet(f"{store}/results/run={version}")
    spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{store}/versions")
    return Refresh(version, counts.books, counts.cleaned, counts.pairs)


def clean_pairs(sections: DataFrame, todo: DataFrame, marked: DataFrame, drop_notes: bool) -> DataFrame:
    """Items of the sections of ``todo``'s books, under the switches that each book needs."""
    needs = todo.groupBy("book_id").agg(F.collect_set("switches").alias("_needs"))  # at most one a group
    some = salted_join(sections.select("book_id", "section_idx", "heading", "html"), needs, ["book_id"], ["section_idx"])
    base = B.section_items(some, drop_notes).withColumn("switches", F.explode("_needs")).drop("_needs")
    flagged = base.join(F.broadcast(marked.drop("names")), "switches")
    return B.apply_switches(flagged).select("book_id", "section_idx", "heading", "switches", "items")


def current_items(spark: SparkSession, store: str, groups: DataFrame, drop_notes: bool = False,
                  version: int | None = None) -> DataFrame:
    """``(book_id, section_idx, heading, profile, variant, items)`` of a version (the last one): what
    cleaning all books under ``groups`` would give. Variants with equal switches share results."""
    version = last_version(spark, store) if version is None else version
    if not version:
        raise ValueError(f"no complete version in {store}")
    plan = plan_of(spark, store, version).select(*KEYS, "run")
    rows = _read(spark, f"{store}/results")
    if rows is None:  # no book had a section yet
        raise ValueError(f"no results in {store}")
    mine = salted_join(rows, plan, [*KEYS, "run"], ["section_idx"])
    named = mine.join(F.broadcast(with_switches(groups, drop_notes).select("switches", "names")), "switches")
    return named.select("book_id", "section_idx", "heading", F.inline("names"), "items")
