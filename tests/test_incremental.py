"""Only what changed is cleaned; counts on the way."""

from __future__ import annotations

import os

import pytest
from paths import SMALL
from pyspark.sql import Observation, functions as F

from quirework import settings as S
from quirework.operators import books as B
from quirework.operators import incremental as C
from quirework.operators import variants as V
from quirework.plans import fixtures as X
from quirework.sources import epub


def rows_of(df):
    return sorted(((r.book_id, r.section_idx, r.heading, r.profile, r.variant, [tuple(i) for i in r["items"]]) for r in df.collect()), key=repr)


def fresh(sections, groups):
    return rows_of(B.fan_out(B.section_items(sections.select("book_id", "section_idx", "heading", "html")), groups))


def test_only_changed_books_are_cleaned(spark, tmp_path):
    store = str(tmp_path / "store")
    sections = X.book_sections(spark, SMALL)
    groups = S.variant_groups(spark, "script")
    n, ways = sections.select("book_id").distinct().count(), groups.count()
    assert C.refresh(sections, groups, store) == (1, n, n, n * ways)
    assert rows_of(C.current_items(spark, store, groups)) == fresh(sections, groups)
    # nothing changed: nothing is cleaned, and no results are written
    again = sections.repartition(5)
    assert C.refresh(again, groups, store) == (2, n, 0, 0)
    assert sorted(d for d in os.listdir(tmp_path / "store" / "results")) == ["run=1"]
    # one section of one book edited
    edited = sections.withColumn("html", F.when(F.col("section_idx") == 23, "<p>new</p>").otherwise(F.col("html")))
    assert C.refresh(edited, groups, store) == (3, n, 1, ways)
    results = spark.read.parquet(f"{store}/results/run=3").select("book_id").distinct().collect()
    assert [r.book_id for r in results] == ["src3"]
    assert rows_of(C.current_items(spark, store, groups)) == fresh(edited, groups)
    assert rows_of(C.current_items(spark, store, groups, version=1)) == fresh(sections, groups)
    # a book gone, a book new, more variants
    other = edited.filter("book_id <> 'src5'").unionByName(edited.filter("book_id = 'src7'").withColumn("book_id", F.lit("late")))
    every = S.variant_groups(spark)
    new_ways = every.count() - ways
    assert C.refresh(other, every, store) == (4, n, n, (n - 1) * new_ways + every.count())
    assert rows_of(C.current_items(spark, store, every)) == fresh(other, every)
    # notes are another way of cleaning
    assert C.refresh(other, groups, store, drop_notes=True)[2:] == (n, n * ways)


def test_a_failed_refresh_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    sections, groups = X.book_sections(spark, SMALL).filter("book_id < 'src2'"), S.variant_groups(spark, "app")
    C.refresh(sections, groups, store)
    edited = sections.withColumn("html", F.concat("html", F.lit("<p>more</p>")))
    whole = C.clean_pairs
    monkeypatch.setattr(C, "clean_pairs", lambda *a: whole(*a).withColumn(
        "heading", F.when(F.col("section_idx") > 60, F.raise_error(F.lit("stop"))).otherwise(F.col("heading"))))
    with pytest.raises(Exception, match="stop"):
        C.refresh(edited, groups, store)
    assert C.last_version(spark, store) == 1
    assert rows_of(C.current_items(spark, store, groups)) == fresh(sections, groups)
    monkeypatch.undo()
    assert C.refresh(edited, groups, store).version == 2
    assert rows_of(C.current_items(spark, store, groups)) == fresh(edited, groups)


def test_contents(spark):
    df = spark.createDataFrame([("a", 1, "h", "x"), ("a", 2, None, "y"), ("b", 1, "h", "x"), ("c", 1, "", None)],
                               "book_id string, section_idx int, heading string, html string")
    swapped = spark.createDataFrame([("a", 2, "h", "x"), ("a", 1, None, "y"), ("b", 1, "h", "x"), ("d", 1, "", "")], df.schema)
    before, now = C.book_contents(df), C.book_contents(swapped)
    got = {r.book_id: r.status for r in C.compare_contents(before, now).collect()}
    assert got == {"a": "changed", "b": "unchanged", "c": "removed", "d": "new"}
    assert {r.content for r in C.book_contents(df).filter("book_id = 'c'").collect()} == {
        r.content for r in now.filter("book_id = 'd'").collect()}  # null and empty text are the same content
    assert C.book_contents(df.limit(0)).count() == 0


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_counts_without_a_second_pass(spark, tmp_path):
    entries = epub.epub_entries(X.epub_archives(spark, SMALL))
    seen = Observation("archives")
    with_counts = epub.epub_sections(entries, seen)
    extra = jobs_of(spark, "counted", lambda: with_counts.write.parquet(str(tmp_path / "a")))
    plain = jobs_of(spark, "plain", lambda: epub.epub_sections(entries).write.parquet(str(tmp_path / "b")))
    assert extra == plain
    kept = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "b")).collect()))
    good = entries.filter("error is null").count()
    assert seen.get == {"sections_read": good, "sections_dropped": good - kept.count(),
                        "archives_rejected": entries.filter("error is not null").count()}
    assert seen.get["sections_dropped"] > 0 and seen.get["archives_rejected"] > 0


def test_counts_of_texts_and_jobs(spark):
    sections = spark.createDataFrame([("a", 1, "", "<p>x</p>"), ("a", 2, "", "<p> </p>"), ("b", 1, "", "")],
                                     "book_id string, section_idx int, heading string, html string")
    seen = Observation()
    assert B.clean_section_text(B.section_items(sections), seen).count() == 1
    assert seen.get == {"sections_cleaned": 3, "sections_dropped": 2}
    jobs = spark.createDataFrame([("a", "standard", 1), ("a", "odd", 1), ("z", "standard", 1)], "book_id string, variant string, layout_id int")
    books = spark.createDataFrame([("a", 2)], "book_id string, n_sections long")
    layouts = spark.createDataFrame([(1, None)], "layout_id int, error string")
    seen = Observation()
    rows = V.run_status(jobs, books, S.variants(spark), layouts, seen).collect()
    assert len(rows) == 3 and seen.get == {"jobs_ok": 1, "jobs_failed": 2}
