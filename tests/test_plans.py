from __future__ import annotations

import re

import pytest
from paths import SMALL

from quirework.operators.skew import salted_join
from quirework.plans import registry

QUERIES = registry.queries()
# queries whose fixture or reader opens archives in Python
ARCHIVES = {"epub_corpus_sections", "epub_rejects"}
# one row in, rows out: no exchange
MAP_ONLY = {
    "text_lines", "labelled_samples", "normalize_line_endings", "normalize_spaces", "scene_break_lines", "text_blocks",
    "dialogue_line_join", "dialogue_line_join_strict", "soft_wrap_join", "collapse_blank_lines", "clean_text", "paragraph_items",
    "dedupe_scene_breaks", "filter_scene_breaks", "merge_dialogue_items", "merge_dialogue_aggressive", "page_bodies",
    "strip_script_style", "section_heading", "entity_decode", "drop_boilerplate", "leaf_blocks", "hr_scene_rows", "block_text",
    "legacy_paragraph_clean", "page_title_author", "download_links", "pick_format", "clean_section_items", "clean_section_text",
    "clean_section_html", "strip_duplicate_heading", "slugify", "slug_from_path", "safe_filenames", "layout_resolution",
    "signature_spec", "signature_padding", "imposition_summary", "variant_fanout",
}


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, query in QUERIES.items():
        execution = query(spark, SMALL)._jdf.queryExecution()
        out[name] = (execution.optimizedPlan().toString(), execution.executedPlan().toString())
    return out


def test_no_python_outside_the_archive_reader(plans):
    for name, (_, physical) in plans.items():
        assert "EvalPython" not in physical, name
        assert ("MapInPandas" in physical) == (name in ARCHIVES), name


def test_map_only_queries_do_not_shuffle(plans):
    for name in MAP_ONLY:
        exchanges = re.findall(r"\bExchange (\w+)", plans[name][1])
        assert [e for e in exchanges if e != "RoundRobinPartitioning"] == [], name
        assert "SortMergeJoin" not in plans[name][1], name


def test_no_global_window_and_no_cartesian_product(plans):
    for name, (_, physical) in plans.items():
        assert "CartesianProduct" not in physical, name
        assert "SinglePartition" not in physical, name


def test_expensive_arrays_are_not_repeated_in_filters(plans):
    for name in MAP_ONLY:
        for line in re.findall(r"(?m)^[ :+\-]*Filter .*", plans[name][0]):
            assert "transform(" not in line and "regexp" not in line, (name, line[:300])


def test_scans_read_only_what_they_need(plans):
    for name in ("signature_spec", "layout_resolution", "imposition_plan"):
        assert "text" not in "".join(re.findall(r"ReadSchema: \S+", plans[name][1])), name


def test_oracle_and_query_names_agree():
    assert set(registry.oracle_sql()) == set(QUERIES)


def test_a_hot_key_is_spread_by_salting(spark):
    from pyspark.sql import functions as F

    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(big, small, ["k"], ["id"])
        assert joined.count() == 2000 and joined.filter("k = 'hot' and n = 667").count() == 667
        parts = joined.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_tables_are_joined_by_key(spark, no_broadcast):
    for name in ("html_documents", "markdown_documents", "section_blocks", "book_slugs", "preview_samples", "run_report"):
        physical = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in physical, name
        if name == "preview_samples":  # three sections of a book leave a task at most
            assert "WindowGroupLimit" in physical and "Join" not in physical


def test_building_a_query_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    try:
        for name in ("html_documents", "markdown_documents", "section_blocks", "run_report", "page_estimate"):
            QUERIES[name](spark, SMALL)
        # reading a parquet footer is a job of its own; nothing else may run
        assert len(tracker.getJobIdsForGroup("build")) <= 5 * 12
        for job in tracker.getJobIdsForGroup("build"):
            assert len(tracker.getJobInfo(job).stageIds) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_documents_clean_their_sections_once(spark):
    """The cleaning of a section stands in the plan once, and once more behind a condition for
    sections that may hold nothing but their heading."""
    from quirework.plans import queries_books as Q

    def work(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")

    once, text = work(Q._section_html(spark, SMALL)), work(Q._texts(spark, SMALL))
    tokens = work(Q._marks(spark, SMALL, True).filter("filled").select("book_id", "section_idx"))
    assert tokens < text and work(Q._marks(spark, SMALL, True).select("book_id")) == 0
    for name in ("section_blocks", "html_documents"):
        assert work(QUERIES[name](spark, SMALL)) <= 2 * once + 3, name
    assert work(QUERIES["markdown_documents"](spark, SMALL)) <= text + tokens
