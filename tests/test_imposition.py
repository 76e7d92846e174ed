from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.operators import imposition as I

REQ = "job int, total_pages bigint, sheets int, pages int, max_end_padding int, direction string"


def jobs(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REQ)
    return I.signature_padding(I.signature_spec(df))


def test_signature_spec(spark):
    rows = [
        ((None, None, None, None), (4, 16, None)),
        ((5, None, None, "ltr"), (5, 20, None)),
        ((None, 24, None, " RTL "), (6, 24, None)),
        ((4, 16, 8, ""), (4, 16, None)),
        ((4, 20, None, None), (None, None, "sheets_pages_conflict")),
        ((None, 10, None, None), (None, None, "pages_not_multiple_of_4")),
        ((None, 0, None, None), (None, None, "pages_not_multiple_of_4")),
        ((0, None, None, None), (None, None, "sheets_not_positive")),
        ((None, None, None, "up"), (None, None, "unknown_direction")),
        ((None, None, -1, None), (None, None, "negative_padding")),
    ]
    got = jobs(spark, *[(10, *r) for r, _ in rows]).orderBy("job").collect()
    assert [(r.sheets, r.pages, r.error) for r in got] == [w for _, w in rows]
    assert got[2].direction == "rtl" and got[3].direction == "ltr"


def test_padding(spark):
    got = jobs(spark, (0, None, None, None, None), (17, None, 16, 15, None), (17, None, 16, 14, None), (16, None, 16, 0, None)).orderBy("job").collect()
    assert [(r.padded_pages, r.blank_pages, r.signatures, r.error) for r in got] == [
        (None, None, None, "no_pages"), (32, 15, 2, None), (None, None, None, "too_much_padding"), (16, 0, 1, None)]


def test_the_largest_signature_with_int_columns(spark):
    top = I.MAX_SHEETS
    df = spark.createDataFrame([(0, 100, top, None, None, None), (1, 2**31 - 1, top, None, None, None)],
                               REQ.replace("total_pages bigint", "total_pages int"))
    got = I.signature_padding(I.signature_spec(df)).orderBy("job").collect()
    assert [(r.padded_pages, r.blank_pages, r.signatures, r.error) for r in got] == [
        (top * 4, top * 4 - 100, 1, None), (top * 8, top * 8 - (2**31 - 1), 2, None)]


def test_sixteen_page_pairs(spark):
    sizes = spark.createDataFrame([(1, 16), (2, 10), (3, 0), (4, -4), (5, None)], "job int, pages int")
    rows = I.sheet_pairs(sizes, ["job"]).collect()
    assert {r.job: r.error for r in rows if r.status == "rejected"} == {
        2: "pages_not_multiple_of_4", 3: "pages_not_positive", 4: "pages_not_positive", 5: "no_pages"}
    rows = sorted((r for r in rows if r.status == "ok"), key=lambda r: (r.sheet_no, r.side == "back"))
    assert [(r.sheet_no, r.side, (r.left_page, r.right_page)) for r in rows] == [
        (1, "front", (16, 1)), (1, "back", (2, 15)), (2, "front", (14, 3)), (2, "back", (4, 13)),
        (3, "front", (12, 5)), (3, "back", (6, 11)), (4, "front", (10, 7)), (4, "back", (8, 9))]


@pytest.mark.parametrize("direction", ["ltr", "rtl"])
def test_every_page_has_one_slot(spark, direction):
    df = jobs(spark, (1, None, 4, None, direction), (33, None, 8, None, direction), (96, None, 32, None, direction))
    plan = I.imposition_plan(df, ["job"])
    per_job = plan.groupBy("job").agg(
        F.count("*").alias("n"), F.countDistinct("page_no").alias("d"), F.max("page_no").alias("m"),
        F.sum(F.col("is_blank").cast("int")).alias("blank"),
        F.countDistinct("signature_no", "sheet_no", "side").alias("sides"), F.countDistinct("signature_no").alias("sigs"))
    summary = {r.job: r for r in I.imposition_summary(df, ["job"]).collect()}
    for r in per_job.collect():
        s = summary[r.job]
        assert r.n == r.d == r.m == s.input_pages + s.blank_pages_added
        assert (r.blank, r.sides, r.sigs) == (s.blank_pages_added, s.sheet_sides, s.total_signatures)
        assert s.physical_sheets * 2 == s.sheet_sides
    assert I.placed_pages(plan, df, ["job"]).filter("misplaced").count() == 0
    lost = plan.filter("NOT (job = 1 AND page_no = 7)")
    assert [r.job for r in I.placed_pages(lost, df, ["job"]).filter("misplaced").collect()] == [1]
    front = plan.filter("job = 1 and signature_no = 2 and sheet_no = 1 and side = 'front'").orderBy("position").collect()
    assert [r.page_no for r in front] == ([16, 9] if direction == "ltr" else [9, 16])


def test_a_large_job_is_cut_into_blocks(spark):
    pages = 4 * (I.SHEETS_PER_BLOCK + 3)
    for size in (4, pages):  # many small signatures, and one large one
        plan = I.imposition_plan(jobs(spark, (pages, None, size, None, None)), ["job"])
        r = plan.agg(F.count("*").alias("n"), F.countDistinct("page_no").alias("d"), F.max("page_no").alias("m")).first()
        assert (r.n, r.d, r.m) == (pages, pages, pages)


def test_a_bad_request_does_not_stop_the_others(spark):
    top = I.MAX_SHEETS
    got = jobs(spark, (10, 600_000_000, None, None, None), (10, 2**31 - 1, 2**31 - 4, None, None), (10, top, None, None, None),
               (10, None, None, None, None)).orderBy("job").collect()
    assert [(r.pages, r.error) for r in got] == [
        (None, "sheets_too_many"), (None, "sheets_too_many"), (top * 4, None), (16, None)]
