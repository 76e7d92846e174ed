"""Folded signatures: which page goes where on which sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions.naming import or_default
from ..functions.text import py_strip

# Sheets handled by one task row when a plan is spelled out.
SHEETS_PER_BLOCK = 65536
# Page numbers of one signature fit an int.
MAX_SHEETS = (2**31 - 1) // 4


def signature_spec(requests: DataFrame) -> DataFrame:
    """Requests ``(..., sheets, pages, max_end_padding, direction)`` -> resolved or rejected.

    Sheets and pages must agree when both are given; neither means the default.
    """
    sheets, pages = F.col("sheets").cast("bigint"), F.col("pages").cast("bigint")
    direction = F.lower(py_strip(or_default(F.col("direction"), "ltr")))
    error = (
        F.when(sheets.isNotNull() & (sheets <= 0), "sheets_not_positive")
        .when(sheets > MAX_SHEETS, "sheets_too_many")
        .when(sheets.isNotNull() & pages.isNotNull() & (pages != sheets * 4), "sheets_pages_conflict")
        .when(sheets.isNull() & pages.isNotNull() & ((pages <= 0) | (pages % 4 != 0)), "pages_not_multiple_of_4")
        .when(~direction.isin("ltr", "rtl"), "unknown_direction")
        .when(F.col("max_end_padding") < 0, "negative_padding")
    )
    rest = [c for c in requests.columns if c not in ("sheets", "pages", "max_end_padding", "direction")]
    ok = F.col("error").isNull()
    resolved = F.coalesce(sheets, F.floor(pages / 4), F.lit(S.DEFAULT_SHEETS).cast("bigint"))
    return requests.withColumn("error", error).select(
        *rest,
        F.when(ok, resolved).cast("int").alias("sheets"),
        F.when(ok, resolved * 4).cast("int").alias("pages"),
        F.col("max_end_padding"),
        F.when(ok, direction).alias("direction"),
        F.when(ok, "ok").otherwise("rejected").alias("status"),
        "error",
    )


def signature_padding(specs: DataFrame) -> DataFrame:
    """Adds padded size, blanks and signatures to specs with ``total_pages``; may reject."""
    total, per = F.col("total_pages").cast("bigint"), F.col("pages").cast("bigint")
    padded = F.floor((total + per - 1) / per) * per
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(total <= 0, "no_pages")
        .when(F.col("max_end_padding").isNotNull() & (padded - total > F.col("max_end_padding")),
              "too_much_padding")
    )
    ok = F.col("error").isNull()
    return (
        specs.withColumn("_padded", padded)
        .withColumn("error", error)
        .withColumn("padded_pages", F.when(ok, F.col("_padded")))
        .withColumn("blank_pages", F.when(ok, F.col("_padded") - total))
        .withColumn("signatures", F.when(ok, F.floor(F.col("_padded") / per)))
        .withColumn("status", F.when(ok, "ok").otherwise("rejected"))
        .drop("_padded")
    )


def sheet_sides(pages: Column, k: Column) -> Column:
    """The two sides of sheet ``k`` (from 0, outermost first) of a signature, as an array of
    ``(sheet_no, side, left_page, right_page)``.

    Sheet k from the outside carries the k-th pair of pages counted from both ends.
    """
    return F.array(
        F.struct((k + 1).alias("sheet_no"), F.lit("front").alias("side"),
                 (pages - k * 2).alias("left_page"), (k * 2 + 1).alias("right_page")),
        F.struct((k + 1).alias("sheet_no"), F.lit("back").alias("side"),
                 (k * 2 + 2).alias("left_page"), (pages - k * 2 - 1).alias("right_page")),
    )


def with_sheets(df: DataFrame, n_sheets: Column, keys) -> DataFrame:
    """One row per sheet ``_sheet`` (from 0). Blocks of sheets are spread over the cluster
    first, so neither a large signature nor a job with most pages ends up in one cell or task."""
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n_sheets - 1) / SHEETS_PER_BLOCK)))
    blocks = df.withColumn("_n", n_sheets).withColumn("_block", block).repartition(*keys, "_block")
    start = F.col("_block") * SHEETS_PER_BLOCK
    last = F.least(start + SHEETS_PER_BLOCK, F.col("_n")) - 1
    return blocks.withColumn("_sheet", F.explode(F.sequence(start, last))).drop("_n", "_block")


def sheet_pairs(sizes: DataFrame, keys, pages: str = "pages") -> DataFrame:
    """Sheet sides for each signature size. A size that is no positive multiple of 4 is one
    row with ``status`` rejected and its ``error``."""
    p = F.col(pages)
    error = F.when(p.isNull(), "no_pages").when(p <= 0, "pages_not_positive").when(p % 4 != 0, "pages_not_multiple_of_4")
    checked = sizes.withColumn("error", error)
    sheets = with_sheets(checked.filter("error IS NULL"), F.floor(p / 4), keys)
    sides = sheets.select(*keys, pages, F.inline(sheet_sides(p, F.col("_sheet").cast("int"))), F.lit("ok").alias("status"), "error")
    bad = checked.filter("error IS NOT NULL").withColumn("status", F.lit("rejected"))
    return sides.unionByName(bad.select(*keys, pages, "status", "error"), allowMissingColumns=True)


def imposition_plan(jobs: DataFrame, keys) -> DataFrame:
    """Every slot of accepted jobs: signature, sheet, side, position and page number.

    A slot is blank when its page lies behind the last one: that needs no lookup of pages.
    """
    ok = jobs.filter(F.col("status") == "ok").select(*keys, "sheets", "pages", "total_pages", "signatures", "direction")
    each = with_sheets(ok, F.col("signatures") * F.col("sheets"), keys)
    each = each.withColumn("_sig", F.floor(F.col("_sheet") / F.col("sheets")))
    k = F.pmod(F.col("_sheet"), F.col("sheets").cast("bigint")).cast("int")
    sides = each.select("*", F.inline(sheet_sides(F.col("pages").cast("int"), k)))
    swap = F.col("direction") == "rtl"
    offset = F.col("_sig") * F.col("pages")
    return sides.select(
        *keys,
        (F.col("_sig") + 1).alias("signature_no"),
        "sheet_no",
        "side",
        "total_pages",
        F.explode(
            F.array(
                F.struct(F.lit("left").alias("position"),
                         (offset + F.when(swap, F.col("right_page")).otherwise(F.col("left_page"))).alias("page_no")),
                F.struct(F.lit("right").alias("position"),
                         (offset + F.when(swap, F.col("left_page")).otherwise(F.col("right_page"))).alias("page_no")),
            )
        ).alias("s"),
    ).select(
        *keys, "signature_no", "sheet_no", "side", "s.position", "s.page_no",
        (F.col("s.page_no") > F.col("total_pages")).alias("is_blank"),
    )


def placed_pages(plan: DataFrame, jobs: DataFrame, keys) -> DataFrame:
    """Per accepted job: whether its plan holds every page exactly once.

    Pages are counted and summed (also their squares) where the slots are; no page is looked
    up, so only one row per job and task is shuffled.
    """
    n, page = F.col("total_pages").cast("decimal(38,0)"), F.col("page_no").cast("decimal(38,0)")
    slots = plan.filter(~F.col("is_blank")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages_placed"), F.sum(page).alias("_sum"), F.sum(page * page).alias("_squares"))
    whole = jobs.filter(F.col("status") == "ok").select(*keys, "total_pages").join(slots, keys, "left")
    right = (
        (F.col("pages_placed") == F.col("total_pages")) & (F.col("_sum") * 2 == n * (n + 1))
        & (F.col("_squares") * 6 == n * (n + 1) * (n * 2 + 1))
    )
    return whole.select(*keys, "total_pages", F.coalesce("pages_placed", F.lit(0)).alias("pages_placed"),
                        (~F.coalesce(right, F.lit(False))).alias("misplaced"))


def imposition_summary(jobs: DataFrame, keys) -> DataFrame:
    """Counts per job. They follow from the job alone; no slot is spelled out."""
    return jobs.filter(F.col("status") == "ok").select(
        *keys,
        F.col("total_pages").alias("input_pages"),
        F.col("blank_pages").alias("blank_pages_added"),
        (F.col("signatures") * F.col("sheets") * 2).alias("sheet_sides"),
        (F.col("signatures") * F.col("sheets")).alias("physical_sheets"),
        F.col("signatures").alias("total_signatures"),
    )
