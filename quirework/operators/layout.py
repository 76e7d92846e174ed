"""Layouts and page estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions.naming import or_default
from ..functions.text import py_strip
from .skew import salted_join

CUSTOM_COLUMNS = ("custom_width", "custom_height", "custom_top", "custom_bottom",
                  "custom_inside", "custom_outside")


def resolve_layouts(requests: DataFrame) -> DataFrame:
    """Requests ``(layout_id, spacing, margin, size, custom_*)`` -> page box, or an error.

    The presets are fixed tables of a few rows and are broadcast.
    """
    spark = requests.sparkSession

    def key(name, default):
        return F.lower(py_strip(or_default(F.col(name), default)))

    sizes = F.broadcast(S.page_sizes(spark).select(
        F.col("key").alias("_size"), F.col("width_cm").alias("_w"), F.col("height_cm").alias("_h")))
    margins = F.broadcast(S.margins(spark).select(
        F.col("key").alias("_margin"), F.col("top").alias("_t"), F.col("bottom").alias("_b"),
        F.col("inside").alias("_i"), F.col("outside").alias("_o")))
    joined = (
        requests.withColumn("_size", key("size", S.DEFAULT_PAGE_SIZE))
        .withColumn("_margin", key("margin", S.DEFAULT_MARGINS))
        .join(sizes, "_size", "left")
        .join(margins, "_margin", "left")
    )

    def none_given(*names):
        test = F.lit(False)
        for n in names:
            test = test | F.col(n).isNull()
        return test

    def not_positive(*names):
        test = F.lit(False)
        for n in names:
            test = test | (F.col(n) <= 0)
        return test

    own_size, own_margin = F.col("_size") == "custom", F.col("_margin") == "custom"
    box, edges = CUSTOM_COLUMNS[:2], CUSTOM_COLUMNS[2:]
    error = (
        F.when(own_size & none_given(*box), "custom_size_missing")
        .when(own_size & not_positive(*box), "custom_size_not_positive")
        .when(~own_size & F.col("_w").isNull(), "unknown_page_size")
        .when(own_margin & none_given(*edges), "custom_margins_missing")
        .when(own_margin & not_positive(*edges), "custom_margins_not_positive")
        .when(~own_margin & F.col("_t").isNull(), "unknown_margins")
    )
    checked = joined.withColumn("error", error)
    ok = F.col("error").isNull()

    def value(custom, preset, own):
        return F.when(ok, F.when(own, F.col(custom)).otherwise(F.col(preset)))

    return checked.select(
        "layout_id", "spacing", "margin", "size",
        value("custom_width", "_w", own_size).alias("width_cm"),
        value("custom_height", "_h", own_size).alias("height_cm"),
        value("custom_top", "_t", own_margin).alias("top_cm"),
        value("custom_bottom", "_b", own_margin).alias("bottom_cm"),
        value("custom_inside", "_i", own_margin).alias("inside_cm"),
        value("custom_outside", "_o", own_margin).alias("outside_cm"),
        F.when(ok, "ok").otherwise("rejected").alias("status"),
        "error",
    )


def with_capacity(layouts: DataFrame, font_pt: float = S.FONT_SIZE_PT,
                  line_height: float = S.LINE_HEIGHT) -> DataFrame:
    """Characters per line, lines per page, and hundredths of a line per paragraph gap."""
    width = (F.col("width_cm") - F.col("inside_cm") - F.col("outside_cm")) * S.POINTS_PER_CM
    height = (F.col("height_cm") - F.col("top_cm") - F.col("bottom_cm")) * S.POINTS_PER_CM
    mode = F.lower(py_strip(or_default(F.col("spacing"), S.DEFAULT_SPACING)))
    no_gap = [m[0] for m in S.SPACING_MODES if m[2] == 0.0]
    return (
        layouts.withColumn("chars_per_line", F.greatest(F.floor(width / (0.5 * font_pt)), F.lit(1)))
        .withColumn("lines_per_page", F.greatest(F.floor(height / (font_pt * line_height)), F.lit(1)))
        .withColumn("gap_hundredths", F.when(mode.isin(*no_gap), 0).otherwise(65))
    )


def section_pages(text_lengths: Column) -> Column:
    """Estimated pages of one section from its paragraph lengths (whole-number arithmetic)."""
    cpl, lpp = F.col("chars_per_line"), F.col("lines_per_page")
    hundredths = F.aggregate(
        text_lengths,
        F.lit(0).cast("bigint"),
        lambda acc, n: acc + F.floor((n + cpl - 1) / cpl) * 100 + F.col("gap_hundredths"),
    )
    return F.ceil(hundredths / (lpp * 100))


CAPACITY = ("chars_per_line", "lines_per_page", "gap_hundredths")


def wanted_capacities(wanted: DataFrame, layouts: DataFrame, columns=CAPACITY) -> DataFrame:
    """``(book_id, layout_id)`` pairs with the capacity of each accepted layout."""
    own = layouts.filter(F.col("status") == "ok").select("layout_id", *columns)
    return wanted.select("book_id", "layout_id").join(own, "layout_id")


def with_capacities(sections: DataFrame, pairs: DataFrame, columns=CAPACITY) -> DataFrame:
    """Every section once per different capacity that its book is wanted in.

    Layouts of one capacity give the same pages, so the work follows the capacities, not the
    layouts."""
    joined = with_capacity_lists(sections, pairs, columns)
    return joined.withColumn("_cap", F.explode("_caps")).select(*sections.columns, "_cap.*")


def with_capacity_lists(sections: DataFrame, pairs: DataFrame, columns=CAPACITY) -> DataFrame:
    """Every section with ``_caps``, the different capacities that its book is wanted in. The lists
    are joined by book, with the sections of a large book spread."""
    lists = pairs.groupBy("book_id").agg(F.collect_set(F.struct(*columns)).alias("_caps"))
    return salted_join(sections, lists, ["book_id"], ["section_idx"])


def by_layout(pages: DataFrame, pairs: DataFrame, columns=CAPACITY) -> DataFrame:
    """Rows per book and capacity -> rows per book and wanted layout."""
    return pages.join(pairs, ["book_id", *columns]).drop(*columns)


def page_estimate(sections: DataFrame, wanted: DataFrame, layouts: DataFrame) -> DataFrame:
    """Pages per book and layout. ``sections`` holds items, ``wanted`` the ``(book_id,
    layout_id)`` pairs, ``layouts`` the capacities.

    Each section starts a new page, and a title page and a blank page come first. Items
    are reduced to their lengths before the layouts fan out; a book's sections meet only
    as partial sums.
    """
    lengths = sections.select(
        "book_id", "section_idx", F.transform("items", lambda x: F.length(x["text"])).alias("lens")
    ).filter(F.size("lens") > 0)
    pairs = wanted_capacities(wanted, layouts)
    pages = (
        with_capacities(lengths, pairs)
        .select("book_id", *CAPACITY, section_pages(F.col("lens")).alias("p"))
        .groupBy("book_id", *CAPACITY)
        .agg((F.sum("p") + 2).alias("pages"), F.count(F.lit(1)).alias("sections"))
    )
    return by_layout(pages, pairs).select("book_id", "layout_id", "pages", "sections")
