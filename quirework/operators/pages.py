"""Page breaks by line filling, page numbers, and which sheets hold a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions import typeset as Y
from ..functions.expr import compute, let
from ..functions.naming import or_default
from ..functions.text import py_strip
from .layout import by_layout, wanted_capacities, with_capacity, with_capacity_lists
from .skew import running_totals, salted_join

#: What decides the breaks of a section: thousandths of the font size, lines, hundredths of a line.
BOX = ("measure", "heading_measure", "lines_per_page", "gap_hundredths", "indent")
#: Title page and blank page.
FRONT_PAGES = 2
#: Pages of one bin when ranges of pages meet pages.
BIN_PAGES = 64


def with_measure(layouts: DataFrame, font_pt: float = S.FONT_SIZE_PT,
                 line_height: float = S.LINE_HEIGHT) -> DataFrame:
    """Resolved layouts with the columns of ``BOX``."""
    width = (F.col("width_cm") - F.col("inside_cm") - F.col("outside_cm")) * S.POINTS_PER_CM
    mode = F.lower(py_strip(or_default(F.col("spacing"), S.DEFAULT_SPACING)))
    indents = [(m[0], F.lit(round(m[3] * 1000))) for m in S.SPACING_MODES]
    known = S.lookup(mode, indents, F.lit(round(S.SPACING_MODES[0][3] * 1000)))
    return (
        with_capacity(layouts, font_pt, line_height)
        .withColumn("measure", F.greatest(F.floor(width * 1000 / font_pt), F.lit(1)))
        .withColumn("heading_measure", F.greatest(F.floor(width * 1000 / (font_pt * S.HEADING_SCALE)), F.lit(1)))
        .withColumn("indent", known.cast("bigint"))
    )


def _texts() -> Column:
    """Texts of the paragraphs, null for scene breaks."""
    return F.transform("items", lambda x: F.when(x["kind"] != "scene", x["text"]))


def _follows() -> Column:
    """Whether the item before is a paragraph too, which is what indents a paragraph."""
    return let(F.col("items"), lambda items: F.transform(
        items, lambda x, i: F.coalesce(F.get(items, i - 1)["kind"] == "p", F.lit(False))))


def _blocks() -> Column:
    return F.transform("_lines.counts", lambda n: F.struct(
        F.when(n < 0, F.lit(Y.SCENE_HEIGHT)).otherwise(0).alias("height"), F.greatest(n, F.lit(0)).alias("n")))


def _heading_height() -> Column:
    """Hundredths of a line of a heading and the space behind it; 0 without one."""
    scale = S.HEADING_SCALE * 100
    lines = F.col("_lines.heading")
    return F.when(lines > 0, F.round(lines * scale + S.HEADING_SPACE * scale).cast("bigint")).otherwise(
        F.lit(0).cast("bigint"))


def section_starts(sections: DataFrame, wanted: DataFrame, layouts: DataFrame) -> DataFrame:
    """Sections ``(book_id, section_idx, heading, items)`` -> ``(book_id, *BOX, section_idx, starts)``:
    where the pages of a section begin, once for each different box that its book is wanted in.

    Words are measured once for all boxes of a section, in Arrow batches; lines are then put on
    pages box by box. Sections without items have no pages.
    """
    some = sections.filter(F.size("items") > 0)
    texts = compute(some, "_m", F.struct(_texts().alias("texts"), _follows().alias("follows")))
    measured = texts.select("book_id", "section_idx", F.coalesce("heading", F.lit("")).alias("heading"), "_m.*")
    boxed = with_capacity_lists(measured, wanted_capacities(wanted, layouts, BOX), BOX)
    sizes = F.transform("_caps", lambda c: F.struct(
        *[c[name].cast("bigint").alias(name) for name in ("measure", "heading_measure", "indent")]))
    filled = Y.with_section_lines(
        boxed, ["book_id", "section_idx", "_caps"], [F.col("texts"), F.col("follows"), F.col("heading"), sizes], "_filled")
    each = filled.select("book_id", "section_idx", F.inline(F.arrays_zip(F.col("_caps").alias("_cap"), F.col("_filled").alias("_lines"))))
    lines = compute(each.select("book_id", "section_idx", "_cap.*", "_lines"), "_b",
                    F.struct(_blocks().alias("blocks"), _heading_height().alias("top")))
    blocks, page = F.col("_b.blocks"), F.col("lines_per_page").cast("int")
    marks = compute(lines, "marks", Y.page_marks(blocks, page, F.col("gap_hundredths"), F.col("_b.top")))
    starts = compute(marks, "starts", Y.page_starts(blocks, F.col("marks"), page))
    return starts.select("book_id", *BOX, "section_idx", "starts")


def numbered_starts(starts: DataFrame) -> DataFrame:
    """Adds ``before``: the pages of the book before each section, front pages included. Sections
    begin on a new page. No group holds more of a book than a block of its sections."""
    pages = F.size("starts").cast("bigint")
    totals = running_totals(starts, ["book_id", *BOX], "section_idx", pages, "before")
    return totals.withColumns({"before": F.col("before") + FRONT_PAGES, "pages": pages})


def page_breaks(sections: DataFrame, wanted: DataFrame, layouts: DataFrame) -> DataFrame:
    """``(book_id, layout_id, section_idx, page, first_paragraph, first_line)``: what every page
    of a book begins with. Paragraphs are items of the section, lines are lines of the paragraph,
    both from 0; a page that begins with paragraph 0, line 0 begins with the section's heading."""
    pairs = wanted_capacities(wanted, layouts, BOX)
    numbered = by_layout(numbered_starts(section_starts(sections, wanted, layouts)), pairs, BOX)
    each = numbered.select("book_id", "layout_id", "section_idx", "before", F.explode("starts").alias("s"))
    return each.select("book_id", "layout_id", "section_idx", (F.col("before") + F.col("s.page")).alias("page"),
                       "s.first_paragraph", "s.first_line")


def section_pages(sections: DataFrame, wanted: DataFrame, layouts: DataFrame) -> DataFrame:
    """``(book_id, layout_id, section_idx, first_page, last_page)``."""
    pairs = wanted_capacities(wanted, layouts, BOX)
    numbered = by_layout(numbered_starts(section_starts(sections, wanted, layouts)), pairs, BOX)
    return numbered.select("book_id", "layout_id", "section_idx", (F.col("before") + 1).alias("first_page"),
                           (F.col("before") + F.col("pages")).alias("last_page"))


def book_pages(ranges: DataFrame) -> DataFrame:
    """``(book_id, layout_id, pages)`` from the ranges of ``section_pages``."""
    return ranges.groupBy("book_id", "layout_id").agg(F.max("last_page").alias("pages"))


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, first: str,
                     last: str, width: int = BIN_PAGES) -> DataFrame:
    """Pairs of a point and a range that holds it, with equal ``keys``.

    Both are dealt to bins of ``width`` and joined by key and bin, so the join is an equi-join
    and a key with very many points or a very long range is spread over its bins.
    """
    binned = ranges.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    dealt = points.withColumn("_bin", F.floor(F.col(point) / width))
    met = dealt.join(binned, [*keys, "_bin"])
    return met.filter((F.col(point) >= F.col(first)) & (F.col(point) <= F.col(last))).drop("_bin")


def section_sheets(ranges: DataFrame, plan: DataFrame, width: int = BIN_PAGES) -> DataFrame:
    """``(book_id, layout_id, section_idx, signature_no, sheet_no, side)``: the sides of the sheets
    that hold pages of a section. ``ranges`` come from ``section_pages``, ``plan`` is an imposition
    plan by book and layout, in either direction or of one's own."""
    keys = ["book_id", "layout_id"]
    slots = plan.select(*keys, "signature_no", "sheet_no", "side", "page_no")
    met = points_in_ranges(slots, ranges, keys, "page_no", "first_page", "last_page", width)
    # the two pages of a side that belong to one section
    return met.select(*keys, "section_idx", "signature_no", "sheet_no", "side").distinct()


def imposition_jobs(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Specs of a book, put behind each of its layouts with that layout's pages."""
    return salted_join(pages.withColumnRenamed("pages", "total_pages"), specs, ["book_id"], ["layout_id"])
