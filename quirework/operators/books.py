"""Book assembly: metadata, slugs, names, sections, documents, styled paragraphs.

A book is ``book_id``; its sections are rows ``(book_id, section_idx, heading, html)``.
Paragraph work stays inside the section row, and only per-book *aggregates* are shuffled.
A whole document is a set of ordered parts, one per section, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .. import settings as S
from ..functions import html as H
from ..functions import merge as M
from ..functions import naming as N
from ..functions import patterns as P
from ..functions.expr import compute, explode_rows, let, let_all, reuse
from ..functions.text import is_scene_break, py_strip
from .html import items_of_tokens, with_tokens
from .observe import counted
from .skew import salted_join, spread_ranks

# --- metadata and names -----------------------------------------------------------


def book_metadata(entries: DataFrame) -> DataFrame:
    """``(book_id, pos, title, creator)`` entries -> first values, stripped, or defaults.

    Only the first entry counts, also when it is empty.
    """

    def first(col, default):
        value = F.min_by(col, "pos")
        return F.when(F.coalesce(value, F.lit("")) != "", py_strip(value)).otherwise(default)

    return entries.groupBy("book_id").agg(
        first("title", P.UNKNOWN_TITLE).alias("detected_title"),
        first("creator", P.UNKNOWN_AUTHOR).alias("detected_author"),
    )


def metadata_override(books: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides ``(book_id, title, author)`` win unless null or empty."""
    return books.join(overrides, "book_id", "left").select(
        "book_id",
        N.or_default(F.col("title"), F.col("detected_title")).alias("used_title"),
        N.or_default(F.col("author"), F.col("detected_author")).alias("used_author"),
    )


def book_slugs(df: DataFrame, keys, title="title", author="author", stem="stem") -> DataFrame:
    return df.select(*keys, N.book_slug(F.col(title), F.col(author), F.col(stem)).alias("slug"))


def slug_collisions(slugs: DataFrame, keys) -> DataFrame:
    """Number of books per slug, put behind each book. A slug may be very frequent; only
    those that occur more than once are copied for the join."""
    counts = slugs.groupBy("slug").agg(F.count(F.lit(1)).alias("n_books")).filter("n_books > 1")
    joined = salted_join(slugs, counts, ["slug"], keys, "left")
    return joined.withColumn("n_books", F.coalesce("n_books", F.lit(1).cast("bigint")))


def unique_slugs(slugs: DataFrame, keys, mark: str = "~") -> DataFrame:
    """A slug of its own for each book: books that share a slug are numbered, and all but the
    first have ``mark`` and their number behind it. No slug holds ``mark``, so a numbered slug
    is never that of another book. The numbers follow a digest of ``keys`` alone, so they don't
    depend on the partitions or on books with other slugs; a slug may be very frequent.
    """
    ranked = spread_ranks(slugs, ["slug"], list(keys), "_rank")
    number = F.when(F.col("_rank") > 1, F.concat(F.lit(mark), F.col("_rank").cast("string"))).otherwise("")
    return ranked.select(*keys, "slug", F.concat("slug", number).alias("unique_slug"))


def output_names(df: DataFrame, keys, slug="slug", sheets="sheets", pages="pages",
                 direction="direction", title="title") -> DataFrame:
    s = F.col(slug)
    return df.select(
        *keys,
        N.output_dir(s).alias("output_dir"),
        N.interior_name(s).alias("interior_pdf"),
        N.editable_name(s).alias("editable_docx"),
        N.markdown_name(s).alias("markdown"),
        N.imposed_name(s, F.col(sheets), F.col(pages)).alias("imposed_pdf"),
        N.imposed_default_name(F.col(title), F.col(pages), F.col(direction)).alias("imposed_default"),
    )


def spacing_label(mode: Column) -> Column:
    key = F.lower(py_strip(N.or_default(mode, S.DEFAULT_SPACING)))
    known = {k: label for k, label, _, _ in S.SPACING_MODES}
    return S.lookup(key, list(known.items()), F.lit(known[S.DEFAULT_SPACING]))


def margin_label(preset: Column) -> Column:
    key = F.lower(py_strip(N.or_default(preset, S.DEFAULT_MARGINS)))
    pairs = [(m[0], m[1]) for m in S.MARGINS] + [("custom", S.CUSTOM_MARGINS_LABEL)]
    return S.lookup(key, pairs, preset)


def page_size_label(preset: Column) -> Column:
    key = F.lower(py_strip(N.or_default(preset, S.DEFAULT_PAGE_SIZE)))
    pairs = [(p[0], p[1]) for p in S.PAGE_SIZES] + [("custom", S.CUSTOM_SIZE_LABEL)]
    return S.lookup(key, pairs, preset)


def variant_label(variant: Column) -> Column:
    return S.lookup(variant, S.VARIANT_LABELS)


def file_stem(author, title, variant, spacing, margin, size) -> Column:
    def unless_default(value, default, label):
        return F.when(
            (F.coalesce(value, F.lit("")) != "") & (value != default), N.safe_component(label)
        )

    return F.concat_ws(
        " - ",
        N.safe_component(author),
        N.safe_component(title),
        N.safe_component(variant_label(variant)),
        unless_default(spacing, S.DEFAULT_SPACING, spacing_label(spacing)),
        unless_default(size, S.DEFAULT_PAGE_SIZE, page_size_label(size)),
        unless_default(margin, S.DEFAULT_MARGINS, margin_label(margin)),
    )


def file_stems(df: DataFrame, keys) -> DataFrame:
    """Needs ``title, author, stem, variant, spacing, margin, size``."""
    named = df.select(
        *keys,
        file_stem(
            N.or_default(F.col("author"), F.col("stem")),
            N.or_default(F.col("title"), F.col("stem")),
            F.col("variant"), F.col("spacing"), F.col("margin"), F.col("size"),
        ).alias("file_stem"),
    )
    return named.select(
        "*",
        F.concat("file_stem", F.lit(" - Interior.pdf")).alias("pdf_name"),
        F.concat("file_stem", F.lit(" - Editable.docx")).alias("docx_name"),
        F.concat("file_stem", F.lit(" - Editable.md")).alias("markdown_name"),
    )


# --- sections ---------------------------------------------------------------------


def section_items(sections: DataFrame, drop_notes: bool = False) -> DataFrame:
    """Sections with their items, cleaned with the default settings. The same for all
    variants, so this runs before they fan out."""
    ts = with_tokens(sections, "html", drop_notes)
    return compute(ts, "items", items_of_tokens()).drop("tokens", "html")


def apply_switches(df: DataFrame) -> DataFrame:
    """Items under the switches in the row's columns."""
    merged = reuse(("switched_items",), _switched_items)
    return compute(df, "items", merged).drop(*S.VARIANT_COLUMNS[2:])


def _switched_items() -> Column:
    c = {name: F.col(name) for name in S.VARIANT_COLUMNS[2:]}
    items = M.filter_scene_breaks(F.col("items"), c["preserve_scene_breaks"])
    items = M.reclean_items(
        items,
        c["join_soft_wrapped_lines"],
        c["join_dialogue_continuations"],
        c["collapse_extra_blank_lines"],
        c["preserve_scene_breaks"],
    )
    return M.merge_items(items, c["merge_dialogue_paragraphs"], c["aggressive_mode"])


#: Switches that change nothing but paragraphs of several lines.
LINE_SWITCHES = ("join_soft_wrapped_lines", "join_dialogue_continuations", "collapse_extra_blank_lines")


def fan_out(base: DataFrame, groups: DataFrame, then=None) -> DataFrame:
    """Every section under every variant.

    ``groups`` comes from ``settings.variant_groups``, a fixed table of a few rows.
    ``then`` is applied before the variants of a group are told apart, so that variants
    with the same switches share its work too. Some switches are about lines within a
    paragraph; groups that differ in these alone are one group for a section without any.
    """
    rest = [c for c in S.VARIANT_COLUMNS[2:] if c not in LINE_SWITCHES]
    # the groups are in one partition, so nothing is shuffled
    joined = groups.coalesce(1).groupBy(*rest).agg(
        F.flatten(F.collect_list("names")).alias("names"), *[F.first(c).alias(c) for c in LINE_SWITCHES])
    ways = groups.withColumn("_lines", F.lit(True)).unionByName(joined.withColumn("_lines", F.lit(False)))
    lines = F.coalesce(F.exists("items", M.has_lines), F.lit(False))
    cleaned = apply_switches(base.withColumn("_lines", lines).join(F.broadcast(ways), "_lines").drop("_lines"))
    done = then(cleaned) if then else cleaned
    rest = [c for c in done.columns if c != "names"]
    return done.select(*rest, F.inline_outer("names"))


def clean_section_text(items: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Text of each section; sections without any are dropped. An ``observation`` counts
    ``sections_cleaned`` and ``sections_dropped`` on the way."""
    texts = compute(items, "text", M.items_text(F.col("items"))).drop("items")
    if observation is not None:
        texts = counted(texts, observation, {
            "sections_cleaned": F.lit(True), "sections_dropped": F.col("text") == ""})
    return texts.filter(F.col("text") != "")


def clean_section_html(items: DataFrame, drop_duplicate_heading: bool = False) -> DataFrame:
    html = H.items_html(F.col("items"))
    if drop_duplicate_heading:
        html = H.strip_duplicate_heading(html, F.col("heading"))
    return compute(items, "html", html).drop("items")


# --- documents --------------------------------------------------------------------


FRONT, END = -1, 2**63 - 1


def section_marks(sections: DataFrame, drop_notes: bool = False, drop_duplicate_heading: bool = False) -> DataFrame:
    """``(book_id, section_idx, filled)`` of raw sections: whether anything is left of a section
    after cleaning, told from its tokens without cleaning it.

    With ``drop_duplicate_heading`` a section may hold nothing but its heading. Only sections
    whose whole text lies within the heading are cleaned to see that.
    """
    filled = reuse(("section_mark", drop_notes, drop_duplicate_heading),
                   lambda: _filled_mark(drop_notes, drop_duplicate_heading))
    return sections.select("book_id", "section_idx", filled.alias("filled"))


def _filled_mark(drop_notes: bool, drop_duplicate_heading: bool) -> Column:
    """One expression over ``html`` and ``heading``, each read once, so that it goes where only the
    books of the sections are wanted."""
    def of_tokens(t: Column, heading: Column) -> Column:
        if not drop_duplicate_heading:
            return H.has_content(t)
        html = H.strip_duplicate_heading(H.items_html(H.raw_items(t)), heading)
        return F.when(H.has_more_than(t, heading), True).otherwise(_visible(html))

    row = {"html": F.col("html"), "heading": F.coalesce("heading", F.lit(""))}
    return let_all(row, lambda v: let(
        H.drop_boilerplate(H.tokens(v["html"]), drop_notes), lambda t: of_tokens(t, v["heading"])))


def _visible(content: Column) -> Column:
    return content.rlike(rf"[^{P.SPACE}]")


def _marks_of(sections: DataFrame, content: str) -> DataFrame:
    return sections.select("book_id", "section_idx", _visible(F.col(content)).alias("filled"))


def _filled(sections: DataFrame, content: str, marks: DataFrame) -> DataFrame:
    """Sections with content, and whether they are the first such one of their book.

    The first index of each book is a narrow aggregate of the marks, joined on the unique
    ``(book_id, section_idx)``: a book with a third of all sections is no hot key.
    """
    filled = sections.filter(_visible(F.col(content)))
    firsts = marks.filter("filled").groupBy("book_id").agg(F.min("section_idx").alias("section_idx"))
    marked = filled.join(firsts.withColumn("_first", F.lit(True)), ["book_id", "section_idx"], "left")
    return marked.withColumn("_first", F.coalesce("_first", F.lit(False)))


def _titled(sections: DataFrame, books: DataFrame) -> DataFrame:
    """Every book that has metadata or a section, with a title and an author."""
    ids = sections.select("book_id").distinct()
    known = books.select("book_id", "used_title", "used_author")
    return ids.join(known, "book_id", "full").select(
        "book_id",
        F.coalesce("used_title", F.lit(P.UNKNOWN_TITLE)).alias("used_title"),
        F.coalesce("used_author", F.lit(P.UNKNOWN_AUTHOR)).alias("used_author"),
    )


def _part(rows: DataFrame, part_no, content: Column, name: str) -> DataFrame:
    number = part_no if isinstance(part_no, Column) else F.lit(part_no)
    return rows.select("book_id", number.cast("bigint").alias("part_no"), content.alias(name))


def section_blocks(cleaned: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Section elements; the first one of a book that is not empty is marked.

    ``marks`` are the ``section_marks`` of the raw sections: with them sections are cleaned
    once. Without them they are derived from ``cleaned``, which is then worked out twice.
    """
    return _filled(cleaned, "html", _marks_of(cleaned, "html") if marks is None else marks).select(
        "book_id", "section_idx", "heading", _section_element().alias("block"))


def _section_element() -> Column:
    css_class = F.when(
        F.col("_first"), "chapter first-body-chapter"
    ).otherwise("chapter")
    h1 = F.when(
        F.col("heading") != "",
        F.concat(F.lit('<h1 class="chapter-title">'), H.escape_html(F.col("heading")), F.lit("</h1>")),
    ).otherwise("")
    return F.concat(
        F.lit('<section class="'), css_class, F.lit('">'), h1, F.col("html"), F.lit("</section>")
    )


# fixed values: selectors and declarations of the print style; $names are filled in per layout
STYLE = (
    ("@page", "size: $width $height; margin-top: $top; margin-bottom: $bottom; "
              "@bottom-center { content: counter(page); font-size: 9pt }"),
    ("@page :right", "margin-left: $inside; margin-right: $outside"),
    ("@page :left", "margin-left: $outside; margin-right: $inside"),
    ("html", "font-size: $font"),
    ("body", "margin: 0; padding: 0; color: #111; font-family: $family; line-height: $line"),
    (".title-page", "break-after: page; min-height: 100%; display: flex; align-items: center; "
                    "justify-content: center; text-align: center"),
    (".title-wrap h1", "margin: 0 0 0.45em 0; font-size: $title; line-height: 1.15"),
    (".title-wrap .author", "margin: 0; font-size: $author"),
    (".blank-page", "break-after: page"),
    (".chapter", "break-before: page"),
    (".first-body-chapter.chapter", "break-before: right"),
    (".chapter-title", "text-align: center; margin: 0 0 1.8em 0; font-size: $heading; page-break-after: avoid"),
    ("p", "margin: 0 0 $gap 0; text-align: justify; text-indent: 0; orphans: 2; widows: 2"),
    (".chapter p + p", "text-indent: $indent"),
    ("h1, h2, h3, h4", "page-break-after: avoid"),
    ("em", "font-style: italic"),
    ("strong", "font-weight: bold"),
    ("hr, .scene-break", "margin: 1.2em auto; width: 25%; border: 0; border-top: 1px solid #666"),
)
# end of fixed values
BOX = ("width", "height", "top", "bottom", "inside", "outside")


def _style_template(font_pt: float, line_height: float, font_family: str) -> str:
    text = "\n".join(f"{selector} {{ {body} }}" for selector, body in STYLE)
    for name, value in (
        ("$font", f"{font_pt}pt"), ("$family", font_family), ("$line", f"{line_height}"),
        ("$title", f"{font_pt * S.TITLE_SCALE:.2f}pt"), ("$author", f"{font_pt * S.AUTHOR_SCALE:.2f}pt"),
        ("$heading", f"{font_pt * S.HEADING_SCALE:.2f}pt"),
    ):
        text = text.replace(name, value)
    return text


def _em(x: float) -> str:
    return f"{x}em" if x else "0"


def stylesheet(mode: str = S.DEFAULT_SPACING, size: str = S.DEFAULT_PAGE_SIZE,
               margin: str = S.DEFAULT_MARGINS, box: dict | None = None, font_pt: float = S.FONT_SIZE_PT,
               line_height: float = S.LINE_HEIGHT, font_family: str = S.FONT_STACK) -> str:
    """Print style of one layout: page box, mirrored margins, breaks, paragraph spacing.

    ``box`` has the centimetres of ``BOX`` for custom sizes or margins."""
    values = dict(zip(BOX, (*next((p[2:] for p in S.PAGE_SIZES if p[0] == size), (None,) * 2),
                            *next((m[2:] for m in S.MARGINS if m[0] == margin), (None,) * 4)), strict=True)) | (box or {})
    if missing := [k for k, v in values.items() if v is None]:
        raise ValueError(f"unknown layout, no {missing}")
    _, _, gap, indent = next((m for m in S.SPACING_MODES if m[0] == mode), S.SPACING_MODES[0])
    css = _style_template(font_pt, line_height, font_family)
    for name, cm in values.items():
        css = css.replace(f"${name}", f"{cm:.3f}cm")
    return css.replace("$gap", _em(gap)).replace("$indent", _em(indent))


def layout_stylesheets(layouts: DataFrame, font_pt: float = S.FONT_SIZE_PT, line_height: float = S.LINE_HEIGHT,
                       font_family: str = S.FONT_STACK) -> DataFrame:
    """``(layout_id, css)`` of accepted layouts, custom sizes and margins included."""
    mode = F.lower(py_strip(N.or_default(F.col("spacing"), S.DEFAULT_SPACING)))
    css = F.lit(_style_template(font_pt, line_height, font_family))
    for name in BOX:
        css = F.replace(css, F.lit(f"${name}"), F.format_string("%.3fcm", f"{name}_cm"))
    for name, k in (("$gap", 2), ("$indent", 3)):
        default = F.lit(_em(S.SPACING_MODES[0][k]))
        css = F.replace(css, F.lit(name), S.lookup(mode, [(m[0], _em(m[k])) for m in S.SPACING_MODES], default))
    return layouts.filter(F.col("status") == "ok").select("layout_id", css.alias("css"))


def html_documents(cleaned: DataFrame, books: DataFrame, css: str, marks: DataFrame | None = None) -> DataFrame:
    """HTML of each book in ordered parts ``(book_id, part_no, html)``. ``marks`` as for
    ``section_blocks``; they have every section of ``cleaned``.

    Part ``FRONT`` is the title page and the blank page, a section's part has the number of
    the section, and part ``END`` closes the document; read in order they are one file. A
    book without any text is its title page; one without metadata has the default title.
    """
    title, author = H.escape_html(F.col("used_title")), H.escape_html(F.col("used_author"))
    head = F.concat(
        F.lit('<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8" />\n<title>'),
        title,
        F.lit(f"</title>\n<style>\n{css}\n</style>\n</head>\n<body>\n"
              '<section class="title-page"><div class="title-wrap"><h1>'),
        title,
        F.lit('</h1><p class="author">'),
        author,
        F.lit('</p></div></section>\n<div class="blank-page"></div>\n'),
    )
    marks = _marks_of(cleaned, "html") if marks is None else marks
    sides = F.array(*[
        F.struct(F.lit(number).cast("bigint").alias("part_no"), content.alias("html"))
        for number, content in ((FRONT, head), (END, F.lit("\n</body>\n</html>\n")))])
    return _titled(marks, books).select("book_id", F.inline(sides)).unionByName(
        _part(_filled(cleaned, "html", marks), F.col("section_idx"), _section_element(), "html"))


def escape_markdown(c: Column) -> Column:
    for mark in ("\\", "*", "_"):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return c


def paragraphs_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), py_strip), lambda p: p != "")


def markdown_documents(texts: DataFrame, books: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Markdown of each book in ordered parts ``(book_id, part_no, markdown)``: the title as
    part ``FRONT``, then the sections. Read in order they are one file, which ends with
    exactly one line end. ``marks`` as for ``section_blocks``."""
    marks = _marks_of(texts, "text") if marks is None else marks
    author = F.when(
        py_strip(F.col("used_author")) != "",
        F.concat(F.lit("\n\n_By "), escape_markdown(F.col("used_author")), F.lit("_")),
    ).otherwise("")
    head = F.concat(F.lit("# "), escape_markdown(F.col("used_title")), author, F.lit("\n"))
    heading = py_strip(F.col("heading"))
    paragraphs = F.transform(
        paragraphs_of(F.col("text")),
        lambda p: F.when(is_scene_break(p), F.lit(P.SCENE_MARK)).otherwise(escape_markdown(p)),
    )
    part = F.concat(
        F.when(F.col("_first"), "\n").otherwise("\n\n"),
        F.when(heading != "", F.concat(F.lit("## "), escape_markdown(heading), F.lit("\n\n"))).otherwise(""),
        F.array_join(paragraphs, "\n\n"),
        F.lit("\n"),
    )
    return _part(_titled(marks, books), FRONT, head, "markdown").unionByName(
        _part(_filled(texts, "text", marks), F.col("section_idx"), part, "markdown"))


# --- styled paragraphs ------------------------------------------------------------


def styled_paragraphs(texts: DataFrame, books: DataFrame, modes: DataFrame,
                      font_pt: float = S.FONT_SIZE_PT, line_height: float = S.LINE_HEIGHT) -> DataFrame:
    """One row per paragraph with its print format, for each spacing mode. Paragraphs of the
    body have a line spacing; the page box comes from ``page_setup``.

    The first paragraph of a section and the first after a scene break are not indented.
    ``para_idx`` -1 is a section's heading; the title and author rows of a book have
    ``section_idx`` -1.
    """
    modes = F.broadcast(modes.select(F.col("key").alias("mode"), "gap", "indent"))

    def pt(scale):
        return F.round(F.lit(float(font_pt)) * scale, 3)

    def fmt(role, text, align, size, bold, before, after, indent, line=None):
        return F.struct(
            F.lit(role).alias("role"), text.alias("text"), F.lit(align).alias("align"),
            pt(F.lit(size)).alias("font_pt"), F.lit(bold).alias("bold"), pt(before).alias("before_pt"),
            pt(after).alias("after_pt"), pt(indent).alias("indent_pt"),
            F.lit(line).cast("double").alias("line_spacing"),
        )

    zero = F.lit(0.0)

    def rows(p, heading):
        def one(x, i):
            starts = (i == 0) | is_scene_break(F.get(p, i - 1))
            return fmt_row(i, F.when(
                is_scene_break(x),
                fmt("scene", F.lit(P.SCENE_MARK), "center", 1.0, False,
                    F.lit(S.SCENE_SPACE), F.lit(S.SCENE_SPACE), zero),
            ).otherwise(
                fmt("body", x, "justify", 1.0, False, zero, F.col("gap"),
                    F.when(starts, 0.0).otherwise(F.col("indent")), line_height)
            ))

        head = fmt_row(F.lit(-1), fmt("heading", heading, "center", S.HEADING_SCALE, True, zero,
                                      F.lit(S.HEADING_SPACE), zero))
        body = F.transform(p, one)
        return F.when(heading != "", F.concat(F.array(head), body)).otherwise(body)

    def fmt_row(idx, f):
        return F.struct(idx.alias("para_idx"), f.alias("f"))

    per_mode = texts.withColumn("paras", paragraphs_of(F.col("text"))).drop("text").crossJoin(modes)
    body = explode_rows(
        per_mode.withColumn("section_idx", F.col("section_idx").cast("bigint")),
        ["book_id", "mode", "section_idx"],
        rows(F.col("paras"), py_strip(F.col("heading"))),
        "_row", {"para_idx": lambda r: r["para_idx"], "f": lambda r: r["f"]},
    ).drop("_row")
    front = F.array(
        fmt("title", F.col("used_title"), "center", S.TITLE_SCALE, True, zero, zero, zero),
        fmt("author", F.col("used_author"), "center", S.AUTHOR_SCALE, False, zero, zero, zero),
    )
    titles = books.crossJoin(modes).select(
        "book_id", "mode", F.lit(-1).cast("bigint").alias("section_idx"),
        F.posexplode(front).alias("para_idx", "f"),
    ).filter((F.col("f.role") != "author") | (py_strip(F.col("f.text")) != ""))
    return body.unionByName(titles).select(
        "book_id", "mode", "section_idx", "para_idx", "f.*"
    )


def page_setup(layouts: DataFrame) -> DataFrame:
    """Page box of accepted layouts for the styled paragraphs: left is the inside margin."""
    return layouts.filter(F.col("status") == "ok").select(
        "layout_id", "width_cm", "height_cm", "top_cm", "bottom_cm",
        F.col("inside_cm").alias("left_cm"), F.col("outside_cm").alias("right_cm"),
        F.lit(0.8).alias("footer_distance_cm"),
    )
