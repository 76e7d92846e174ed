"""Inputs that Spark derives from the given tables.

The raw tables hardly trigger the cleanup rules, so each registered query runs on whole
tables in which every row was rewritten by a fixed rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.html import escape_html
from ..sources.tables import bound_batches, read_table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages")


def first_line() -> Column:
    return F.substring_index("text", "\n", 1)


def _with_text(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    return df.select("doc_id", *keep, text.alias("text"))


def _rep(c: Column, old: str, new) -> Column:
    return F.replace(c, F.lit(old), new if isinstance(new, Column) else F.lit(new))


def soft_wrapped(spark, folder) -> DataFrame:
    """A line break after every comma."""
    return _with_text(documents(spark, folder), _rep(F.col("text"), ", ", ",\n"), "source")


def noisy(spark, folder) -> DataFrame:
    """CRLF, no-break spaces, tabs or many blank lines, by document."""
    t, k = F.col("text"), F.col("doc_id") % 4
    text = (
        F.when(k == 0, _rep(t, "\n", "\r\n"))
        .when(k == 1, _rep(t, ", ", ",\u00a0"))
        .when(k == 2, _rep(t, ". ", ".\t  "))
        .otherwise(_rep(t, "\n", "\n\n\n\n"))
    )
    return _with_text(documents(spark, folder), text)


SEPARATORS = ("* * *", "***", "####", "---", "----", "~ ~ ~", "- -")


def scened(spark, folder, attached: bool = False) -> DataFrame:
    """A separator line after every sentence, of a kind that depends on the document.

    Unless attached, blank lines surround it."""
    marks = F.element_at(F.array(*[F.lit(s) for s in SEPARATORS]), (F.col("doc_id") % 7 + 1).cast("int"))
    text = _rep(F.col("text"), ". ", F.concat(F.lit(".\n"), marks, F.lit("\n")))
    if not attached:
        text = _rep(text, "\n", "\n\n")
    return _with_text(documents(spark, folder), text)


def dialogue_line(line: Column, i: Column) -> Column:
    return (
        F.when(i % 10 == 8, F.concat(F.lit('"'), F.rtrim(line, F.lit("."))))
        .when(i % 5 == 1, F.concat(F.lit('"'), F.rtrim(line, F.lit(".")), F.lit(',"')))
        .when(i % 5 == 2, F.concat(F.lit("she said "), F.lower(line)))
        .when(i % 5 == 4, F.rtrim(line, F.lit(".")))
        .when((i % 5 == 0) & (i > 0), F.lower(line))
        .otherwise(line)
    )


def dialogue(spark, folder, *keep: str) -> DataFrame:
    """Lines turned into split dialogue, by their position."""
    text = F.array_join(F.transform(F.split("text", "\n"), dialogue_line), "\n")
    return _with_text(documents(spark, folder), text, *keep)


def mixed(spark, folder) -> DataFrame:
    """Everything at once: dialogue, soft wraps, scene lines, CRLF, blanks, no-break spaces."""
    def line(x, i):
        wrapped = _rep(dialogue_line(x, i), ", ", ",\n")
        return F.concat(
            F.lit("  "), wrapped,
            F.when(i % 7 == 3, "\r\n* * *").when(i % 7 == 5, "\n\n\n\n---\n\n").when(i % 7 == 6, " \t \n \n").otherwise(""),
        )
    return _with_text(documents(spark, folder), F.array_join(F.transform(F.split("text", "\n"), line), "\r\n"))


# --- pages ------------------------------------------------------------------------


def rich_pages(spark, folder) -> DataFrame:
    """Pages with nested notes, rules between paragraphs, and a download list."""
    p = F.col("page_id").cast("string")
    html = _rep(F.col("html"), "<article>",
                '<article><div class="notes x"><div><p>Note.</p></div></div>')
    html = F.when(F.col("page_id") % 3 == 0, _rep(html, "</p><p>", "</p><hr/><hr/><p>")).otherwise(html)
    links = F.concat(
        F.lit('<ul class="download"><li><a href="/d/'), p, F.lit('.epub">EPUB</a></li><li><a href="../d/'),
        p, F.lit('.pdf">PDF</a></li><li><a href="?get=azw3">Kindle</a></li></ul>'),
    )
    return pages(spark, folder).select(
        "page_id", "url", _rep(html, "<footer>", F.concat(links, F.lit("<footer>"))).alias("html")
    )


def titled_pages(spark, folder) -> DataFrame:
    """Pages with title, byline and meta title, each on some of them."""
    i = F.col("page_id")
    html = F.col("html")
    html = F.when(
        i % 2 == 0,
        _rep(_rep(html, "<h1>", '<h2 class="title heading">'), "</h1>", "</h2>"),
    ).otherwise(html)
    byline = F.concat(
        F.lit('<h3 class="byline heading"><a rel="author" href="#">A'), (i % 17).cast("string"), F.lit("</a></h3>")
    )
    html = F.when(i % 3 > 0, _rep(html, "<article>", F.concat(F.lit("<article><h2> </h2>"), byline))).otherwise(html)
    meta = F.concat(F.lit('<meta property="og:title" content=" Page '), i.cast("string"), F.lit(' &amp; more"></head>'))
    html = F.when(i % 5 == 0, _rep(html, "</head>", meta)).otherwise(html)
    return pages(spark, folder).select("page_id", "url", html.alias("html"))


def hard_pages(spark, folder) -> DataFrame:
    """Pages with a body tag in a comment and ``>`` in an attribute of the real one."""
    i = F.col("page_id")
    html = F.when(i % 4 == 0, _rep(F.col("html"), "<body>", '<!-- <body>no</body> --><body data-x="a>b" class=y>')).when(
        i % 4 == 1, _rep(F.col("html"), "<body>", "<BODY\n>")).otherwise(F.col("html"))
    return pages(spark, folder).select("page_id", "url", html.alias("html"))


def hard_headings(spark, folder) -> DataFrame:
    """Titled pages with headings in comments, before and inside the article."""
    html = _rep(F.col("html"), "<article>", "<!-- <h1>Old</h1> --><article><!--<h2>Older</h2>-->")
    return titled_pages(spark, folder).select(
        "page_id", "url", F.when(F.col("page_id") % 4 < 2, html).otherwise(F.col("html")).alias("html"))


def hard_titles(spark, folder) -> DataFrame:
    """Titled pages in other quotings and orders of attributes, with near misses around."""
    i, html = F.col("page_id"), F.col("html")
    decoy = ('<!-- <h2 class="title heading">Old</h2> --><h2 class="page-title heading">Wrong</h2>'
             '<h3 title=" class=byline heading" class="heading"><a rel="author">Wrong</a></h3><article>')
    html = F.when(i % 4 < 3, _rep(html, "<article>", decoy)).otherwise(html)
    single = _rep(_rep(html, 'class="title heading"', "class = 'heading  title'"), 'rel="author" href="#"', "href='#' rel='nofollow author'")
    single = _rep(single, 'class="byline heading"', "id=b class='x byline heading'")
    single = F.regexp_replace(single, '<meta property="og:title" content="([^"]*)">', "<meta content='$1' property=og:title>")
    return titled_pages(spark, folder).select("page_id", "url", F.when(i % 2 == 0, single).otherwise(html).alias("html"))


def hard_links(spark, folder) -> DataFrame:
    """Rich pages whose links stand in other quotings, next to attributes that look like links."""
    i, html = F.col("page_id"), F.col("html")
    bare = F.regexp_replace(html, '<a href="(/d/[^"]*)">', "<a title=' href=/no.epub ' href=$1>")
    single = F.regexp_replace(html, '<a href="([^"]*)">', "<A data-href=x HREF = '$1'>")
    return rich_pages(spark, folder).select(
        "page_id", "url", F.when(i % 4 == 1, bare).when(i % 4 == 2, single).otherwise(html).alias("html"))


def cdata_pages(spark, folder) -> DataFrame:
    """Rich pages with a CDATA section in a paragraph."""
    more = "<p>x <![CDATA[b > &amp; <i>c]]> d</p></article>"
    return rich_pages(spark, folder).select(
        "page_id", "url", F.when(F.col("page_id") % 5 == 0, _rep(F.col("html"), "</article>", more)).otherwise(F.col("html")).alias("html"))


def work_urls(spark, folder) -> DataFrame:
    """Chapter addresses of a few works; every seventh names no work."""
    i = F.col("page_id")
    url = F.when(i % 7 == 0, F.col("url")).otherwise(
        F.concat(
            F.when(i % 2 == 0, "HTTPS://host.example").when(i % 3 == 0, "//host.example").otherwise(""),
            F.lit("/works/"), (i % 40).cast("string"), F.lit("/chapters/"), i.cast("string"), F.lit("?view=1#x"),
        )
    )
    return pages(spark, folder).select("page_id", url.alias("url"))


# --- books ------------------------------------------------------------------------


def book_sections(spark, folder) -> DataFrame:
    """A book per source, a section per document, its lines as HTML paragraphs."""
    heading = first_line()
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(
            F.lit("<p>"), escape_html(_rep(dialogue_line(x, i), ", ", ",\n")), F.lit("</p>"),
            F.when(i % 7 == 6, "<hr/><hr/>").otherwise(""), F.lit("\n"),
        ),
    )
    repeated = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit("<p>"), escape_html(_rep(F.lower(heading), " ", "  ")), F.lit("</p>\n")),
    ).otherwise("")
    notes = F.when(F.col("doc_id") % 9 == 0, '<div class="notes"><p>Note</p></div>').otherwise("")
    html = F.concat(
        F.lit('<div class="userstuff">'), repeated, F.array_join(lines, ""),
        F.lit("</div><nav><p>skip</p></nav>"), notes,
    )
    return documents(spark, folder).select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("section_idx"),
        heading.alias("heading"), html.alias("html"),
    )


def book_number(c: str = "book_id") -> Column:
    return F.regexp_extract(c, r"([0-9]+)$", 1).cast("int")


def metadata_entries(spark, folder) -> DataFrame:
    """Title and creator values of each book, in document order; some are empty."""
    i = F.col("doc_id")
    return documents(spark, folder).select(
        F.col("source").alias("book_id"), i.alias("pos"),
        F.when(book_number("source") % 5 == 3, "").otherwise(F.concat(F.lit(" "), first_line())).alias("title"),
        F.when(book_number("source") % 3 == 0, F.lit(None)).otherwise(F.concat("lang", F.lit(" writer "))).alias("creator"),
    )


def overrides(spark, folder) -> DataFrame:
    n = book_number()
    books = documents(spark, folder).select(F.col("source").alias("book_id")).distinct()
    return books.select(
        "book_id",
        F.when(n % 3 == 1, "").when(n % 3 == 2, F.concat(F.lit("Title "), n.cast("string"))).alias("title"),
        F.when(n % 4 == 3, F.concat(F.lit("Author_"), n.cast("string"))).alias("author"),
    )


def signature_requests(spark, folder) -> DataFrame:
    """A signature request and a page count per document, good and bad ones, and some with the
    largest signature there is."""
    k = F.col("doc_id") % 8
    return documents(spark, folder).select(
        "doc_id",
        F.floor(F.col("n_chars") / 200).cast("int").alias("total_pages"),
        F.when(F.col("doc_id") % 40 == 9, 600_000_000).when(F.col("doc_id") % 40 == 0, 536_870_911).when(F.col("doc_id") % 40 == 17, 0).when(F.col("doc_id") % 40 == 25, -3)
        .when(k == 1, 4).when(k == 4, 5).when(k == 5, 2).cast("int").alias("sheets"),
        F.when(k == 1, 20).when(k == 2, 24).when(k == 3, 10).when(k == 7, 8).cast("int").alias("pages"),
        F.when(F.col("doc_id") % 40 == 0, 12).when(k == 4, -(F.col("doc_id") % 3)).when(k == 5, 3).when(k == 7, 4).cast("int").alias("max_end_padding"),
        F.when(k == 2, "rtl").when(k == 5, " RTL ").when(k == 6, "up").alias("direction"),
    )


def layout_requests(spark, folder) -> DataFrame:
    """A layout request per document: presets, custom values, and wrong ones."""
    i = F.col("doc_id")

    def pick(values, k):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))

    size = pick(("default-trade", "a4", " A5 ", "a6", "letter", "half-letter", "trade-5x8", "trade-6x9", "custom", "folio", ""), i % 11)
    margin = pick(("standard", "compact", "wide", "large-print", "custom", "narrow", " Wide"), i % 7)
    spacing = pick(("traditional", "no-indents", "indented-compact", "uniform", "Uniform "), i % 5)
    width = F.when(i % 4 != 0, (F.col("n_chars") % 20 - 2).cast("double"))
    return documents(spark, folder).select(
        i.alias("layout_id"), spacing.alias("spacing"), margin.alias("margin"), size.alias("size"),
        width.alias("custom_width"), F.lit(20.0).alias("custom_height"),
        F.lit(1.0).alias("custom_top"), F.lit(1.0).alias("custom_bottom"),
        F.when(i % 3 != 0, (i % 5).cast("double")).alias("custom_inside"), F.lit(0.5).alias("custom_outside"),
    )


# layout_id, spacing, margin, size
BOOK_LAYOUTS = (
    (1, "traditional", "standard", "default-trade"),
    (2, "uniform", "compact", "a6"),
    (3, "no-indents", "large-print", "a5"),
)


def book_layouts(spark) -> DataFrame:
    empty = ", ".join(f"{c} double" for c in (
        "custom_width", "custom_height", "custom_top", "custom_bottom", "custom_inside", "custom_outside"))
    return spark.createDataFrame(
        [(*row, *[None] * 6) for row in BOOK_LAYOUTS],
        f"layout_id int, spacing string, margin string, size string, {empty}",
    )


def wanted_layouts(spark, folder) -> DataFrame:
    """Every book in every layout."""
    ids = F.array(*[F.lit(row[0]) for row in BOOK_LAYOUTS])
    books = documents(spark, folder).select(F.col("source").alias("book_id")).distinct()
    return books.select("book_id", F.explode(ids).alias("layout_id"))


def book_imposition(spark, folder) -> DataFrame:
    """An imposition request per book."""
    n = book_number()
    books = documents(spark, folder).select(F.col("source").alias("book_id")).distinct()
    return books.select(
        "book_id",
        F.when(n % 4 == 0, "none").when(n % 4 == 1, " Also ").when(n % 4 == 2, F.lit(None)).otherwise("also").alias("imposition_mode"),
        F.lit(None).cast("int").alias("sheets"),
        F.when(n % 5 == 1, 10).when(n % 2 == 0, 16).otherwise(24).cast("int").alias("pages"),
        F.when(n % 3 == 1, 8).when(n % 3 == 2, 12).cast("int").alias("max_end_padding"),
        F.when(n % 2 == 0, "rtl").otherwise("ltr").alias("direction"),
    )


def variant_jobs(spark, folder) -> DataFrame:
    """Jobs of every book under known and unknown variants and layouts."""
    return documents(spark, folder).select(
        F.col("source").alias("book_id"),
        F.element_at(
            F.array(*[F.lit(v) for v in ("standard", "edit-friendly", "Standard", "no-dialogue-join", "fancy")]),
            (F.col("doc_id") % 5 + 1).cast("int"),
        ).alias("variant"),
        F.col("doc_id").alias("layout_id"),
    )


def conversation_texts(spark, folder) -> DataFrame:
    """A book per conversation, a section per turn, headed by the role."""
    return read_table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("bigint").alias("section_idx"),
        F.col("role").alias("heading"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))


def conversation_books(spark, folder) -> DataFrame:
    """Title and author of two conversations in three."""
    ids = read_table(spark, folder, "conversations").select("conv_id").distinct().filter("conv_id % 3 < 2")
    return ids.select(
        F.col("conv_id").cast("string").alias("book_id"), F.concat(F.lit("Talk_"), F.col("conv_id").cast("string")).alias("used_title"),
        F.when(F.col("conv_id") % 2 == 0, "").otherwise("Two *people*").alias("used_author"))


# --- archives and files -----------------------------------------------------------


def epub_archives(spark, folder) -> DataFrame:
    """An EPUB per document ``(path, content)``, a section per line; some are broken."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 5 == 4, "<html><head/><body> </body></html>").otherwise(
            F.concat(
                F.lit("<html><head><title>t</title><style>p{}</style></head><body><h2>Part <i>"),
                i.cast("string"), F.lit("</i></h2><p>"), escape_html(x), F.lit("</p></body></html>"),
            )
        ),
    )
    source = documents(spark, folder).select(
        F.concat(F.lit("/books/"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("path"),
        F.when(F.col("doc_id") % 4 != 1, escape_html(first_line())).alias("title"),
        F.col("source").alias("creator"),
        (F.col("doc_id") % 10 == 7).alias("broken"),
        lines.alias("sections"),
    )
    bound_batches(spark, ARCHIVE_BYTES)
    return source.mapInPandas(_archive_writer(), "path string, content binary")


#: Bytes of archives that leave the writer in one frame, about.
ARCHIVE_BYTES = 4 << 20


def _archive_writer():
    def write(batches):
        import io
        import zipfile

        import pandas as pd

        def archive(title, creator, sections):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("mimetype", "application/epub+zip")
                z.writestr("META-INF/container.xml",
                           '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
                items = "".join(
                    f'<item id="s{i}" href="s{i}.xhtml" media-type="application/xhtml+xml"/>'
                    for i in range(len(sections)))
                name = f"<dc:title>{title}</dc:title>" if title is not None else ""
                z.writestr("OEBPS/book.opf",
                           '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>'
                           f"{name}<dc:creator>{creator}</dc:creator></metadata><manifest>"
                           f'<item id="c" href="c.css" media-type="text/css"/>{items}</manifest></package>')
                for i, xhtml in enumerate(sections):
                    z.writestr(f"OEBPS/s{i}.xhtml", xhtml)
            return buffer.getvalue()

        def packed(rows):
            return pd.DataFrame(rows, columns=["path", "content"])

        rows, size = [], 0
        for b in batches:
            columns = [b[name] for name in ("path", "title", "creator", "broken", "sections")]
            for path, title, creator, broken, sections in zip(*columns, strict=True):
                rows.append((path, b"not a zip file" if broken else archive(title, creator, sections)))
                size += len(rows[-1][1])
                if size > ARCHIVE_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return write


def sample_files(spark, folder) -> DataFrame:
    """A labelled sample file per document: every fourth line from the third on is a header."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(
            i % 4 == 2, F.concat(F.lit(" === "), x, F.lit(" =="), F.lit("="))
        ).otherwise(F.concat(x, F.lit("  "))),
    )
    return documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("path"), F.array_join(lines, "\n").alias("text")
    )
