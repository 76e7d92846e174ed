"""Registered queries: book metadata, names, documents and styled paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import naming as N
from ..functions.text import py_strip
from ..operators import books as B
from ..operators import layout as L
from . import fixtures as X
from . import oracle_parts as O
from .queries_html import book_sections_sql, html_items, items_html_agg, without_heading


def _books(s, d):
    """Books with detected metadata and overrides applied."""
    return B.metadata_override(B.book_metadata(X.metadata_entries(s, d)), X.overrides(s, d))


def _titles(s, d):
    """A title, author and file name per document; some are missing."""
    i = F.col("doc_id")
    return X.documents(s, d).select(
        "doc_id",
        F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat("lang", F.lit(" Text_"), (i % 9).cast("string")))
        .otherwise(X.first_line()).alias("title"),
        F.when(i % 3 > 0, F.concat(F.lit("  Src "), "source", F.lit("!"))).alias("author"),
        F.when(i % 15 < 10, F.concat("source", F.lit("_file v2"))).alias("stem"),
    )


def _paths(s, d):
    i = F.col("doc_id") % 5
    slug = N.slugify(X.first_line())
    return X.documents(s, d).select(
        "doc_id",
        F.when(i == 0, F.concat(F.lit("C:\\books\\"), slug, F.lit("_output\\"), slug, F.lit("__interior.pdf")))
        .when(i == 1, F.concat(F.lit("/data/"), slug, F.lit("_output/interior.pdf")))
        .when(i == 2, "/data/_output/interior.pdf")
        .when(i == 3, F.concat(F.lit("x\\"), slug, F.lit("\\interior.pdf")))
        .otherwise(F.concat(F.lit("/data/My "), "source", F.lit("_Book.v2.pdf"))).alias("path"),
    )


def _names(s, d):
    n = X.documents(s, d).select(
        "doc_id", F.concat(F.lit(' .a<b>: "'), F.col("lang"), F.lit("?  /\t"), F.col("text"), F.lit(" *. ")).alias("t"))
    t = F.when(F.col("doc_id") % 10 == 0, ' ?."').otherwise(F.col("t"))
    u = F.when(F.col("doc_id") % 10 == 1, "  ").otherwise(F.col("t"))
    return n.select(
        "doc_id", N.safe_component(t).alias("component"), N.safe_download_name(u).alias("download_name"),
        N.safe_underscored(u).alias("underscored"))


def _stems(s, d):
    req = X.layout_requests(s, d).join(_titles(s, d).withColumnRenamed("doc_id", "layout_id"), "layout_id")
    variant = F.element_at(
        F.array(*[F.lit(v) for v in ("standard", "edit-friendly", "aggressive-cleanup", "paragraph-dialogue-merge")]),
        (F.col("layout_id") % 4 + 1).cast("int"))
    df = req.select(
        F.col("layout_id").alias("doc_id"), "title", "author", F.coalesce("stem", F.lit("f")).alias("stem"),
        variant.alias("variant"), "spacing", "margin", "size")
    return B.file_stems(df, ["doc_id"])


def _output_names(s, d):
    books = _books(s, d).withColumn("slug", N.book_slug(F.col("used_title"), F.col("used_author"), F.lit(None)))
    n = X.book_number()
    df = books.select(
        "book_id", "slug", F.col("used_title").alias("title"), (n % 6 + 1).alias("sheets"), ((n % 6 + 1) * 4).alias("pages"),
        F.when(n % 2 == 0, "rtl").otherwise("ltr").alias("direction"))
    return B.output_names(df, ["book_id"])


def _section_html(s, d):
    return B.clean_section_html(B.section_items(X.book_sections(s, d)), drop_duplicate_heading=True)


def _marks(s, d, as_text):
    return B.section_marks(X.book_sections(s, d), drop_notes=as_text, drop_duplicate_heading=not as_text)


def _texts(s, d):
    return B.clean_section_text(B.section_items(X.book_sections(s, d), drop_notes=True))


QUERIES = {
    "book_metadata": lambda s, d: B.book_metadata(X.metadata_entries(s, d)),
    "metadata_override": _books,
    "slugify": lambda s, d: X.documents(s, d).select("doc_id", N.slugify(X.first_line()).alias("slug"), N.slugify(F.col("text")).alias("long_slug")),
    "book_slugs": lambda s, d: B.slug_collisions(B.book_slugs(_titles(s, d), ["doc_id"]), ["doc_id"]),
    "output_names": _output_names,
    "slug_from_path": lambda s, d: _paths(s, d).select("doc_id", N.slug_from_path(F.col("path")).alias("slug")),
    "safe_filenames": _names,
    "file_stems": _stems,
    "section_blocks": lambda s, d: B.section_blocks(_section_html(s, d), _marks(s, d, False)),
    "html_documents": lambda s, d: B.html_documents(_section_html(s, d), _books(s, d), B.stylesheet(), _marks(s, d, False)),
    "markdown_documents": lambda s, d: B.markdown_documents(_texts(s, d), _books(s, d), _marks(s, d, True)),
    "conversation_documents": lambda s, d: B.markdown_documents(X.conversation_texts(s, d), X.conversation_books(s, d)),
    "styled_paragraphs": lambda s, d: B.styled_paragraphs(_texts(s, d), _books(s, d), S.spacing_modes(s)),
    "layout_resolution": lambda s, d: L.resolve_layouts(X.layout_requests(s, d)),
    "layout_stylesheets": lambda s, d: B.layout_stylesheets(L.resolve_layouts(X.layout_requests(s, d))),
    "page_setup": lambda s, d: B.page_setup(L.resolve_layouts(X.layout_requests(s, d))),
}

# --- oracles ----------------------------------------------------------------------

# fixed values: the style as plain text, written down here again
CSS = """@page { size: $w $h; margin-top: $t; margin-bottom: $b; @bottom-center { content: counter(page); font-size: 9pt } }
@page :right { margin-left: $i; margin-right: $o }
@page :left { margin-left: $o; margin-right: $i }
html { font-size: 11.5pt }
body { margin: 0; padding: 0; color: #111; font-family: "Garamond", "EB Garamond", "Cormorant Garamond", serif; line-height: 1.35 }
.title-page { break-after: page; min-height: 100%; display: flex; align-items: center; justify-content: center; text-align: center }
.title-wrap h1 { margin: 0 0 0.45em 0; font-size: 23.00pt; line-height: 1.15 }
.title-wrap .author { margin: 0; font-size: 13.22pt }
.blank-page { break-after: page }
.chapter { break-before: page }
.first-body-chapter.chapter { break-before: right }
.chapter-title { text-align: center; margin: 0 0 1.8em 0; font-size: 16.68pt; page-break-after: avoid }
p { margin: 0 0 $gap 0; text-align: justify; text-indent: 0; orphans: 2; widows: 2 }
.chapter p + p { text-indent: $ind }
h1, h2, h3, h4 { page-break-after: avoid }
em { font-style: italic }
strong { font-weight: bold }
hr, .scene-break { margin: 1.2em auto; width: 25%; border: 0; border-top: 1px solid #666 }"""
# end of fixed values

BOOK_NO = "regexp_extract({0}, '([0-9]+)$', 1)::INT"


def slug_sql(x: str) -> str:
    kept = f"regexp_replace(lower({O.strip(x)}), {O.lit(f'[^{O.P.WORD}{O.WS}-]+')}, '', 'g')"
    return f"coalesce(nullif(trim(regexp_replace({kept}, {O.lit(f'[{O.WS}_-]+')}, '-', 'g'), '-'), ''), 'book')"


BOOKS_SQL = f"""fl AS (SELECT *, string_split(text, chr(10))[1] AS line1, {BOOK_NO.format('source')} AS n FROM documents),
me AS (SELECT source AS book_id, n, doc_id, CASE WHEN n % 5 = 3 THEN '' ELSE ' ' || line1 END AS title,
       CASE WHEN n % 3 = 0 THEN NULL ELSE lang || ' writer ' END AS creator,
       row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM fl),
det AS (SELECT book_id, n, CASE WHEN coalesce(title, '') <> '' THEN {O.strip('title')} ELSE 'Unknown Title' END AS detected_title,
        CASE WHEN coalesce(creator, '') <> '' THEN {O.strip('creator')} ELSE 'Unknown Author' END AS detected_author FROM me WHERE rn = 1),
used AS (SELECT book_id, n, CASE WHEN n % 3 = 2 THEN 'Title ' || n ELSE detected_title END AS used_title,
         CASE WHEN n % 4 = 3 THEN 'Author_' || n ELSE detected_author END AS used_author FROM det)"""

TITLES_SQL = """ti AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN lang || ' Text_' || doc_id % 9 ELSE string_split(text, chr(10))[1] END AS title,
  CASE WHEN doc_id % 3 > 0 THEN '  Src ' || source || '!' END AS author,
  CASE WHEN doc_id % 15 < 10 THEN source || '_file v2' END AS stem FROM documents)"""

LAYOUT_SQL = """lr AS (SELECT doc_id AS layout_id,
  (['traditional', 'no-indents', 'indented-compact', 'uniform', 'Uniform '])[doc_id % 5 + 1] AS spacing,
  (['standard', 'compact', 'wide', 'large-print', 'custom', 'narrow', ' Wide'])[doc_id % 7 + 1] AS margin,
  (['default-trade', 'a4', ' A5 ', 'a6', 'letter', 'half-letter', 'trade-5x8', 'trade-6x9', 'custom', 'folio', ''])[doc_id % 11 + 1] AS size,
  CASE WHEN doc_id % 4 <> 0 THEN (n_chars % 20 - 2)::DOUBLE END AS cw, 20.0::DOUBLE AS ch,
  CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 5)::DOUBLE END AS ci FROM documents)"""


def dims_sql() -> str:
    sizes = ", ".join(f"({O.lit(k)}, {O.lit(l)}, {w}::DOUBLE, {h}::DOUBLE)" for k, l, w, h in O.P.PAGE_SIZES)
    margins = ", ".join(f"({O.lit(m[0])}, {O.lit(m[1])}, " + ", ".join(f"{x}::DOUBLE" for x in m[2:]) + ")" for m in O.P.MARGINS)
    return (
        f"sizes(k, label, w, h) AS (VALUES {sizes}), "
        f"margins(k, label, t, b, i, o) AS (VALUES {margins})"
    )


def safe_component_sql(x: str) -> str:
    kept = f"regexp_replace({O.strip(f'''coalesce({x}, '')''')}, '[<>:\"/\\\\|?*]+', '', 'g')"
    return f"coalesce(nullif(trim(regexp_replace({kept}, {O.lit(f'[{O.WS}]+')}, ' ', 'g'), ' .'), ''), 'Unknown')"


def case_sql(x: str, pairs, otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {O.lit(k)} THEN {O.lit(v)}" for k, v in pairs) + f" ELSE {otherwise} END"


def key_sql(x: str) -> str:
    return f"lower({O.strip(x)})"


SPACING_LABEL = case_sql(key_sql("spacing"), [(m[0], m[1]) for m in O.P.SPACING_MODES], O.lit(O.P.SPACING_MODES[0][1]))
MARGIN_LABEL = case_sql(key_sql("margin"), [(m[0], m[1]) for m in O.P.MARGINS] + [("custom", "Custom margins")], "margin")
SIZE_LABEL = case_sql(key_sql("size"), [(p[0], p[1]) for p in O.P.PAGE_SIZES] + [("custom", "Custom size")], "size")
VARIANT_LABEL = case_sql("variant", O.P.VARIANT_LABELS, "variant")


def file_stem_sql() -> str:
    """From columns author, title, variant, spacing, size, margin."""
    return (
        f"concat_ws(' - ', {safe_component_sql('author')}, {safe_component_sql('title')}, {safe_component_sql(VARIANT_LABEL)}, "
        f"CASE WHEN spacing NOT IN ('', 'traditional') THEN {safe_component_sql(SPACING_LABEL)} END, "
        f"CASE WHEN size NOT IN ('', 'default-trade') THEN {safe_component_sql(SIZE_LABEL)} END, "
        f"CASE WHEN margin NOT IN ('', 'standard') THEN {safe_component_sql(MARGIN_LABEL)} END)"
    )


def md_escape(x: str) -> str:
    return f"replace(replace(replace({x}, chr(92), chr(92)||chr(92)), '*', chr(92)||'*'), '_', chr(92)||'_')"


def blocks_sql() -> str:
    """CTEs ending in ``bk(book_id, section_idx, heading, block)``."""
    return f"""{book_sections_sql()}, {html_items('book', 'book_id, section_idx')},
g AS (SELECT book_id, section_idx, {items_html_agg()} AS html FROM hbase GROUP BY book_id, section_idx),
f AS (SELECT book_id, section_idx, heading, coalesce(g.html, '') AS html FROM book LEFT JOIN g USING (book_id, section_idx)),
ff AS (SELECT book_id, section_idx, heading, {without_heading()} AS html FROM f, ent),
fb AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_idx) AS rn FROM ff WHERE {O.strip('html')} <> ''),
bk AS (SELECT book_id, section_idx, heading, '<section class="' || CASE WHEN rn = 1 THEN 'chapter first-body-chapter' ELSE 'chapter' END || '">' ||
       CASE WHEN heading <> '' THEN '<h1 class="chapter-title">' || {O.escape_html('heading')} || '</h1>' ELSE '' END || html || '</section>' AS block FROM fb)"""


def texts_sql() -> str:
    """CTEs ending in ``tx(book_id, section_idx, heading, item_idx, kind, text)``: notes dropped."""
    return f"""{book_sections_sql()}, {html_items('book', 'book_id, section_idx', True)},
tx AS (SELECT book_id, section_idx, heading, item_idx, kind, text FROM hbase JOIN book USING (book_id, section_idx))"""


def _oracles() -> dict[str, str]:
    css = CSS
    for name, value in (("$w", "15.240cm"), ("$h", "22.860cm"), ("$t", "1.500cm"), ("$b", "1.500cm"), ("$ind", "1.2em"), ("$i", "1.800cm"),
                        ("$o", "1.000cm"), ("$gap", "0.65em")):
        css = css.replace(name, value)
    css = O.lit(css)
    sheet = O.lit(CSS)
    spaced = "lower(trim(spacing))"
    for name, value in (
        ("$gap", f"CASE WHEN {spaced} IN ('uniform', 'indented-compact') THEN '0' ELSE '0.65em' END"),
        ("$ind", f"CASE WHEN {spaced} IN ('uniform', 'no-indents') THEN '0' ELSE '1.2em' END"),
        *((f"${c[0]}", f"printf('%.3fcm', {c}_cm)") for c in ("width", "height", "top", "bottom", "inside", "outside")),
    ):
        sheet = f"replace({sheet}, '{name}', {value})"
    esc_t, esc_a = O.escape_html("used_title"), O.escape_html("used_author")
    modes = ", ".join(f"({O.lit(m[0])}, {m[2]}::DOUBLE, {m[3]}::DOUBLE)" for m in O.P.SPACING_MODES)
    illegal = "'[<>:\"/\\\\|?*\\x00-\\x1f]'"
    t = "CASE WHEN doc_id % 10 = 0 THEN ' ?.\"' ELSE t END"
    u = "CASE WHEN doc_id % 10 = 1 THEN '  ' ELSE t END"
    ws = O.lit(f"[{O.WS}]+")
    font = O.P.FONT_SIZE_PT

    def pt(x):
        return f"round({font}::DOUBLE * {x}, 3)"

    def custom(c, preset, own):
        return f"CASE WHEN error IS NULL THEN CASE WHEN {own} THEN {c} ELSE {preset} END END"

    own_s, own_m = "sk = 'custom'", "mk = 'custom'"
    out = {
        "book_metadata": f"WITH {BOOKS_SQL} SELECT book_id, detected_title, detected_author FROM det",
        "metadata_override": f"WITH {BOOKS_SQL} SELECT book_id, used_title, used_author FROM used",
        "slugify": f"SELECT doc_id, {slug_sql('string_split(text, chr(10))[1]')} AS slug, {slug_sql('text')} AS long_slug FROM documents",
        "book_slugs": f"""WITH {TITLES_SQL}, s AS (SELECT doc_id, CASE
  WHEN coalesce(author, '') <> '' AND coalesce(title, '') <> '' THEN {slug_sql('author')} || '__' || {slug_sql('title')}
  WHEN coalesce(author, '') <> '' THEN {slug_sql('author')} WHEN coalesce(title, '') <> '' THEN {slug_sql('title')}
  WHEN stem IS NOT NULL THEN {slug_sql('stem')} ELSE 'book' END AS slug FROM ti)
SELECT doc_id, slug, count(*) OVER (PARTITION BY slug) AS n_books FROM s""",
        "output_names": f"""WITH {BOOKS_SQL}, s AS (SELECT *, {slug_sql('used_author')} || '__' || {slug_sql('used_title')} AS slug, n % 6 + 1 AS sh FROM used)
SELECT book_id, slug || '_output' AS output_dir, slug || '__interior.pdf' AS interior_pdf, slug || '__editable.docx' AS editable_docx,
  slug || '__google-docs.md' AS markdown, slug || '__imposed__' || sh || 'sheets__' || sh * 4 || 'pages.pdf' AS imposed_pdf,
  used_title || ' - Imposed ' || sh * 4 || 'pp ' || CASE WHEN n % 2 = 0 THEN 'RTL' ELSE 'LTR' END || '.pdf' AS imposed_default FROM s""",
        "slug_from_path": f"""WITH s AS (SELECT doc_id, source, {slug_sql('string_split(text, chr(10))[1]')} AS slug FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'book' WHEN 4 THEN {slug_sql("'My ' || source || '_Book.v2'")} ELSE slug END AS slug FROM s""",
        "safe_filenames": f"""WITH n AS (SELECT doc_id, ' .a<b>: "' || lang || '?  /' || chr(9) || text || ' *. ' AS t FROM documents)
SELECT doc_id, {safe_component_sql(t)} AS component,
  coalesce(nullif(substr(regexp_replace({O.strip(f"regexp_replace({u}, {ws}, ' ', 'g')")}, {illegal}, '_', 'g'), 1, 180), ''), 'ao3_work') AS download_name,
  coalesce(nullif(regexp_replace(regexp_replace({O.strip(u)}, {ws}, '_', 'g'), {illegal}, '_', 'g'), ''), 'book') AS underscored FROM n""",
        "file_stems": f"""WITH {TITLES_SQL}, {LAYOUT_SQL},
x AS (SELECT doc_id, coalesce(nullif(author, ''), stem, 'f') AS author, coalesce(nullif(title, ''), stem, 'f') AS title, spacing, margin, size,
  (['standard', 'edit-friendly', 'aggressive-cleanup', 'paragraph-dialogue-merge'])[doc_id % 4 + 1] AS variant FROM ti JOIN lr ON layout_id = doc_id),
y AS (SELECT doc_id, {file_stem_sql()} AS file_stem FROM x)
SELECT *, file_stem || ' - Interior.pdf' AS pdf_name, file_stem || ' - Editable.docx' AS docx_name, file_stem || ' - Editable.md' AS markdown_name FROM y""",
        "section_blocks": f"WITH {blocks_sql()} SELECT book_id, section_idx, heading, block FROM bk",
        "html_documents": f"""WITH {BOOKS_SQL}, {blocks_sql()}
SELECT book_id, -1::BIGINT AS part_no, '<!doctype html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8" />' || chr(10)
  || '<title>' || {esc_t} || '</title>' || chr(10) || '<style>' || chr(10) || {css} || chr(10) || '</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
  || '<section class="title-page"><div class="title-wrap"><h1>' || {esc_t} || '</h1><p class="author">' || {esc_a}
  || '</p></div></section>' || chr(10) || '<div class="blank-page"></div>' || chr(10) AS html FROM used
UNION ALL SELECT book_id, section_idx, block FROM bk
UNION ALL SELECT book_id, 9223372036854775807, chr(10) || '</body>' || chr(10) || '</html>' || chr(10) FROM used""",
        "markdown_documents": f"""WITH {BOOKS_SQL}, {texts_sql()},
sec AS (SELECT book_id, section_idx, CASE WHEN {O.strip('heading')} <> '' THEN '## ' || {md_escape(O.strip('heading'))} || chr(10) || chr(10) ELSE '' END
  || string_agg(CASE WHEN kind = 'scene' THEN '***' ELSE {md_escape('text')} END, chr(10) || chr(10) ORDER BY item_idx) || chr(10) AS part
  FROM tx GROUP BY book_id, section_idx, heading)
SELECT book_id, -1::BIGINT AS part_no, '# ' || {md_escape('used_title')} || CASE WHEN {O.strip('used_author')} <> '' THEN
  chr(10) || chr(10) || '_By ' || {md_escape('used_author')} || '_' ELSE '' END || chr(10) AS markdown FROM used
UNION ALL SELECT book_id, section_idx,
  repeat(chr(10), CASE WHEN row_number() OVER (PARTITION BY book_id ORDER BY section_idx) = 1 THEN 1 ELSE 2 END) || part FROM sec""",
        "styled_paragraphs": f"""WITH {BOOKS_SQL}, {texts_sql()}, modes(mode, gap, indent) AS (VALUES {modes}),
p AS (SELECT *, lag(kind) OVER (PARTITION BY book_id, section_idx ORDER BY item_idx) AS prev,
      (row_number() OVER (PARTITION BY book_id, section_idx ORDER BY item_idx))::INT - 1 AS para_idx FROM tx),
body AS (SELECT book_id, mode, section_idx, para_idx, CASE WHEN kind = 'scene' THEN 'scene' ELSE 'body' END AS role, text,
  CASE WHEN kind = 'scene' THEN 'center' ELSE 'justify' END AS align, {font}::DOUBLE AS font_pt, false AS bold,
  CASE WHEN kind = 'scene' THEN {pt(1.2)} ELSE 0 END AS before_pt, CASE WHEN kind = 'scene' THEN {pt(1.2)} ELSE {pt('gap')} END AS after_pt,
  CASE WHEN kind = 'scene' OR coalesce(prev, 'scene') = 'scene' THEN 0 ELSE {pt('indent')} END AS indent_pt,
  CASE WHEN kind <> 'scene' THEN 1.35::DOUBLE END AS line_spacing FROM p, modes),
hd AS (SELECT DISTINCT book_id, section_idx, {O.strip('heading')} AS h FROM tx WHERE {O.strip('heading')} <> '')
SELECT * FROM body
UNION ALL SELECT book_id, mode, section_idx, -1, 'heading', h, 'center', {pt(1.45)}, true, 0, {pt(1.8)}, 0, NULL FROM hd, modes
UNION ALL SELECT book_id, mode, -1, 0, 'title', used_title, 'center', {pt(2.0)}, true, 0, 0, 0, NULL FROM used, modes
UNION ALL SELECT book_id, mode, -1, 1, 'author', used_author, 'center', {pt(1.15)}, false, 0, 0, 0, NULL FROM used, modes""",
        "layout_resolution": f"""WITH {LAYOUT_SQL}, {dims_sql()},
x AS (SELECT *, coalesce(nullif({key_sql('size')}, ''), 'default-trade') AS sk, {key_sql('margin')} AS mk FROM lr),
y AS (SELECT x.*, s.w, s.h, m.t, m.b, m.i, m.o, CASE WHEN {own_s} AND cw IS NULL THEN 'custom_size_missing'
  WHEN {own_s} AND cw <= 0 THEN 'custom_size_not_positive' WHEN NOT {own_s} AND s.w IS NULL THEN 'unknown_page_size'
  WHEN {own_m} AND ci IS NULL THEN 'custom_margins_missing' WHEN {own_m} AND ci <= 0 THEN 'custom_margins_not_positive'
  WHEN NOT {own_m} AND m.t IS NULL THEN 'unknown_margins' END AS error
  FROM x LEFT JOIN sizes s ON s.k = sk LEFT JOIN margins m ON m.k = mk)
SELECT layout_id, spacing, margin, size, {custom('cw', 'w', own_s)} AS width_cm, {custom('ch', 'h', own_s)} AS height_cm,
  {custom('1.0', 't', own_m)} AS top_cm, {custom('1.0', 'b', own_m)} AS bottom_cm, {custom('ci', 'i', own_m)} AS inside_cm,
  {custom('0.5', 'o', own_m)} AS outside_cm, CASE WHEN error IS NULL THEN 'ok' ELSE 'rejected' END AS status, error FROM y""",
    }
    out["conversation_documents"] = f"""WITH t AS (SELECT conv_id, turn, role, list_filter(list_transform(
    string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {O.strip('x')}), lambda y: y <> '') AS ps FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM t WHERE len(ps) > 0)
SELECT DISTINCT conv_id::VARCHAR AS book_id, -1::BIGINT AS part_no, CASE WHEN conv_id % 3 = 2 THEN '# Unknown Title' || chr(10) || chr(10) || '_By Unknown Author_'
  ELSE '# Talk' || chr(92) || '_' || conv_id || CASE WHEN conv_id % 2 = 0 THEN '' ELSE chr(10) || chr(10) || '_By Two ' || chr(92) || '*people' || chr(92) || '*_' END END
  || chr(10) AS markdown FROM t
UNION ALL SELECT conv_id::VARCHAR, turn, repeat(chr(10), CASE WHEN rn = 1 THEN 1 ELSE 2 END) || '## ' || {md_escape('role')} || chr(10) || chr(10) ||
  array_to_string(list_transform(ps, lambda p: CASE WHEN {O.scene('p')} THEN '***' ELSE {md_escape('p')} END), chr(10) || chr(10)) || chr(10) FROM f"""
    out["layout_stylesheets"] = f"SELECT layout_id, {sheet} AS css FROM ({out['layout_resolution']}) WHERE status = 'ok'"
    out["page_setup"] = f"""SELECT layout_id, width_cm, height_cm, top_cm, bottom_cm, inside_cm AS left_cm, outside_cm AS right_cm,
  0.8::DOUBLE AS footer_distance_cm FROM ({out['layout_resolution']}) WHERE status = 'ok'"""
    return out


ORACLES = _oracles()
