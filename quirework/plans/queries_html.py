"""Registered queries: HTML extraction, web pages and archives, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import books as B
from ..operators import html as OH
from ..operators import text as OT
from ..operators import web as OW
from ..sources import epub
from .. import settings as S
from . import fixtures as X
from . import oracle_parts as O
from .queries_text import DOC_LINES

PAGE = ["page_id"]

# --- fixtures in SQL --------------------------------------------------------------

RICH = """src AS (SELECT page_id, url, replace(
  CASE WHEN page_id % 3 = 0 THEN replace(h, '</p><p>', '</p><hr/><hr/><p>') ELSE h END,
  '<footer>', '<ul class="download"><li><a href="/d/'||page_id||'.epub">EPUB</a></li><li><a href="../d/'||page_id||
  '.pdf">PDF</a></li><li><a href="?get=azw3">Kindle</a></li></ul><footer>') AS html
  FROM (SELECT *, replace(html, '<article>', '<article><div class="notes x"><div><p>Note.</p></div></div>') AS h FROM pages))"""
TITLED = """t1 AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN
    replace(replace(html, '<h1>', '<h2 class="title heading">'), '</h1>', '</h2>') ELSE html END AS h FROM pages),
t2 AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN replace(h, '<article>', '<article><h2> </h2><h3 class="byline heading"><a rel="author" href="#">A'
    ||page_id % 17||'</a></h3>') ELSE h END AS h FROM t1),
src AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(h, '</head>', '<meta property="og:title" content=" Page '||page_id||
    ' &amp; more"></head>') ELSE h END AS html FROM t2)"""
WORKS = """src AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url ELSE
  CASE WHEN page_id % 2 = 0 THEN 'HTTPS://host.example' WHEN page_id % 3 = 0 THEN '//host.example' ELSE '' END
  || '/works/' || page_id % 40 || '/chapters/' || page_id || '?view=1#x' END AS url FROM pages)"""


def _rich(s, d, drop_notes=False):
    return OH.with_tokens(X.rich_pages(s, d), "html", drop_notes)


ENCODED = (("e", "&#101;"), ("t", "&#x74;"), ("- ", "&mdash;&bogus; & "), ("***", "&#8220;&eacute;&#x1F600;"),
           ("a", "&#97"), ("w", "&notit;&copy w"), ("z", "&NotEqualTilde;&amp&ltz&CounterClockwiseContourIntegral;"), ("v", "&#150;&#x80"))


def _encoded(s, d):
    """Page text with letters written as references: numeric, named, without semicolon, unknown, of
    two characters, and names that begin with a shorter one."""
    html = F.col("html")
    for letter, ref in ENCODED:
        html = F.replace(html, F.lit(letter), F.lit(ref))
    return X.pages(s, d).select("page_id", H.decode_entities(html).alias("decoded"))


def _encoded_sql() -> str:
    html = "html"
    for letter, ref in ENCODED:
        html = f"replace({html}, {O.lit(letter)}, {O.lit(ref)})"
    return f"WITH {O.entity_cte()}, src AS (SELECT page_id, {html} AS h FROM pages) SELECT page_id, {O.decode('h')} AS decoded FROM src, ent"


def _sections(s, d):
    """Rich pages as one-section books."""
    return X.rich_pages(s, d).select(
        F.col("page_id").alias("book_id"), F.lit(0).alias("section_idx"),
        OH.heading_of("html").alias("heading"), "html",
    )


def _variant_items(s, d, drop_notes=False):
    return B.fan_out(B.section_items(_sections(s, d), drop_notes), S.variant_groups(s))


VKEYS = ["page_id", "profile", "variant"]


def _as_page(df):
    return df.withColumnRenamed("book_id", "page_id")


def _duplicate_heading(s, d):
    """Clean HTML with and without the repeated heading, for sections that may repeat it."""
    html = B.clean_section_html(B.section_items(X.book_sections(s, d)))
    return html.select(
        "book_id", "section_idx", H.strip_duplicate_heading(F.col("html"), F.col("heading")).alias("html"))


def _epub(s, d):
    return epub.epub_sections(epub.epub_entries(X.epub_archives(s, d)))


QUERIES = {
    "epub_corpus_sections": _epub,
    "epub_rejects": lambda s, d: epub.rejected_archives(epub.epub_entries(X.epub_archives(s, d))),
    "page_bodies": lambda s, d: OH.page_bodies(X.hard_pages(s, d), PAGE),
    "strip_script_style": lambda s, d: X.pages(s, d).select(
        "page_id", H.strip_script_style(F.col("html")).alias("html")),
    "section_heading": lambda s, d: OH.sections_from_html(X.hard_headings(s, d), PAGE).select("page_id", "heading"),
    "entity_decode": _encoded,
    "drop_boilerplate": lambda s, d: OH.kept_html(X.rich_pages(s, d), PAGE),
    "leaf_blocks": lambda s, d: OH.leaf_blocks(_rich(s, d), PAGE).select("page_id", "leaf_idx", "pos", "tag"),
    "hr_scene_rows": lambda s, d: OH.block_and_rule_rows(_rich(s, d), PAGE),
    "block_text": lambda s, d: OH.leaf_blocks(OH.with_tokens(X.cdata_pages(s, d), "html", True), PAGE).select("page_id", "leaf_idx", "text"),
    "legacy_paragraph_clean": lambda s, d: OH.legacy_paragraphs(_rich(s, d), PAGE),
    "page_title_author": lambda s, d: OW.page_metadata(X.hard_titles(s, d), PAGE),
    "download_links": lambda s, d: OW.download_links(X.hard_links(s, d), PAGE).select(
        "page_id", F.explode_outer("links").alias("fmt", "url")).filter(F.col("fmt").isNotNull()),
    "pick_format": lambda s, d: OW.picked_formats(
        OW.download_links(X.rich_pages(s, d).withColumn(
            "html", F.when(F.col("page_id") % 3 == 1, F.replace("html", F.lit("epub"), F.lit("x"))).otherwise(
                F.when(F.col("page_id") % 3 == 2, F.regexp_replace("html", "(?i)epub|pdf|html", "x")).otherwise(F.col("html")))), PAGE), PAGE),
    "normalize_work_url": lambda s, d: OW.work_urls(X.work_urls(s, d)),
    "clean_section_items": lambda s, d: OT.explode_items(_as_page(_variant_items(s, d)), VKEYS),
    "clean_section_text": lambda s, d: _as_page(B.clean_section_text(_variant_items(s, d, True))).select(*VKEYS, "text"),
    "clean_section_html": lambda s, d: _as_page(B.fan_out(
        B.section_items(_sections(s, d)), S.variant_groups(s), B.clean_section_html)).select(*VKEYS, "html"),
    "strip_duplicate_heading": _duplicate_heading,
}

# --- oracles ----------------------------------------------------------------------

BOOK_LINE = (
    "'<p>' || {esc} || '</p>' || CASE WHEN i % 7 = 6 THEN '<hr/><hr/>' ELSE '' END || chr(10)"
)


def book_sections_sql() -> str:
    """CTEs ending in ``book(book_id, section_idx, heading, html)``."""
    from .queries_text import dialogue_line_sql

    line = O.escape_html(f"replace({dialogue_line_sql()}, ', ', ','||chr(10))")
    return f"""{DOC_LINES},
bh AS (SELECT doc_id, source, max(CASE WHEN i = 0 THEN raw END) AS heading,
       string_agg({BOOK_LINE.format(esc=line)}, '' ORDER BY i) AS body FROM dl GROUP BY doc_id, source),
book AS (SELECT source AS book_id, doc_id AS section_idx, heading, '<div class="userstuff">' ||
   CASE WHEN doc_id % 2 = 0 THEN '<p>' || {O.escape_html("replace(lower(heading), ' ', '  ')")} || '</p>' || chr(10) ELSE '' END
   || body || '</div><nav><p>skip</p></nav>' ||
   CASE WHEN doc_id % 9 = 0 THEN '<div class="notes"><p>Note</p></div>' ELSE '' END AS html FROM bh)"""


def html_items(src: str, keys: str, drop_notes=False) -> str:
    return f"{O.entity_cte()},{O.html_items_chain('h', src, keys, drop_notes)}"


def items_html_agg(order="item_idx") -> str:
    return (
        "string_agg(CASE WHEN kind = 'scene' THEN '<hr class=\"scene-break\" />' ELSE '<p>' || "
        f"{O.escape_html('text')} || '</p>' END, chr(10) ORDER BY {order})"
    )


def without_heading(html="html", heading="heading") -> str:
    """SQL twin of the duplicate-heading rule, on the first line of the HTML. Needs ent."""
    first = f"string_split({html}, chr(10))[1]"
    inner = O.decode(f"regexp_extract({first}, '^<p>(.*)</p>$', 1)")

    def norm(x):
        squeezed = f"regexp_replace({x}, {O.lit(f'[{O.WS}]+')}, ' ', 'g')"
        return f"replace(lower({O.strip(squeezed)}), 'ß', 'ss')"

    rest = O.strip(f"substr({html}, length({first}) + 2)")
    return (
        f"CASE WHEN {O.strip(heading)} <> '' AND regexp_matches({first}, '^<p>.*</p>$') AND {norm(inner)} = {norm(heading)} "
        f"THEN {rest} ELSE {html} END"
    )


def _oracles() -> dict[str, str]:
    k = "page_id"
    ent = O.entity_cte()
    idx = "(row_number() OVER (PARTITION BY page_id ORDER BY pos))::INT - 1"
    rich_tokens = f"WITH {ent}, {RICH},{O.token_chain('h', 'src', k)}"
    heading_pattern = "(?is)" + "|".join(rf"<h{n}(?:\s[^>]*)?>.*?</h{n}\s*>" for n in (1, 2, 3))

    def nodes(x):
        """Text of a fragment: decoded, stripped, non-empty runs joined by blanks."""
        runs = f"list_filter(regexp_extract_all({x}, {O.lit(O.TOKEN)}, 0), lambda y: NOT starts_with(y, '<'))"
        return f"array_to_string(list_filter(list_transform({runs}, lambda z: {O.strip(O.decode('z'))}), lambda v: v <> ''), ' ')"

    variants = O.variants_cte(O.P.VARIANTS)
    vi = f"{RICH}, {variants}, {html_items('src', k)},{O.variant_items_chain('h', k)}"
    vi_notes = f"{RICH}, {variants}, {html_items('src', k, True)},{O.variant_items_chain('h', k)}"
    seg = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)"
    upath = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    links = f"""tk AS (SELECT page_id, url, unnest(regexp_extract_all(html, {O.lit(O.TOKEN)}, 0)) AS t,
      unnest(range(len(regexp_extract_all(html, {O.lit(O.TOKEN)}, 0))))::INT AS pos FROM lsrc),
an AS (SELECT page_id, url, pos, t, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS nxt FROM tk WHERE {O.matches('t', r'(?i)^</?a[\s/>]')}),
op AS (SELECT a.page_id, a.url, a.pos, {O.decode(f'''regexp_extract(a.t, {O.lit('(?is)\\shref="([^"]*)"')}, 1)''')} AS href,
       lower(coalesce((SELECT string_agg({O.strip('x.t')}, ' ' ORDER BY x.pos) FROM tk x WHERE x.page_id = a.page_id AND x.pos > a.pos
              AND x.pos < coalesce(a.nxt, 2147483647) AND NOT starts_with(x.t, '<') AND {O.strip('x.t')} <> ''), '')) AS txt
       FROM an a, ent WHERE {O.matches('a.t', r'(?i)^<a\s')}),
re AS (SELECT page_id, pos, href, txt, CASE
         WHEN starts_with(href, '/') THEN {seg} || href
         WHEN starts_with(href, '?') THEN {seg} || {upath} || href
         WHEN starts_with(href, '#') THEN regexp_extract(url, '^[^#]*') || href
         WHEN starts_with(href, '../') THEN {seg} || coalesce(nullif(regexp_replace(regexp_extract({upath}, '^(.*/)', 1), '[^/]+/$', ''), ''), '/') || substr(href, 4)
         WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
         ELSE {seg} || coalesce(nullif(regexp_extract({upath}, '^(.*/)', 1), ''), '/') || href END AS full_url
       FROM op WHERE href <> ''),
fm AS (SELECT page_id, f AS fmt, arg_max(full_url, pos) AS url FROM re, (SELECT unnest(['epub','html','pdf','mobi','azw3']) AS f)
       WHERE contains(txt, f) OR contains(lower(href), f) GROUP BY page_id, f)"""
    pick_src = """lsrc AS (SELECT page_id, url, CASE page_id % 3 WHEN 1 THEN replace(html, 'epub', 'x')
      WHEN 2 THEN regexp_replace(html, '(?i)epub|pdf|html', 'x', 'g') ELSE html END AS html FROM src)"""
    void = "(i % 5 = 4)"
    return {
        "epub_corpus_sections": f"""WITH {DOC_LINES}, {ent}, h AS (SELECT doc_id, max(CASE WHEN i = 0 THEN raw END) AS title FROM dl GROUP BY doc_id)
SELECT '/books/' || doc_id || '.epub' AS path, i AS section_idx,
  CASE WHEN doc_id % 4 <> 1 THEN {O.strip('title')} ELSE 'Unknown Title' END AS title, source AS author,
  'Part ' || i AS heading, '<h2>Part <i>' || i || '</i></h2><p>' || {O.escape_html('raw')} || '</p>' AS html
FROM dl JOIN h USING (doc_id) WHERE NOT {void} AND doc_id % 10 <> 7""",
        "epub_rejects": "SELECT '/books/' || doc_id || '.epub' AS path, 'BadZipFile' AS error FROM documents WHERE doc_id % 10 = 7",
        "page_bodies": f"""WITH b AS (SELECT page_id, {O.body_content('html')} AS body FROM pages)
SELECT * FROM b WHERE body <> ''""",
        "strip_script_style": f"SELECT page_id, {O.strip_script_style('html')} AS html FROM pages",
        "section_heading": f"""WITH {ent}, {TITLED}, b AS (SELECT page_id, {O.body_content('html')} AS body FROM src),
c AS (SELECT page_id, list_transform(regexp_extract_all(body, {O.lit(heading_pattern)}, 0), lambda h: {nodes('h')}) AS hs FROM b, ent WHERE body <> '')
SELECT page_id, coalesce(list_filter(hs, lambda q: q <> '')[1], '') AS heading FROM c""",
        "entity_decode": _encoded_sql(),
        "drop_boilerplate": f"""WITH {RICH},{O.token_chain('a', 'src', k)},{O.token_chain('b', 'src', k, drop_notes=True)},
ka AS (SELECT page_id, string_agg(t, '' ORDER BY pos) AS kept FROM akept GROUP BY page_id),
kb AS (SELECT page_id, string_agg(t, '' ORDER BY pos) AS kept_without_notes FROM bkept GROUP BY page_id)
SELECT page_id, kept, kept_without_notes FROM ka JOIN kb USING (page_id)""",
        "leaf_blocks": f"""{rich_tokens},{O.leaf_chain('h', k)},
r AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos))::INT - 1 AS pos, t FROM hkept),
p AS (SELECT page_id, h.pos AS old, (SELECT count(*) FROM hkept x WHERE x.page_id = h.page_id AND x.pos < h.pos)::INT AS new, tag FROM hleaf h)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY old))::INT - 1 AS leaf_idx, new AS pos, tag FROM p""",
        "hr_scene_rows": f"""{rich_tokens},{O.leaf_chain('h', k)},
a AS (SELECT page_id, pos, 'block' AS kind FROM hleaf UNION ALL
      SELECT page_id, pos, 'scene' FROM hkept WHERE {O.matches('t', r'(?i)^<hr[\s/>]')})
SELECT page_id, {idx} AS row_idx, kind FROM a""",
        "block_text": f"""WITH {ent}, {RICH.replace("src AS", "rich AS", 1)},
src AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(html, '</article>',
  '<p>x <i>b &gt; &amp;amp; &lt;i&gt;c</i> d</p></article>') ELSE html END AS html FROM rich),{O.token_chain('h', 'src', k, drop_notes=True)},{O.leaf_chain('h', k)}
SELECT page_id, {idx} AS leaf_idx, text FROM hleaf""",
        "legacy_paragraph_clean": f"""{rich_tokens},{O.leaf_chain('h', k)},
pp AS (SELECT e.page_id, e.pos, e.last FROM (SELECT *, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS last2 FROM hled) e
       JOIN hkept x ON x.page_id = e.page_id AND x.pos = e.pos WHERE {O.matches('x.t', r'(?i)^<p(?:\s[^>]*)?>')}),
pt AS (SELECT p.page_id, p.pos, coalesce(string_agg(x.t, ' ' ORDER BY x.pos), '') AS raw FROM pp p LEFT JOIN htxk x
       ON x.page_id = p.page_id AND x.pos > p.pos AND x.pos < coalesce(p.last, 2147483647) GROUP BY p.page_id, p.pos),
pc AS (SELECT page_id, pos, regexp_replace(regexp_replace(raw, '[ \\t]+', ' ', 'g'), {O.lit(rf'\n[{O.WS}]*\n+')}, chr(10), 'g') AS text FROM pt)
SELECT page_id, {idx} AS para_idx, text FROM pc WHERE {O.strip('text')} <> ''""",
        "page_title_author": f"""WITH {ent}, {TITLED},
a AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {nodes("regexp_extract(html, '(?is)<h2 class=\"title heading\">.*?</h2>')")} END AS title,
      CASE WHEN page_id % 5 = 0 THEN 'Page ' || page_id || ' & more' END AS meta,
      CASE WHEN page_id % 3 > 0 THEN 'A' || page_id % 17 ELSE 'Unknown Author' END AS author FROM src, ent),
b AS (SELECT page_id, coalesce(nullif(title, ''), meta, 'AO3 Work') AS title, author FROM a)
SELECT *, substr(regexp_replace({O.strip(f"regexp_replace(author || ' - ' || title, {O.lit(f'[{O.WS}]+')}, ' ', 'g')")},
       {O.lit('[<>:"/' + chr(92) * 2 + '|?*' + chr(92) + 'x00-' + chr(92) + 'x1f]')}, '_', 'g'), 1, 180) AS file_stem FROM b""",
        "download_links": f"""WITH {ent}, {RICH}, lsrc AS (SELECT * FROM src), {links} SELECT page_id, fmt, url FROM fm""",
        "pick_format": f"""WITH {ent}, {RICH}, {pick_src}, {links},
pr AS (SELECT page_id, arg_min(fmt, r) AS fmt, arg_min(url, r) AS url FROM fm JOIN (VALUES ('epub', 1), ('html', 2), ('pdf', 3)) o(f, r) ON o.f = fm.fmt GROUP BY page_id)
SELECT page_id, fmt, pr.url AS url, CASE WHEN fmt IS NULL THEN 'no_format' ELSE 'ok' END AS status FROM pages LEFT JOIN pr USING (page_id)""",
        "normalize_work_url": f"""WITH {WORKS}, w AS (SELECT url, CASE WHEN page_id % 7 = 0 THEN NULL ELSE
   'https://' || CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN 'host.example' ELSE 'archiveofourown.org' END || '/works/' || page_id % 40 END AS work_url FROM src)
SELECT work_url, CASE WHEN work_url IS NULL THEN url END AS invalid_url, count(*) AS n_urls,
  CASE WHEN work_url IS NULL THEN 'invalid' ELSE 'ok' END AS status FROM w GROUP BY ALL""",
        "clean_section_items": f"WITH {vi} SELECT page_id, profile, variant, item_idx, kind, text FROM hvi",
        "clean_section_text": f"""WITH {vi_notes},
g AS (SELECT page_id, profile, variant, {O.strip("string_agg(text, chr(10)||chr(10) ORDER BY item_idx)")} AS text FROM hvi GROUP BY page_id, profile, variant)
SELECT * FROM g WHERE text <> ''""",
        "clean_section_html": f"""WITH {vi}, g AS (SELECT page_id, profile, variant, {items_html_agg()} AS html FROM hvi GROUP BY page_id, profile, variant)
SELECT page_id, profile, variant, coalesce(html, '') AS html FROM ((SELECT page_id FROM pages) CROSS JOIN variants) LEFT JOIN g USING (page_id, profile, variant)""",
        "strip_duplicate_heading": f"""WITH {book_sections_sql()}, {html_items('book', 'book_id, section_idx')},
g AS (SELECT book_id, section_idx, {items_html_agg()} AS html FROM hbase GROUP BY book_id, section_idx),
f AS (SELECT book_id, section_idx, heading, coalesce(g.html, '') AS html FROM book LEFT JOIN g USING (book_id, section_idx))
SELECT book_id, section_idx, {without_heading()} AS html FROM f, ent""",
    }


ORACLES = _oracles()
