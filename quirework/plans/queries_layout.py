"""Registered queries: pages, imposition, variants and the run report, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import merge as M
from ..functions import naming as N
from ..operators import books as B
from ..operators import imposition as I
from ..operators import layout as L
from ..operators import variants as V
from . import fixtures as X
from . import oracle_parts as O
from .queries_books import (
    BOOKS_SQL, LAYOUT_SQL, MARGIN_LABEL, SIZE_LABEL, SPACING_LABEL, VARIANT_LABEL, _books,
    _oracles as book_oracles, file_stem_sql, slug_sql,
)
from .queries_html import book_sections_sql, html_items, items_html_agg

DOC = ["doc_id"]


def _caps(s):
    return L.with_capacity(L.resolve_layouts(X.book_layouts(s)))


def _specs(s, d):
    return I.signature_spec(X.signature_requests(s, d))


def _jobs(s, d):
    return I.signature_padding(_specs(s, d))


def _sizes(s, d):
    """Signature sizes by document: a valid or an invalid page count."""
    return X.documents(s, d).select("doc_id", (F.col("n_chars") % 13 * 2).cast("int").alias("pages"))


def _base(s, d):
    sections = X.book_sections(s, d)
    return B.section_items(sections.withColumn("input_bytes", F.octet_length("html")))


def _measures(s, d, profile=None):
    """Per-section sizes and paragraph lengths under each variant."""
    return B.fan_out(_base(s, d), S.variant_groups(s, profile), V.section_measures)


def _metrics(s, d):
    m = V.page_metrics(_measures(s, d), X.wanted_layouts(s, d), _caps(s), ["book_id", "profile", "variant"])
    return V.with_baseline(m, ["book_id", "profile", "layout_id"])


def _app_metrics(s, d):
    m = V.page_metrics(_measures(s, d, "app"), X.wanted_layouts(s, d), _caps(s), ["book_id", "variant"])
    return V.with_baseline(m, ["book_id", "layout_id"])


def _section_counts(s, d):
    """Readable sections per book; one book has none."""
    counts = X.documents(s, d).groupBy(F.col("source").alias("book_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("book_id", F.when(X.book_number() == 13, 0).otherwise(F.col("n")).alias("n_sections"))


def _status(s, d):
    return V.run_status(
        X.variant_jobs(s, d), _section_counts(s, d), S.variants(s, "script"), L.resolve_layouts(X.layout_requests(s, d)))


def _variant_outputs(s, d):
    items = B.fan_out(_base(s, d), S.variant_groups(s, "script"))
    texts = B.clean_section_text(items.select("book_id", "section_idx", "heading", "variant", "items"))
    counted = texts.groupBy("book_id", "variant").agg(
        F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("text")).alias("n_chars"),
        V.texts_digest(F.col("section_idx"), F.col("text")).alias("texts_digest"))
    slugs = _books(s, d).select(
        "book_id", N.book_slug(F.col("used_title"), F.col("used_author"), F.lit(None)).alias("slug"))
    return V.variant_paths(counted.join(slugs, "book_id")).drop("slug")


QUERIES = {
    "page_estimate": lambda s, d: L.page_estimate(_base(s, d), X.wanted_layouts(s, d), _caps(s)),
    "signature_spec": _specs,
    "signature_padding": _jobs,
    "sheet_pairs": lambda s, d: I.sheet_pairs(_sizes(s, d), DOC),
    "imposition_plan": lambda s, d: I.imposition_plan(_jobs(s, d).filter("direction = 'ltr'"), DOC).drop("is_blank"),
    "imposition_rtl": lambda s, d: I.imposition_plan(_jobs(s, d).filter("direction = 'rtl'"), DOC).drop("is_blank"),
    "imposition_blank_slots": lambda s, d: I.imposition_plan(_jobs(s, d), DOC).filter("is_blank"),
    "imposition_misplaced_pages": lambda s, d: I.placed_pages(I.imposition_plan(_jobs(s, d), DOC), _jobs(s, d), DOC),
    "imposition_summary": lambda s, d: I.imposition_summary(_jobs(s, d), DOC),
    "variant_fanout": lambda s, d: _measures(s, d).select(
        "book_id", "section_idx", "profile", "variant", F.size("lens").alias("n_items"), "html_bytes", "text_bytes"),
    "unknown_variants": lambda s, d: V.unknown_variants(X.variant_jobs(s, d), S.variants(s)),
    "variant_outputs": _variant_outputs,
    "failure_isolation": _status,
    "failed_books": lambda s, d: V.book_outcomes(_status(s, d)),
    "baseline_comparison": lambda s, d: _metrics(s, d).drop("input_bytes", "text_bytes"),
    "size_metrics": lambda s, d: V.size_metrics(_measures(s, d, "app"), ["book_id", "variant"]),
    "preview_samples": lambda s, d: V.preview_samples(X.book_sections(s, d)),
    "changed_sections": lambda s, d: V.changed_sections(X.book_sections(s, d), S.variant_groups(s)),
    "run_report": lambda s, d: V.run_report(_app_metrics(s, d), _books(s, d), L.resolve_layouts(X.book_layouts(s)), X.book_imposition(s, d)),
}

# --- oracles ----------------------------------------------------------------------

REQ_SQL = """rq AS (SELECT doc_id, (n_chars // 200)::INT AS total_pages,
  CASE WHEN doc_id % 40 = 9 THEN 600000000 WHEN doc_id % 40 = 0 THEN 536870911 WHEN doc_id % 40 = 17 THEN 0 WHEN doc_id % 40 = 25 THEN -3
    WHEN doc_id % 8 = 1 THEN 4 WHEN doc_id % 8 = 4 THEN 5 WHEN doc_id % 8 = 5 THEN 2 END AS sh, CASE doc_id % 8 WHEN 1 THEN 20 WHEN 2 THEN 24 WHEN 3 THEN 10 WHEN 7 THEN 8 END AS pg,
  (CASE WHEN doc_id % 40 = 0 THEN 12 WHEN doc_id % 8 = 4 THEN -(doc_id % 3) WHEN doc_id % 8 = 5 THEN 3 WHEN doc_id % 8 = 7 THEN 4 END)::INT AS max_end_padding,
  CASE doc_id % 8 WHEN 2 THEN 'rtl' WHEN 5 THEN 'rtl' WHEN 6 THEN 'up' ELSE 'ltr' END AS dir FROM documents),
sp AS (SELECT doc_id, total_pages, max_end_padding, dir, coalesce(sh, pg // 4, 4)::BIGINT AS s0, CASE
  WHEN sh <= 0 THEN 'sheets_not_positive' WHEN sh > 536870911 THEN 'sheets_too_many'
  WHEN sh IS NOT NULL AND pg IS NOT NULL AND pg <> sh * 4 THEN 'sheets_pages_conflict'
  WHEN sh IS NULL AND pg % 4 <> 0 THEN 'pages_not_multiple_of_4' WHEN dir = 'up' THEN 'unknown_direction'
  WHEN max_end_padding < 0 THEN 'negative_padding' END AS error FROM rq),
sg AS (SELECT doc_id, total_pages, CASE WHEN error IS NULL THEN s0 END::INT AS sheets, CASE WHEN error IS NULL THEN s0 * 4 END::INT AS pages,
  max_end_padding, CASE WHEN error IS NULL THEN dir END AS direction, CASE WHEN error IS NULL THEN 'ok' ELSE 'rejected' END AS status, error FROM sp),
pd AS (SELECT * EXCLUDE (status, error), ceil(total_pages / pages)::BIGINT * pages AS p, CASE WHEN error IS NOT NULL THEN error WHEN total_pages <= 0 THEN 'no_pages'
  WHEN ceil(total_pages / pages)::BIGINT * pages - total_pages > max_end_padding THEN 'too_much_padding' END AS error FROM sg),
jb AS (SELECT doc_id, total_pages, sheets, pages, max_end_padding, direction, error, CASE WHEN error IS NULL THEN p END AS padded_pages,
  CASE WHEN error IS NULL THEN p - total_pages END AS blank_pages, CASE WHEN error IS NULL THEN p // pages END AS signatures,
  CASE WHEN error IS NULL THEN 'ok' ELSE 'rejected' END AS status FROM pd)"""

# every page of the padded book looks up its own slot
PLAN_SQL = f"""{REQ_SQL},
pg AS (SELECT doc_id, pages, total_pages, direction, unnest(range(1, padded_pages + 1)) AS page_no FROM jb WHERE status = 'ok'),
lo AS (SELECT *, (page_no - 1) // pages + 1 AS signature_no, (page_no - 1) % pages + 1 AS q FROM pg),
sl AS (SELECT *, (CASE WHEN q <= pages // 2 THEN (q - 1) // 2 ELSE (pages - q) // 2 END + 1)::INT AS sheet_no,
  CASE WHEN least(q, pages + 1 - q) % 2 = 1 THEN 'front' ELSE 'back' END AS side,
  CASE WHEN (q % 2 = 0) = (direction = 'ltr') THEN 'left' ELSE 'right' END AS position FROM lo)"""
PLAN_COLUMNS = "doc_id, signature_no, sheet_no, side, position, page_no"


def _capacity_sql() -> str:
    """CTE ``lc(layout_id, spacing, margin, size, cpl, lpp, gap)``."""
    rows = []
    for layout_id, spacing, margin, size in X.BOOK_LAYOUTS:
        _, _, w, h = next(p for p in O.P.PAGE_SIZES if p[0] == size)
        _, _, t, b, i, o = next(m for m in O.P.MARGINS if m[0] == margin)
        gap = 0 if spacing in ("uniform", "indented-compact") else 65
        rows.append(f"({layout_id}, '{spacing}', '{margin}', '{size}', {w}::DOUBLE, {h}::DOUBLE, {t}::DOUBLE, {b}::DOUBLE, {i}::DOUBLE, {o}::DOUBLE, {gap})")
    return f"""l0(layout_id, spacing, margin, size, w, h, t, b, i, o, gap) AS (VALUES {', '.join(rows)}),
lc AS (SELECT *, floor((w - i - o) * {O.P.POINTS_PER_CM}::DOUBLE / (0.5 * {O.P.FONT_SIZE_PT}::DOUBLE))::BIGINT AS cpl,
       floor((h - t - b) * {O.P.POINTS_PER_CM}::DOUBLE / ({O.P.FONT_SIZE_PT}::DOUBLE * {O.P.LINE_HEIGHT}::DOUBLE))::BIGINT AS lpp FROM l0)"""


def _pages_sql(items: str, keys: str) -> str:
    """CTE ``pe(keys, layout_id, pages, sections)``."""
    return f"""ln AS (SELECT {keys}, section_idx, layout_id, sum(ceil(length(text) / cpl) * 100 + gap)::BIGINT AS hundredths, any_value(lpp) AS lpp
  FROM {items}, lc GROUP BY {keys}, section_idx, layout_id),
pe AS (SELECT {keys}, layout_id, (sum((hundredths + lpp * 100 - 1) // (lpp * 100)) + 2)::BIGINT AS pages, count(*) AS sections FROM ln GROUP BY {keys}, layout_id)"""


def _oracles() -> dict[str, str]:
    keys = "book_id, section_idx"
    base = f"{book_sections_sql()}, {html_items('book', keys)}"

    def vi(rows):
        return f"{O.variants_cte(rows)}, {base},{O.variant_items_chain('h', keys)}"

    def profile(name):
        return [v for v in O.P.VARIANTS if v[0] == name]

    everything = f"""{vi(O.P.VARIANTS)},
ms AS (SELECT book_id, section_idx, profile, variant, count(*)::INT AS n_items, strlen({items_html_agg()})::INT AS html_bytes,
       strlen({O.strip("string_agg(text, chr(10)||chr(10) ORDER BY item_idx)")})::INT AS text_bytes FROM hvi GROUP BY book_id, section_idx, profile, variant),
mm AS (SELECT b.book_id, b.section_idx, v.profile, v.variant, coalesce(n_items, 0)::INT AS n_items, coalesce(html_bytes, 0)::INT AS html_bytes,
       coalesce(text_bytes, 0)::INT AS text_bytes, strlen(html) AS input_bytes FROM (book b CROSS JOIN variants v) LEFT JOIN ms
       ON ms.book_id = b.book_id AND ms.section_idx = b.section_idx AND ms.profile = v.profile AND ms.variant = v.variant)"""
    metrics = f"""{everything}, {_capacity_sql()}, {_pages_sql('hvi', 'book_id, profile, variant')},
sz AS (SELECT book_id, profile, variant, sum(html_bytes)::BIGINT AS html_bytes, sum(input_bytes)::BIGINT AS input_bytes FROM mm GROUP BY book_id, profile, variant),
mt AS (SELECT book_id, profile, variant, layout_id, pages, html_bytes, input_bytes FROM pe JOIN sz USING (book_id, profile, variant)),
bs AS (SELECT m.*, b.pages AS baseline_pages, b.html_bytes AS baseline_bytes, m.pages - b.pages AS page_delta, m.html_bytes - b.html_bytes AS byte_delta
       FROM mt m LEFT JOIN mt b ON b.book_id = m.book_id AND b.profile = m.profile AND b.layout_id = m.layout_id AND b.variant = 'standard')"""
    names = "['standard', 'edit-friendly', 'Standard', 'no-dialogue-join', 'fancy']"
    layouts = book_oracles()["layout_resolution"]
    layouts = f"lay AS ({layouts})"
    script = ", ".join(O.lit(v[1]) for v in profile("script"))
    status = f"""{layouts},
sj AS (SELECT source AS book_id, ({names})[doc_id % 5 + 1] AS variant, doc_id AS layout_id, {"regexp_extract(source, '([0-9]+)$', 1)::INT"} AS n FROM documents),
st AS (SELECT book_id, variant, layout_id, CASE WHEN variant NOT IN ({script}) THEN 'unknown_variant' WHEN lay.error IS NOT NULL THEN lay.error
       WHEN n = 13 THEN 'no_readable_sections' END AS error FROM sj JOIN lay USING (layout_id)),
ss AS (SELECT *, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status FROM st)"""
    before = f"""{base},
bt AS (SELECT book_id, section_idx, pos, text FROM hleaf UNION ALL
       SELECT book_id, section_idx, pos, '***' FROM hkept WHERE {O.matches('t', r'(?i)^<hr[\s/>]')}),
bf AS (SELECT book_id, section_idx, {O.strip("string_agg(text, chr(10)||chr(10) ORDER BY pos)")} AS before FROM bt GROUP BY book_id, section_idx),
af AS (SELECT book_id, section_idx, {O.strip("string_agg(text, chr(10)||chr(10) ORDER BY item_idx)")} AS after FROM hbase GROUP BY book_id, section_idx),
ba AS (SELECT book_id, section_idx, heading, coalesce(before, '') AS before, coalesce(after, '') AS after
       FROM book LEFT JOIN bf USING (book_id, section_idx) LEFT JOIN af USING (book_id, section_idx))"""

    def trim(x):
        cut = f"substr({x}, 1, 1397)"
        return f"CASE WHEN length({x}) <= 1400 THEN {x} ELSE regexp_replace({cut}, {O.lit(f'[{O.WS}]+$')}, '') || '...' END"

    sheets = "unnest(range(pages // 4))"
    return {
        "page_estimate": f"WITH {base}, {_capacity_sql()}, {_pages_sql('hbase', 'book_id')} SELECT * FROM pe",
        "signature_spec": f"WITH {REQ_SQL} SELECT * FROM sg",
        "signature_padding": f"WITH {REQ_SQL} SELECT * FROM jb",
        "sheet_pairs": f"""WITH z AS (SELECT doc_id, (n_chars % 13 * 2)::INT AS pages FROM documents),
k AS (SELECT doc_id, pages, {sheets}::INT AS k FROM z WHERE pages > 0 AND pages % 4 = 0)
SELECT doc_id, pages, k + 1 AS sheet_no, 'front' AS side, pages - 2 * k AS left_page, 1 + 2 * k AS right_page, 'ok' AS status, NULL AS error FROM k
UNION ALL SELECT doc_id, pages, k + 1, 'back', 2 + 2 * k, pages - 1 - 2 * k, 'ok', NULL FROM k
UNION ALL SELECT doc_id, pages, NULL, NULL, NULL, NULL, 'rejected', CASE WHEN pages <= 0 THEN 'pages_not_positive' ELSE 'pages_not_multiple_of_4' END
  FROM z WHERE pages <= 0 OR pages % 4 <> 0""",
        "imposition_plan": f"WITH {PLAN_SQL} SELECT {PLAN_COLUMNS} FROM sl WHERE direction = 'ltr'",
        "imposition_rtl": f"WITH {PLAN_SQL} SELECT {PLAN_COLUMNS} FROM sl WHERE direction = 'rtl'",
        "imposition_blank_slots": f"WITH {PLAN_SQL} SELECT {PLAN_COLUMNS}, true AS is_blank FROM sl WHERE page_no > total_pages",
        "imposition_misplaced_pages": f"""WITH {PLAN_SQL}
SELECT doc_id, total_pages, count(*) FILTER (page_no <= total_pages) AS pages_placed,
  count(DISTINCT page_no) FILTER (page_no <= total_pages) <> total_pages AS misplaced FROM sl GROUP BY doc_id, total_pages""",
        "imposition_summary": f"""WITH {PLAN_SQL}
SELECT doc_id, total_pages AS input_pages, count(*) FILTER (page_no > total_pages) AS blank_pages_added,
  count(DISTINCT (signature_no, sheet_no, side)) AS sheet_sides, count(DISTINCT (signature_no, sheet_no)) AS physical_sheets,
  count(DISTINCT signature_no) AS total_signatures FROM sl GROUP BY doc_id, total_pages""",
        "variant_fanout": f"WITH {everything} SELECT book_id, section_idx, profile, variant, n_items, html_bytes, text_bytes FROM mm",
        "unknown_variants": f"""SELECT DISTINCT v AS variant FROM (SELECT ({names})[doc_id % 5 + 1] AS v FROM documents)
WHERE v NOT IN ({', '.join(sorted({O.lit(v[1]) for v in O.P.VARIANTS}))})""",
        "variant_outputs": f"""WITH {BOOKS_SQL}, {vi(profile('script'))},
tx AS (SELECT book_id, section_idx, variant, {O.strip("string_agg(text, chr(10)||chr(10) ORDER BY item_idx)")} AS t FROM hvi GROUP BY book_id, section_idx, variant),
ct AS (SELECT book_id, variant, count(*) AS n_sections, sum(length(t))::BIGINT AS n_chars,
       (sum(('0x' || substr(sha256(section_idx || ':' || t), 1, 15))::BIGINT::HUGEINT))::VARCHAR AS texts_digest
       FROM tx WHERE t <> '' GROUP BY book_id, variant),
sl AS (SELECT book_id, {slug_sql('used_author')} || '__' || {slug_sql('used_title')} || '_output/variants/' AS folder FROM used)
SELECT book_id, variant, n_sections, n_chars, texts_digest, folder || variant || '__interior.pdf' AS pdf_path, folder || variant || '__editable.docx' AS docx_path
FROM ct JOIN sl USING (book_id)""",
        "failure_isolation": f"WITH {status} SELECT * FROM ss",
        "failed_books": f"""WITH {status} SELECT book_id, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_failed,
  count(*) FILTER (status = 'ok') = 0 AS all_failed FROM ss GROUP BY book_id""",
        "baseline_comparison": f"""WITH {metrics} SELECT book_id, profile, variant, layout_id, pages, html_bytes, baseline_pages, baseline_bytes, page_delta, byte_delta FROM bs""",
        "size_metrics": f"""WITH {everything} SELECT book_id, variant, sum(input_bytes)::DOUBLE / 1048576 AS input_mb, sum(html_bytes)::DOUBLE / 1048576 AS html_mb,
  sum(text_bytes)::DOUBLE / 1048576 AS text_mb FROM mm WHERE profile = 'app' GROUP BY book_id, variant""",
        "preview_samples": f"""WITH {before}, r AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY section_idx))::INT AS sample_no FROM ba)
SELECT book_id, sample_no, heading, {trim('before')} AS before, {trim('after')} AS after FROM r WHERE sample_no <= 3""",
        "changed_sections": f"""WITH {vi(O.P.VARIANTS)},
bt AS (SELECT book_id, section_idx, pos, text FROM hleaf UNION ALL
       SELECT book_id, section_idx, pos, '***' FROM hkept WHERE {O.matches('t', r'(?i)^<hr[\s/>]')}),
bf AS (SELECT book_id, section_idx, {O.strip("string_agg(text, chr(10)||chr(10) ORDER BY pos)")} AS before FROM bt GROUP BY book_id, section_idx),
av AS (SELECT book_id, section_idx, profile, variant, {O.strip("string_agg(text, chr(10)||chr(10) ORDER BY item_idx)")} AS after FROM hvi
       GROUP BY book_id, section_idx, profile, variant),
ba AS (SELECT b.book_id, v.profile, v.variant, coalesce(before, '') AS before, coalesce(after, '') AS after FROM (book b CROSS JOIN variants v)
       LEFT JOIN bf ON bf.book_id = b.book_id AND bf.section_idx = b.section_idx
       LEFT JOIN av ON av.book_id = b.book_id AND av.section_idx = b.section_idx AND av.profile = v.profile AND av.variant = v.variant)
SELECT book_id, profile, variant, count(*) AS n_sections, count(*) FILTER (before <> after) AS n_changed FROM ba GROUP BY book_id, profile, variant""",
        "run_report": f"""WITH {BOOKS_SQL}, {metrics},
im AS (SELECT book_id, CASE WHEN n % 4 IN (0, 2) THEN 'none' ELSE 'also' END AS mode, CASE WHEN n % 5 = 1 THEN 10 WHEN n % 2 = 0 THEN 16 ELSE 24 END AS pg,
  CASE n % 3 WHEN 1 THEN 8 WHEN 2 THEN 12 END AS pad, CASE WHEN n % 2 = 0 THEN 'Right-to-left' ELSE 'Left-to-right' END AS dir FROM used),
rr AS (SELECT bs.*, used_title AS title, used_author AS author, spacing, margin, size, mode, pg, pad, dir, ceil(pages / pg)::BIGINT * pg AS padded
  FROM bs JOIN used USING (book_id) JOIN lc USING (layout_id) JOIN im USING (book_id) WHERE profile = 'app'),
re AS (SELECT *, CASE WHEN pg % 4 <> 0 THEN 'pages_not_multiple_of_4' WHEN padded - pages > pad THEN 'too_much_padding' END AS err FROM rr),
ro AS (SELECT *, mode = 'also' AND err IS NULL AS ok FROM re)
SELECT book_id, variant, layout_id, title, author, {VARIANT_LABEL} AS variant_label, {file_stem_sql()} AS file_stem, {SPACING_LABEL} AS spacing_label,
  {SIZE_LABEL} AS page_size_label, {MARGIN_LABEL} AS margin_label, input_bytes::DOUBLE / 1048576 AS input_mb, html_bytes::DOUBLE / 1048576 AS output_mb,
  pages AS output_pages, CASE WHEN variant <> 'standard' THEN baseline_pages END AS baseline_pages, CASE WHEN variant <> 'standard' THEN page_delta END AS page_delta,
  CASE WHEN variant <> 'standard' THEN byte_delta::DOUBLE / 1048576 END AS size_delta_mb,
  CASE mode WHEN 'also' THEN 'Also create imposed PDF' ELSE 'Do not create imposed PDF' END AS imposition_label,
  CASE WHEN ok THEN pg END AS pages_per_signature, CASE WHEN ok THEN dir END AS direction_label, coalesce(pad::VARCHAR, 'Unlimited') AS max_padding_label,
  CASE WHEN ok THEN padded - pages END AS blank_pages_added, CASE WHEN ok THEN padded // pg END AS total_signatures,
  CASE WHEN ok THEN padded // 2 END AS sheet_sides, CASE WHEN ok THEN padded // 4 END AS physical_sheets,
  CASE WHEN mode = 'also' THEN err END AS imposition_error FROM ro""",
    }


ORACLES = _oracles()
