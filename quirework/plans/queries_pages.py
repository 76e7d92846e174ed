"""Registered queries: page breaks, sections on sheets, unique slugs, changed paragraphs and books,
with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..operators import books as B
from ..operators import imposition as I
from ..operators import incremental as C
from ..operators import layout as L
from ..operators import pages as P
from ..operators import variants as V
from . import fixtures as X
from . import oracle_parts as O
from .queries_books import _titles
from .queries_html import book_sections_sql, html_items

BOOK = ["book_id", "layout_id"]


def _boxes(s):
    return P.with_measure(L.resolve_layouts(X.book_layouts(s)))


def _items(s, d):
    return B.section_items(X.book_sections(s, d))


def _ranges(s, d):
    return P.section_pages(_items(s, d), X.wanted_layouts(s, d), _boxes(s))


def _sheets(s, d):
    ranges = _ranges(s, d)
    jobs = P.imposition_jobs(P.book_pages(ranges), I.signature_spec(X.book_imposition(s, d)))
    return P.section_sheets(ranges, I.imposition_plan(I.signature_padding(jobs), BOOK))


def _changes(s, d):
    return V.paragraph_changes(X.book_sections(s, d), S.variant_groups(s))


def _edited(s, d):
    """The sections of every book with some edited, moved, left out, and one book under another name."""
    i = F.col("section_idx")
    sections = X.book_sections(s, d).filter((F.col("book_id") != "src5") & (i % 400 != 3))
    return sections.select(
        F.when(F.col("book_id") == "src6", "late").otherwise(F.col("book_id")).alias("book_id"),
        F.when(i % 400 == 7, i + 1_000_000).otherwise(i).alias("section_idx"), "heading",
        F.when(i % 400 == 8, F.concat("html", F.lit("<p>more</p>"))).otherwise(F.col("html")).alias("html"))


QUERIES = {
    "book_contents": lambda s, d: C.book_contents(X.book_sections(s, d)),
    "changed_books": lambda s, d: C.compare_contents(C.book_contents(X.book_sections(s, d)), C.book_contents(_edited(s, d))),
    "page_breaks": lambda s, d: P.page_breaks(_items(s, d), X.wanted_layouts(s, d), _boxes(s)),
    "section_pages": _ranges,
    "section_sheets": _sheets,
    "unique_slugs": lambda s, d: B.unique_slugs(B.book_slugs(_titles(s, d), ["doc_id"]), ["doc_id"]),
    "paragraph_changes": _changes,
    "paragraph_change_counts": lambda s, d: V.change_counts(_changes(s, d)),
}

# --- oracles ----------------------------------------------------------------------

# the widths of the face, in thousandths of the font size, written down again
FACE = ((230, "ijl.,;:''|!’‘·"), (340, "frtIJ()[]{}-/\\*\"”“"), (460, "acegksvxyz?"),
        (660, "ABCDEFGHKLNOPQRSTUVXYZ&"), (840, "mMwW@%—…"))
# layout, measure, measure of headings, lines of a page, gap, indent; worked out by hand from
# 15.24 x 22.86, 10.5 x 14.8 and 14.8 x 21 cm, margins, 11.5 pt, 1.35 lines, headings 1.45 times larger
BOXES = ((1, 30663, 21147, 36, 65, 1200), (2, 20212, 13939, 22, 0, 0), (3, 27114, 18699, 31, 65, 0))


def _page_sql() -> str:
    """CTE ``br(book_id, layout_id, section_idx, page, first_paragraph, first_line)``: pages counted
    within the section, found by filling one page after the other."""
    face = " UNION ALL ".join(f"SELECT unnest(string_split('{chars}', '')) AS c, {w} AS w" for w, chars in FACE)
    boxes = ", ".join(str(b) for b in BOXES)
    fill = ("list_reduce(list_concat([{{'l': 0, 'u': {m}::BIGINT}}], list_transform(zs, lambda z: {{'l': 0, 'u': z::BIGINT}})), "
            "lambda acc, x: CASE WHEN acc.u + 250 + x.u <= {m} THEN {{'l': acc.l, 'u': acc.u + 250 + x.u}} "
            "ELSE {{'l': acc.l + 1, 'u': CASE WHEN acc.l = 0 THEN {ind} ELSE 0 END + x.u}} END).l")
    words = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
    return f"""WITH RECURSIVE {book_sections_sql()}, {html_items('book', 'book_id, section_idx')},
face AS ({face}), box(layout_id, measure, hmeasure, page_lines, gap, indent) AS (VALUES {boxes}),
it AS (SELECT book_id, section_idx, item_idx, kind, text, coalesce(lag(kind) OVER (PARTITION BY book_id, section_idx ORDER BY item_idx) = 'p', false) AS follows
       FROM hbase UNION ALL SELECT book_id, section_idx, -1, 'h', heading, false FROM book WHERE (book_id, section_idx) IN (SELECT (book_id, section_idx) FROM hbase)),
wl AS (SELECT book_id, section_idx, item_idx, kind, follows, CASE WHEN kind = 'scene' THEN [] ELSE {words.format('text')} END AS ws FROM it),
dw AS (SELECT w, unnest(string_split(w, '')) AS c FROM (SELECT DISTINCT unnest(ws) AS w FROM wl)),
wz AS (SELECT dw.w, sum(coalesce(face.w, 520))::BIGINT AS z FROM dw LEFT JOIN face USING (c) GROUP BY dw.w),
sp AS (SELECT * EXCLUDE (ws), unnest(ws) AS w, unnest(range(len(ws))) AS i FROM wl),
zl AS (SELECT book_id, section_idx, item_idx, list(z ORDER BY i) AS zs FROM sp JOIN wz USING (w) GROUP BY book_id, section_idx, item_idx),
ln AS (SELECT wl.* EXCLUDE (ws), box.*, CASE WHEN kind = 'scene' THEN 0 WHEN kind = 'h' THEN {fill.format(m='hmeasure', ind='0')}
         ELSE {fill.format(m='measure', ind='(CASE WHEN follows THEN indent ELSE 0 END)')} END AS n
       FROM wl LEFT JOIN zl USING (book_id, section_idx, item_idx), box),
hd AS (SELECT book_id, layout_id, section_idx, CASE WHEN n IS NULL THEN 0 ELSE round(n * 145 + 261)::BIGINT END AS top FROM ln WHERE kind = 'h'),
bl AS MATERIALIZED (SELECT book_id, layout_id, section_idx, item_idx, kind, n::BIGINT AS n, page_lines, gap FROM ln WHERE kind <> 'h'),
fill AS (
  SELECT book_id, layout_id, section_idx, 0 AS i, 0::BIGINT AS off, 1 AS page, top AS used, true AS first FROM hd
  UNION ALL
  SELECT book_id, layout_id, section_idx, CASE WHEN done THEN i + 1 ELSE i END, CASE WHEN done THEN 0 ELSE off + put END,
         CASE WHEN done THEN page ELSE page + 1 END, CASE WHEN done THEN used + tall ELSE 0 END, NOT done
  FROM (SELECT f.*, b.kind = 'scene' AS scene, b.n - f.off AS rest, page_lines, gap,
               greatest((page_lines * 100 - used) // 100, 0) AS room,
               CASE WHEN b.kind = 'scene' THEN used = 0 OR used + 240 <= page_lines * 100
                    ELSE b.n - f.off <= greatest((page_lines * 100 - used) // 100, 0) END AS done,
               CASE WHEN b.kind = 'scene' THEN 240 ELSE (b.n - f.off) * 100 + gap END AS tall,
               CASE WHEN b.kind = 'scene' THEN 0
                    WHEN used = 0 THEN CASE WHEN b.n - f.off = page_lines + 1 AND page_lines > 2 THEN page_lines - 1 ELSE page_lines END
                    WHEN least(greatest((page_lines * 100 - used) // 100, 0), b.n - f.off - 2) >= 2
                      THEN least(greatest((page_lines * 100 - used) // 100, 0), b.n - f.off - 2) ELSE 0 END AS put
        FROM fill f JOIN bl b ON b.book_id = f.book_id AND b.layout_id = f.layout_id AND b.section_idx = f.section_idx AND b.item_idx = f.i) s),
br AS (SELECT book_id, layout_id, section_idx, page, i AS first_paragraph, off::INT AS first_line FROM fill WHERE first),
sc AS (SELECT book_id, layout_id, section_idx, max(page) AS n FROM br GROUP BY book_id, layout_id, section_idx),
numbered AS (SELECT *, 2 + coalesce(sum(n) OVER (PARTITION BY book_id, layout_id ORDER BY section_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sc),
rng AS (SELECT book_id, layout_id, section_idx, before + 1 AS first_page, before + n AS last_page FROM numbered)"""


def _sheet_sql() -> str:
    return f"""{_page_sql()},
im AS (SELECT DISTINCT source AS book_id, regexp_extract(source, '([0-9]+)$', 1)::INT AS k FROM documents),
jb AS (SELECT book_id, layout_id, max(last_page) AS total, any_value(CASE WHEN k % 5 = 1 THEN 10 WHEN k % 2 = 0 THEN 16 ELSE 24 END) AS pages,
              any_value(CASE k % 3 WHEN 1 THEN 8 WHEN 2 THEN 12 END) AS pad, any_value(k % 2 = 0) AS rtl
       FROM rng JOIN im USING (book_id) GROUP BY book_id, layout_id),
ok AS (SELECT *, ceil(total / pages)::BIGINT * pages AS padded FROM jb WHERE pages % 4 = 0 AND coalesce(ceil(total / pages)::BIGINT * pages - total <= pad, true)),
pg AS (SELECT book_id, layout_id, pages, unnest(range(1, padded + 1)) AS page_no FROM ok),
q AS (SELECT *, (page_no - 1) // pages + 1 AS signature_no, (page_no - 1) % pages + 1 AS q FROM pg),
sl AS (SELECT *, (CASE WHEN q <= pages // 2 THEN (q - 1) // 2 ELSE (pages - q) // 2 END + 1)::INT AS sheet_no,
              CASE WHEN least(q, pages + 1 - q) % 2 = 1 THEN 'front' ELSE 'back' END AS side FROM q)
SELECT DISTINCT r.book_id, r.layout_id, r.section_idx, signature_no, sheet_no, side FROM rng r JOIN sl
ON sl.book_id = r.book_id AND sl.layout_id = r.layout_id AND sl.page_no BETWEEN r.first_page AND r.last_page"""


def _change_sql(variants: str) -> str:
    """CTE ``ch``: every change, by the table of lengths of common subsequences of all tails."""
    keys = "book_id, section_idx"

    def squeezed(x):
        return O.strip(f"regexp_replace({x}, {O.lit(f'[{O.WS}]+')}, ' ', 'g')")

    return f"""WITH RECURSIVE {variants}, {book_sections_sql()}, {html_items('book', keys)},{O.variant_items_chain('h', keys)},
bt AS (SELECT book_id, section_idx, pos, {squeezed('text')} AS t FROM hleaf UNION ALL
       SELECT book_id, section_idx, pos, '***' FROM hkept WHERE {O.matches('t', r'(?i)^<hr[\s/>]')}),
bl AS (SELECT book_id, section_idx, list(t ORDER BY pos) FILTER (t <> '') AS a FROM bt GROUP BY book_id, section_idx),
al AS (SELECT book_id, section_idx, profile, variant, list(t ORDER BY item_idx) FILTER (t <> '') AS b
       FROM (SELECT * EXCLUDE (text), {squeezed('text')} AS t FROM hvi) GROUP BY book_id, section_idx, profile, variant),
al2 AS (SELECT k.book_id, k.section_idx, v.profile, v.variant, coalesce(a, []) AS a, coalesce(b, []) AS b
        FROM (book k CROSS JOIN variants v) LEFT JOIN bl ON bl.book_id = k.book_id AND bl.section_idx = k.section_idx
        LEFT JOIN al ON al.book_id = k.book_id AND al.section_idx = k.section_idx AND al.profile = v.profile AND al.variant = v.variant),
pr AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT a, b FROM al2)),
rd AS MATERIALIZED (SELECT id, list_filter(range(1, len(a) + 1), lambda i: list_contains(b, a[i])) AS ra,
       list_filter(range(1, len(b) + 1), lambda j: list_contains(a, b[j])) AS rb FROM pr),
sq AS MATERIALIZED (SELECT id, list_transform(ra, lambda i: a[i]) AS x, list_transform(rb, lambda j: b[j]) AS y, ra, rb FROM rd JOIN pr USING (id)),
tab(id, i, lens) AS (
  SELECT id, len(x) + 1, list_transform(range(len(y) + 1), lambda k: 0) FROM sq
  UNION ALL
  SELECT id, i, list_transform(range(1, len(t) + 1), lambda j: list_max(t[j:])) FROM (
    SELECT tab.id, tab.i - 1 AS i, list_append(list_transform(range(1, len(y) + 1),
           lambda j: CASE WHEN y[j] = x[tab.i - 1] THEN lens[j + 1] + 1 ELSE lens[j] END), 0) AS t
    FROM tab JOIN sq ON sq.id = tab.id WHERE tab.i > 1) s),
rows_ AS MATERIALIZED (SELECT * FROM tab),
walk(id, i, j, hit) AS (
  SELECT id, 1, 1, false FROM sq
  UNION ALL
  SELECT w.id, CASE WHEN x[w.i] = y[w.j] OR down.lens[w.j] >= cur.lens[w.j + 1] THEN w.i + 1 ELSE w.i END,
         CASE WHEN x[w.i] = y[w.j] OR down.lens[w.j] < cur.lens[w.j + 1] THEN w.j + 1 ELSE w.j END, x[w.i] = y[w.j]
  FROM walk w JOIN sq ON sq.id = w.id JOIN rows_ cur ON cur.id = w.id AND cur.i = w.i JOIN rows_ down ON down.id = w.id AND down.i = w.i + 1
  WHERE w.i <= len(x) AND w.j <= len(y)),
mt AS MATERIALIZED (SELECT w.id, ra[w.i - 1] AS i, rb[w.j - 1] AS j FROM walk w JOIN sq USING (id) WHERE hit),
-- paragraphs of b that are no match, between the matches around them
ub AS (SELECT id, j, b[j] AS t, a FROM (SELECT id, a, b, unnest(range(1, len(b) + 1)) AS j FROM pr) u WHERE (id, j) NOT IN (SELECT (id, j) FROM mt)),
lo AS (SELECT u.id, u.j, u.t, u.a, coalesce(max(m.i) FILTER (m.j < u.j), 0) + 1 AS low, coalesce(min(m.i) FILTER (m.j > u.j), len(u.a) + 1) AS high
       FROM ub u LEFT JOIN mt m ON m.id = u.id GROUP BY u.id, u.j, u.t, u.a),
st AS (SELECT id, j, t, a, high, unnest(range(low, high)) AS x FROM lo),
ca AS (SELECT id, j, x, unnest(range(x + 1, high)) AS y, t, a FROM st WHERE starts_with(t, a[x] || ' ')),
jo AS MATERIALIZED (SELECT id, j, x, y FROM ca WHERE t = array_to_string(a[x:y], ' ')),
bn AS MATERIALIZED (SELECT id, j, low FROM lo),
sw(id, j, free, x, y) AS (
  SELECT id, 0::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT FROM pr
  UNION ALL
  SELECT id, j, coalesce(y + 1, free), x, y FROM (
    SELECT s.id, s.j + 1 AS j, greatest(s.free, coalesce(m.i + 1, bn.low)) AS free,
      (SELECT min(x) FROM jo WHERE jo.id = s.id AND jo.j = s.j + 1 AND jo.x >= greatest(s.free, bn.low)) AS x,
      (SELECT arg_min(y, x) FROM jo WHERE jo.id = s.id AND jo.j = s.j + 1 AND jo.x >= greatest(s.free, bn.low)) AS y
    FROM sw s JOIN pr ON pr.id = s.id LEFT JOIN mt m ON m.id = s.id AND m.j = s.j + 1 LEFT JOIN bn ON bn.id = s.id AND bn.j = s.j + 1
    WHERE s.j < len(pr.b)) q),
jn AS MATERIALIZED (SELECT id, j, x, y FROM sw WHERE x IS NOT NULL),
ed AS (SELECT id, 'kept' AS change, i AS f, i AS l, j FROM mt
  UNION ALL SELECT id, 'joined', x, y, j FROM jn
  UNION ALL SELECT id, 'inserted', NULL, NULL, j FROM ub WHERE (id, j) NOT IN (SELECT (id, j) FROM jn)
  UNION ALL SELECT u.id, 'removed', u.i, u.i, NULL FROM (SELECT id, unnest(range(1, len(a) + 1)) AS i FROM pr) u
    WHERE (u.id, u.i) NOT IN (SELECT (id, i) FROM mt) AND NOT EXISTS (SELECT 1 FROM jn WHERE jn.id = u.id AND u.i BETWEEN jn.x AND jn.y)),
ch AS (SELECT book_id, section_idx, profile, variant, change, (f - 1)::INT AS before_first, (l - 1)::INT AS before_last, (j - 1)::INT AS after_idx
       FROM al2 JOIN pr ON pr.a = al2.a AND pr.b = al2.b JOIN ed USING (id))"""


def _contents_sql(src: str) -> str:
    return (f"SELECT book_id, count(*) || ':' || sum(('0x' || substr(sha256(section_idx || ':' || heading || chr(31) || html), 1, 15))"
            f"::BIGINT::HUGEINT) AS content FROM {src} GROUP BY book_id")


def _oracles() -> dict[str, str]:
    changes = _change_sql(O.variants_cte(O.P.VARIANTS))
    from .queries_books import ORACLES as books

    slugs = books["book_slugs"]
    return {
        "book_contents": f"WITH {book_sections_sql()} {_contents_sql('book')}",
        "changed_books": f"""WITH {book_sections_sql()}, ed AS (SELECT CASE book_id WHEN 'src6' THEN 'late' ELSE book_id END AS book_id,
  CASE WHEN section_idx % 400 = 7 THEN section_idx + 1000000 ELSE section_idx END AS section_idx, heading,
  CASE WHEN section_idx % 400 = 8 THEN html || '<p>more</p>' ELSE html END AS html FROM book WHERE book_id <> 'src5' AND section_idx % 400 <> 3),
a AS ({_contents_sql('book')}), b AS ({_contents_sql('ed')})
SELECT book_id, CASE WHEN a.content IS NULL THEN 'new' WHEN b.content IS NULL THEN 'removed' WHEN a.content = b.content THEN 'unchanged' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (book_id)""",
        "page_breaks": f"""{_page_sql()} SELECT br.book_id, br.layout_id, br.section_idx, before + page AS page, first_paragraph, first_line
FROM br JOIN numbered USING (book_id, layout_id, section_idx)""",
        "section_pages": f"{_page_sql()} SELECT * FROM rng",
        "section_sheets": _sheet_sql(),
        "unique_slugs": f"""WITH s AS ({slugs}),
r AS (SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY md5(doc_id::VARCHAR)) AS n FROM s)
SELECT doc_id, slug, CASE WHEN n = 1 THEN slug ELSE slug || '~' || n END AS unique_slug FROM r""",
        "paragraph_changes": f"{changes} SELECT * FROM ch",
        "paragraph_change_counts": f"""{changes} SELECT book_id, section_idx, profile, variant, count(*) FILTER (change = 'kept') AS kept,
count(*) FILTER (change = 'joined') AS joined, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'inserted') AS inserted
FROM ch GROUP BY book_id, section_idx, profile, variant""",
    }


ORACLES = _oracles()
