"""Pieces of DuckDB SQL for the oracle queries.

They are written row by row, with windows over exploded lines and tokens, and fold
paragraphs as text: a different way to the same results than the array expressions.
"""

from __future__ import annotations

import html.entities

from . import oracle_values as P

WS = P.SPACE
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def scene(x: str) -> str:
    return matches(x, f"^(?:{P.SCENE})$")


def lower_start(x: str, strict=False) -> str:
    return matches(x, f"^[{P.LOWER_START_STRICT if strict else P.LOWER_START}]")


def tag_start(x: str, words=P.DIALOGUE_TAG_WORDS) -> str:
    return matches(x, rf"^(?i:{words})(?:[^{P.WORD}]|$)")


def quote_end(x: str) -> str:
    return matches(x, f"[{P.CLOSING_QUOTES}]$")


def line_joinable(cur: str, nxt: str, strict=False) -> str:
    if strict:
        words, opened = P.PRONOUN_TAG_WORDS, f"[{P.OPEN_LINE_MARKS}{P.CLOSING_QUOTES}]$"
    else:
        words, opened = P.DIALOGUE_TAG_WORDS, f"[{P.OPEN_LINE_MARKS}]|[{P.CLOSING_QUOTES}]$"
    return (
        f"(({matches(cur, opened)} AND {lower_start(nxt, strict)}) "
        f"OR ({quote_end(cur)} AND {tag_start(nxt, words)}))"
    )


def merge_plain(prev: str, nxt: str) -> str:
    return (
        f"({matches(prev, f'[{P.OPEN_PARAGRAPH_MARKS}{P.CLOSING_QUOTES}]$')} "
        f"AND ({lower_start(nxt)} OR {tag_start(nxt)}) AND NOT {scene(prev)} AND NOT {scene(nxt)})"
    )


def merge_bold(prev: str, nxt: str) -> str:
    cont = f"({lower_start(nxt)} OR {tag_start(nxt)})"
    return (
        f"(NOT {scene(prev)} AND NOT {scene(nxt)} AND NOT {matches(prev, f'[.!?][{P.CLOSING_QUOTES}]?$')} AND ("
        f"(length({prev}) <= {P.SHORT_PREVIOUS} AND {cont}) "
        f"OR (length({prev}) <= {P.SHORT_QUOTED_PREVIOUS} AND {matches(prev, f'^[{P.OPENING_QUOTES}]')}) "
        f"OR (length({nxt}) <= {P.SHORT_NEXT} AND {cont})))"
    )


def normalized(x: str, nbsp=True) -> str:
    x = f"replace(replace({x}, chr(13)||chr(10), chr(10)), chr(13), chr(10))"
    if nbsp:
        x = f"replace({x}, chr(160), ' ')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    return f"regexp_replace({x}, ' *\\n *', chr(10), 'g')"


def lines_of(src: str, keys: str, text: str) -> str:
    return (
        f"SELECT {keys}, unnest(string_split({text}, {NL})) AS raw, "
        f"unnest(range(len(string_split({text}, {NL}))))::INT AS i FROM {src}"
    )


def block_chain(p: str, src: str, keys: str, text="text", preserve="true", nbsp=True) -> str:
    """CTEs ``{p}blk``: one row per line with its kind and block number.

    Each CTE carries the keys; ``preserve`` may be a column among them."""
    return f"""
{p}norm AS (SELECT {keys}, {normalized(text, nbsp)} AS norm_text FROM {src}),
{p}raw AS ({lines_of(f'{p}norm', keys, 'norm_text')}),
{p}line AS (SELECT {keys}, i, {strip('raw')} AS s FROM {p}raw),
{p}kind AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN {preserve} AND {scene('s')} THEN 'scene'
            ELSE 'text' END AS kind FROM {p}line),
{p}cut AS (SELECT *, CASE WHEN kind <> 'text' OR coalesce(lag(kind) OVER (PARTITION BY {keys} ORDER BY i), '') <> 'text'
           THEN 1 ELSE 0 END AS cut FROM {p}kind),
{p}blk AS (SELECT *, (sum(cut) OVER (PARTITION BY {keys} ORDER BY i))::INT - 1 AS block_idx FROM {p}cut)"""


def pair_chain(p: str, keys: str, strict=False) -> str:
    """CTE ``{p}out``: the lines of each block after the pairwise join (text blocks only)."""
    w = f"PARTITION BY {keys}, block_idx ORDER BY i"
    return f"""
{p}nxt AS (SELECT *, lead(s) OVER ({w}) AS nxt FROM {p}blk WHERE kind = 'text'),
{p}joi AS (SELECT *, nxt IS NOT NULL AND {line_joinable('s', 'nxt', strict)} AS j FROM {p}nxt),
{p}run AS (SELECT *, i - coalesce(1 + max(CASE WHEN NOT j THEN i END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           min(i) OVER (PARTITION BY {keys}, block_idx)) AS k FROM {p}joi),
{p}par AS (SELECT *, j AND k % 2 = 0 AS head FROM {p}run),
{p}tai AS (SELECT *, coalesce(lag(head) OVER ({w}), false) AS tail FROM {p}par),
{p}out AS (SELECT {keys}, block_idx, i, CASE WHEN head THEN s || ' ' || nxt ELSE s END AS line
           FROM {p}tai WHERE NOT tail)"""


def clean_chain(p: str, src: str, keys: str, text="text", soft="true", dialogue="true",
                collapse="true", preserve="true", strict=False, nbsp=True) -> str:
    """CTE ``{p}clean(keys, cleaned)``."""
    return f"""{block_chain(p, src, keys, text, preserve, nbsp)},{pair_chain(p, keys, strict)},
{p}blt AS (
  SELECT {keys}, block_idx,
         CASE WHEN {soft} THEN {strip(f"regexp_replace(string_agg(s, ' ' ORDER BY i), ' {{2,}}', ' ', 'g')")}
              ELSE string_agg(s, {NL} ORDER BY i) END AS plain,
         min(kind) AS kind
  FROM {p}blk GROUP BY {keys}, block_idx),
{p}dia AS (SELECT {keys}, block_idx, string_agg(line, {NL} ORDER BY i) AS paired FROM {p}out GROUP BY {keys}, block_idx),
{p}txt AS (
  SELECT {keys}, block_idx, CASE WHEN kind = 'text' AND {dialogue} AND NOT {soft} THEN paired ELSE plain END AS t
  FROM {p}blt LEFT JOIN {p}dia USING ({keys}, block_idx)),
{p}doc AS (SELECT {keys}, string_agg(t, {NL} ORDER BY block_idx) AS t FROM {p}txt GROUP BY {keys}),
{p}clean AS (SELECT {keys}, {strip(f"CASE WHEN {collapse} THEN regexp_replace(t, '\\n{{3,}}', chr(10)||chr(10), 'g') ELSE t END")} AS cleaned
             FROM {p}doc)"""


def items_chain(p: str, src: str, keys: str, text="cleaned") -> str:
    """CTE ``{p}items(keys, chunk, kind, text)`` from cleaned text."""
    parts = f"string_split({text}, chr(10)||chr(10))"
    return f"""
{p}chunk AS (SELECT {keys}, unnest({parts}) AS raw, unnest(range(len({parts})))::INT AS chunk FROM {src}),
{p}items AS (SELECT {keys}, chunk, CASE WHEN {scene(strip('raw'))} THEN 'scene' ELSE 'p' END AS kind,
             CASE WHEN {scene(strip('raw'))} THEN '***' ELSE {strip('raw')} END AS text
             FROM {p}chunk WHERE {strip('raw')} <> '')"""


def merge_fold(src: str, keys: str, order: str, on="true", bold="false") -> str:
    """SELECT keys, list of merged items as text; scenes carry chr(2) in front."""
    last = "list_extract(string_split(acc, chr(1)), -1)"
    test = (
        f"{on} AND NOT starts_with(x, chr(2)) AND NOT starts_with({last}, chr(2)) AND "
        f"({merge_plain(last, 'x')} OR ({bold} AND {merge_bold(last, 'x')}))"
    )
    return f"""
SELECT {keys}, string_split(list_reduce(xs, lambda acc, x: acc || CASE WHEN {test} THEN ' ' ELSE chr(1) END || x), chr(1)) AS merged
FROM (SELECT {keys}, list(CASE WHEN kind = 'scene' THEN chr(2) || text ELSE text END ORDER BY {order}) AS xs
      FROM {src} GROUP BY {keys})"""


def unfold(src: str, keys: str) -> str:
    """Back to rows ``(keys, item_idx, kind, text)``."""
    return f"""
SELECT {keys}, item_idx, CASE WHEN starts_with(m, chr(2)) THEN 'scene' ELSE 'p' END AS kind, ltrim(m, chr(2)) AS text
FROM (SELECT {keys}, unnest(merged) AS m, unnest(range(len(merged)))::INT AS item_idx FROM {src})"""


# --- HTML -------------------------------------------------------------------------

TOKEN = r"""(?s)<!--.*?-->|<(?:[^<>"']|"[^"]*"|'[^']*')*>|<[^<>]*>|[^<]+"""


def strip_script_style(x: str) -> str:
    pattern = (
        r"(?is)(<!--.*?-->)|<(?:script|style)(?:\s[^>]*)?/>"
        r"|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
    )
    return f"regexp_replace({x}, {lit(pattern)}, '\\1', 'g')"


def body_content(x: str) -> str:
    h = strip_script_style(x)
    body = lit(r"(?is)<body(?:\s[^>]*)?>(.*?)(?:</body\s*>|$)")
    return strip(
        f"CASE WHEN {matches(h, r'(?i)<body[\s>]')} THEN regexp_extract({h}, {body}, 1) ELSE {h} END"
    )


def entity_cte() -> str:
    names = html.entities.html5
    pairs = ", ".join(f"{lit('&' + n)}: " + " || ".join(f"chr({ord(c)})" for c in names[n]) for n in sorted(names))
    return f"ent AS (SELECT MAP {{{pairs}}} AS m)"


def decode(x: str) -> str:
    """Needs ``ent`` in FROM. A name that is not known is tried from its longest beginning down;
    names that need no semicolon have six letters at most."""
    part = lit(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&")
    shorter = ", ".join(f"m[substr(t, 1, {k + 1})] || substr(t, {k + 2})" for k in (6, 5, 4, 3, 2))

    def char(n: str) -> str:
        controls = ", ".join(f"chr({ord(bytes([k]).decode('cp1252', 'ignore') or chr(k))})" for k in range(128, 160))
        return f"CASE WHEN {n} BETWEEN 128 AND 159 THEN [{controls}][{n} - 127] ELSE chr({n}) END"

    one = (
        f"CASE WHEN regexp_matches(t, '^&#[0-9]+') THEN {char("regexp_extract(t, '[0-9]+')::INT")} "
        f"WHEN regexp_matches(t, '^&#[xX]') THEN {char("('0x' || regexp_extract(t, '^&#[xX]([0-9a-fA-F]+)', 1))::INT")} "
        f"WHEN regexp_matches(t, '^&.') THEN coalesce(m[t], {shorter}, t) ELSE t END"
    )
    return (
        f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(regexp_extract_all({x}, {part}, 0), "
        f"lambda t: {one}), '') ELSE {x} END"
    )


def escape_html(x: str) -> str:
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {lit(raw)}, {lit(to)})"
    return x


def hit(t: str, drop_notes: bool) -> str:
    classes = f"{P.DROP_CLASSES}|{P.NOTE_CLASSES}" if drop_notes else P.DROP_CLASSES
    tests = [
        matches(t, r"(?i)^<nav[\s/>]"),
        matches(t, rf'\sclass="(?:[^"]*\s)?(?:{classes})(?:\s[^"]*)?"'),
    ]
    if drop_notes:
        tests.append(matches(t, rf'\sid="(?:{P.NOTE_IDS})"'))
    return f"({matches(t, '^<[A-Za-z]')} AND ({' OR '.join(tests)}))"


def token_chain(p: str, src: str, keys: str, html_col="html", drop_notes=False) -> str:
    """CTE ``{p}kept(keys, pos, t)``: tokens without boilerplate."""
    ex = f"regexp_extract_all({html_col}, {lit(TOKEN)}, 0)"
    return f"""
{p}tok AS (SELECT {keys}, unnest({ex}) AS t, unnest(range(len({ex})))::INT AS pos FROM {src}),
{p}tag AS (SELECT *, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9:_.\\-]*)', 1)) AS name FROM {p}tok
           WHERE {matches('t', '^</?[A-Za-z]')}),
{p}del AS (SELECT *, CASE WHEN starts_with(t, '</') THEN -1 WHEN ends_with(t, '/>') OR name IN ({P.VOID_TAGS}) THEN 0 ELSE 1 END AS d
           FROM {p}tag),
{p}cum AS (SELECT *, sum(d) OVER (PARTITION BY {keys}, name ORDER BY pos) AS depth FROM {p}del),
{p}cand AS (SELECT * FROM {p}cum WHERE d >= 0 AND {hit('t', drop_notes)}),
{p}rng AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.pos AS lo,
           CASE WHEN any_value(c.d) = 0 THEN c.pos ELSE coalesce(min(e.pos), 2147483647) END AS hi
           FROM {p}cand c LEFT JOIN {p}cum e ON {' AND '.join(f'c.{k.strip()} = e.{k.strip()}' for k in keys.split(','))}
             AND e.name = c.name AND e.pos > c.pos AND e.depth < c.depth
           GROUP BY {', '.join('c.' + k.strip() for k in keys.split(','))}, c.pos),
{p}kept AS (SELECT * FROM {p}tok k WHERE NOT EXISTS (SELECT 1 FROM {p}rng r
            WHERE {' AND '.join(f'k.{k.strip()} = r.{k.strip()}' for k in keys.split(','))} AND k.pos BETWEEN r.lo AND r.hi))"""


def leaf_chain(p: str, keys: str) -> str:
    """CTE ``{p}leaf(keys, pos, tag, text)`` with raw decoded text. Needs ``ent``."""
    tags = P.BLOCK_TAGS
    same = " AND ".join(f"l.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    lk = ", ".join("l." + k.strip() for k in keys.split(","))
    return f"""
{p}ev AS (SELECT {keys}, pos, lower(regexp_extract(t, '^</?([A-Za-z]+)', 1)) AS tag,
          starts_with(t, '</') AS closes, ends_with(t, '/>') AS empty
          FROM {p}kept WHERE {matches('t', rf'(?i)^</?(?:{tags})[\s/>]')}),
{p}led AS (SELECT *, lead(closes) OVER w AS next_closes, lead(pos) OVER w AS last
           FROM {p}ev WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
{p}leafs AS (SELECT * FROM {p}led WHERE NOT closes AND NOT empty AND next_closes),
{p}txk AS (SELECT {keys}, pos, {decode('t')} AS t FROM {p}kept, ent WHERE NOT starts_with(t, '<')),
{p}leaf AS (SELECT {lk}, l.pos, l.tag, coalesce(string_agg(k.t, {NL} ORDER BY k.pos), '') AS text
            FROM {p}leafs l LEFT JOIN {p}txk k ON {same} AND k.pos > l.pos AND k.pos < l.last
            GROUP BY {lk}, l.pos, l.tag)"""


def html_items_chain(p: str, src: str, keys: str, drop_notes=False) -> str:
    """CTE ``{p}base(keys, item_idx, kind, text)``: default-cleaned, de-duplicated items.
    Needs ``ent``."""
    return f"""{token_chain(p, src, keys, 'html', drop_notes)},{leaf_chain(p, keys)},{clean_chain(p + 'c', p + 'leaf', keys + ', pos')},
{items_chain(p + 'c', p + 'cclean', keys + ', pos')},
{p}all AS (SELECT {keys}, pos, chunk, kind, text FROM {p}citems
           UNION ALL SELECT {keys}, pos, 0, 'scene', '***' FROM {p}kept WHERE {matches('t', r'(?i)^<hr[\s/>]')}),
{p}lag AS (SELECT *, lag(kind) OVER (PARTITION BY {keys} ORDER BY pos, chunk) AS prev FROM {p}all),
{p}base AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY pos, chunk))::INT - 1 AS item_idx, kind, text
            FROM {p}lag WHERE NOT (kind = 'scene' AND coalesce(prev, '') = 'scene'))"""


def variants_cte(rows) -> str:
    values = ", ".join(
        "(" + ", ".join(lit(v) if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows
    )
    return f"variants({P.VARIANT_COLUMNS}) AS (VALUES {values})"


def variant_items_chain(p: str, keys: str) -> str:
    """CTE ``{p}vi(keys, profile, variant, item_idx, kind, text)``; needs ``variants`` and
    ``{p}base``. Every paragraph is really cleaned a second time."""
    flags = ("join_soft_wrapped_lines, join_dialogue_continuations, merge_dialogue_paragraphs, "
             "aggressive_mode, collapse_extra_blank_lines, preserve_scene_breaks")
    vkeys = f"{keys}, profile, variant"
    return f"""
{p}fan AS (SELECT {vkeys}, {flags}, item_idx, kind, text FROM {p}base, variants
           WHERE kind <> 'scene' OR preserve_scene_breaks),
{p}fp AS (SELECT * FROM {p}fan WHERE kind = 'p'),
{clean_chain(p + 'v', p + 'fp', f'{vkeys}, {flags}, item_idx', 'text', 'join_soft_wrapped_lines',
             'join_dialogue_continuations', 'collapse_extra_blank_lines', 'preserve_scene_breaks')},
{p}again AS (SELECT {vkeys}, {flags}, item_idx, 'p' AS kind, cleaned AS text FROM {p}vclean WHERE cleaned <> ''
             UNION ALL SELECT {vkeys}, {flags}, item_idx, kind, text FROM {p}fan WHERE kind = 'scene'),
{p}folded AS ({merge_fold(p + 'again', f'{vkeys}, {flags}', 'item_idx', 'merge_dialogue_paragraphs', 'aggressive_mode')}),
{p}vi AS ({unfold(p + 'folded', vkeys)})"""
