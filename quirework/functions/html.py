"""HTML sections as arrays of tokens: no tree, no Python, one pass per section.

A token is a comment, a tag or a run of text. Block structure is read off neighbouring
block tags: a block is a leaf when the next block tag after its opening is its closing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P
from .entities import blank_reference, decode
from .expr import fold_text, indices, let, let_all
from .merge import ITEMS_TYPE, paragraph_items, scene_item, dedupe_scene_breaks
from .text import py_strip, squeeze_spaces

_TAG = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|<[^<>]*+>"""
_CDATA = r"<!\[CDATA\[.*?\]\]>"
_TOKEN = rf"(?s)<!--.*?-->|{_CDATA}|{_TAG}|[^<]++"
_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def tokens(html_col: Column) -> Column:
    return F.regexp_extract_all(html_col, F.lit(_TOKEN), F.lit(0))


def is_text(token: Column) -> Column:
    return ~token.startswith("<") | token.startswith("<![CDATA[")


def token_text(token: Column) -> Column:
    """The text a text token stands for; nothing is decoded inside CDATA."""
    inner = F.substring(token, F.lit(10), F.length(token) - 12)
    return F.when(token.startswith("<![CDATA["), inner).otherwise(decode_entities(token))


def is_visible(token: Column) -> Column:
    """Whether the text of a text token has a character that is no white space; told without
    decoding it."""
    inner = F.substring(token, F.lit(10), F.length(token) - 12)
    return F.when(token.startswith("<![CDATA["), inner.rlike(rf"[^{P.SPACE}]")).otherwise(
        token.rlike(rf"(?s)^(?:[{P.SPACE}]++|{blank_reference()})*+."))


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of a tag's attribute, or an empty string. The value may stand in double,
    single or no quotes; what only looks like an attribute inside another value is not one."""
    def find(t):
        names = F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(1))
        values = F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(2))
        pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.lower(x["n"]) == name)
        raw = F.coalesce(F.get(pairs, F.lit(0))["v"], F.lit(""))
        return decode(F.regexp_replace(raw, r"(?s)^([\"'])(.*)\1$", "$2"), attribute=True)

    return F.when(tag.rlike(rf"(?i)\s{name}\s*="), let(tag, find)).otherwise("")


def has_class(tag: Column, *words: str) -> Column:
    """Whether all words are among the class names of a tag."""
    return let(F.split(attribute(tag, "class"), r"\s+"), lambda names: F.forall(
        F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(names, w)))


def after_tag(ts: Column, start: Column, end_tag: str) -> Column:
    """Tokens behind position ``start`` up to the next ``end_tag``, or to the end."""
    closing = rf"(?i)^</{end_tag}[\s>]"
    stop = F.get(F.filter(indices(ts), lambda k: (k > start) & F.get(ts, k).rlike(closing)), F.lit(0))
    return F.slice(ts, start + 2, F.coalesce(stop, F.size(ts)) - start - 1)


# --- whole-string operations ------------------------------------------------------


def strip_script_style(html_col: Column) -> Column:
    """Delete script and style elements with their content. Comments are left alone here:
    a script inside a comment is not an element, and a comment ends a text run."""
    pattern = (
        r"(?is)(<!--.*?-->)"
        r"|<(?:script|style)(?:\s[^>]*)?/>"
        r"|<script(?:\s[^>]*)?>.*?</script\s*>"
        r"|<style(?:\s[^>]*)?>.*?</style\s*>"
    )
    return F.regexp_replace(html_col, pattern, "$1")


def body_content(html_col: Column) -> Column:
    """Content of ``body`` (up to its end tag or the end of input), or everything."""
    def inside(t):
        opening = F.get(F.filter(indices(t), lambda i: F.get(t, i).rlike(r"(?i)^<body[\s/>]")), F.lit(0))
        return let(opening, lambda i: F.when(i.isNotNull(), F.array_join(after_tag(t, i, "body"), "")))

    return let(
        strip_script_style(html_col),
        lambda h: py_strip(F.when(
            h.rlike(r"(?i)<body[\s/>]"), F.coalesce(let(tokens(h), inside), h)).otherwise(h)),
    )


def tokens_text(ts: Column) -> Column:
    """Decoded, stripped, non-empty text runs of some tokens, joined by blanks."""
    runs = F.transform(F.filter(ts, is_text), lambda t: py_strip(token_text(t)))
    return F.array_join(F.filter(runs, lambda t: t != ""), " ")


def element_text(fragment: Column) -> Column:
    return tokens_text(tokens(fragment))


def first_heading(body: Column) -> Column:
    """First non-empty h1, h2 or h3 in document order, or an empty string. An element reaches
    to its own end tag, with no other heading tag in between."""
    def build(t):
        at = F.filter(indices(t), lambda i: F.get(t, i).rlike(r"(?i)^</?h[123][\s/>]"))

        def pick(ev):
            name = lambda k: tag_name(F.get(t, F.get(ev, k)))
            whole = F.filter(indices(ev), lambda k: ~F.get(t, F.get(ev, k)).startswith("</") & F.coalesce(
                F.get(t, F.get(ev, k + 1)).startswith("</") & (name(k) == name(k + 1)), F.lit(False)))
            texts = F.transform(whole, lambda k: tokens_text(
                F.slice(t, F.get(ev, k) + 2, F.get(ev, k + 1) - F.get(ev, k) - 1)))
            return F.coalesce(F.get(F.filter(texts, lambda x: x != ""), F.lit(0)), F.lit(""))

        return let(at, pick)

    return let(tokens(body), build)


# --- character references ---------------------------------------------------------


def decode_entities(c: Column) -> Column:
    """Named and numeric character references of a text, each decoded once, left to right."""
    return decode(c)


def escape_html(c: Column) -> Column:
    # fixed values: the escapes
    escapes = (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    )

    def escaped(t):
        out = t
        for raw, reference in escapes:
            out = F.replace(out, F.lit(raw), F.lit(reference))
        # a replacement looks at every byte; most texts need none, which one pass tells
        return F.when(t.rlike("[&<>\"']"), out).otherwise(t)

    return let(c, escaped)


# --- boilerplate ------------------------------------------------------------------


def _attr_has_token(token: Column, attr: str, values) -> Column:
    guard = F.contains(token, F.lit("=")) & token.rlike(rf"(?i)\s{attr}\s*=") & token.rlike(P.any_of(values))
    words = F.array(*[F.lit(v) for v in values])
    return guard & F.arrays_overlap(F.split(attribute(token, attr), r"\s+"), words)


def _attr_is(token: Column, attr: str, values) -> Column:
    return token.rlike(P.any_of(values)) & attribute(token, attr).isin(*values)


def is_boilerplate_tag(token: Column, drop_notes: bool) -> Column:
    """An opening tag whose element is to be removed."""
    classes = P.DROP_CLASSES + (P.NOTE_CLASSES if drop_notes else ())
    hit = _attr_has_token(token, "class", classes)
    if drop_notes:
        hit = hit | _attr_is(token, "id", P.NOTE_IDS)
    named = token.rlike(rf"(?i)^<(?:{P.any_of(P.DROP_TAGS)})[\s/>]")
    return _may_be_tag(token) & (named | (F.contains(token, F.lit("=")) & token.rlike(r"^<[A-Za-z]") & hit))


def _may_be_tag(token: Column) -> Column:
    """A pattern is tried at every character of a text, also if only the first one may match it."""
    return token.startswith("<")


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9:_.\-]*)", 1))


def _drop_flags(ts: Column, hits: Column) -> Column:
    """A flag for each token: ``d`` inside (or bounding) an element to remove, else ``k``.
    ``hits`` tells which tokens open one.

    The end of an element is found by counting tags of its own name, so unclosed tags of
    other names inside it do no harm; without an end tag it reaches to the end. Only tags that
    share their name with one that opens such an element are walked over.
    """

    def feature(i):
        t = F.get(ts, i)
        return let(
            tag_name(t),
            lambda name: F.struct(
                i.alias("pos"),
                name.alias("name"),
                F.when(name == "", 0)
                .when(t.startswith("</"), -1)
                .when(t.endswith("/>") | name.isin(*P.VOID_TAGS), 0)
                .otherwise(1)
                .alias("delta"),
                F.get(hits, i).alias("hit"),
            ),
        )

    def step(fs):
        def one(acc, i):
            f = F.get(fs, i)
            outside = acc["depth"] == 0
            opens = outside & f["hit"]
            depth = (
                F.when(opens, f["delta"])
                .when(~outside & (f["name"] == acc["name"]), acc["depth"] + f["delta"])
                .otherwise(acc["depth"])
            )
            state = {"name": F.when(opens, f["name"]).otherwise(acc["name"]), "depth": depth}
            # the token itself, and those up to the next one that is walked over
            flag = F.when(outside & ~f["hit"], "k").otherwise("d")
            following = F.when(depth == 0, "k").otherwise("d")
            upto = F.coalesce(F.get(fs, i + 1)["pos"], F.size(ts))
            return state, F.concat(flag, F.repeat(following, upto - f["pos"] - 1))

        return one

    zero = {"name": F.lit(""), "depth": F.lit(0)}

    def walk(fs):
        before = F.repeat(F.lit("k"), F.coalesce(F.get(fs, F.lit(0))["pos"], F.size(ts)))
        return F.regexp_extract_all(F.concat(before, fold_text(F.size(fs), zero, step(fs))), F.lit("."), F.lit(0))

    def of_names(tags):
        names = F.array_distinct(F.transform(F.filter(tags, lambda f: f["hit"]), lambda f: f["name"]))
        return let(names, lambda ns: let(F.filter(tags, lambda f: F.array_contains(ns, f["name"])), walk))

    tags = F.transform(F.filter(indices(ts), lambda i: _may_be_tag(F.get(ts, i))), feature)
    return let(tags, of_names)


def drop_boilerplate(ts: Column, drop_notes: bool = False) -> Column:
    """Tokens without navigation, landmark, action and download elements (and notes)."""

    def cut(t, hits):
        kept = let(
            _drop_flags(t, hits),
            lambda flags: F.filter(t, lambda x, i: F.get(flags, i) == "k"),
        )
        return F.when(F.exists(hits, lambda h: h), kept).otherwise(t)

    return let(ts, lambda t: let(
        F.transform(t, lambda x: is_boilerplate_tag(x, drop_notes)), lambda hits: cut(t, hits)))


# --- blocks -----------------------------------------------------------------------


def _is_block_tag(token: Column, names=P.BLOCK_TAGS) -> Column:
    return _may_be_tag(token) & token.rlike(rf"(?i)^</?(?:{P.any_of(names)})[\s/>]")


def _is_rule(token: Column) -> Column:
    return _may_be_tag(token) & token.rlike(r"(?i)^<hr[\s/>]")


def leaf_blocks(ts: Column) -> Column:
    """``struct(pos, tag, last)`` of the blocks that hold no other block.

    ``pos`` and ``last`` are the positions of the opening and closing tag. A self-closing
    block has no text, but it keeps the block around it from being a leaf.
    """

    def find(t):
        events = F.transform(
            F.filter(indices(t), lambda i: _is_block_tag(F.get(t, i))),
            lambda i: F.struct(
                i.alias("pos"),
                tag_name(F.get(t, i)).alias("tag"),
                F.get(t, i).startswith("</").alias("closes"),
                F.get(t, i).endswith("/>").alias("empty"),
            ),
        )

        def pick(ev):
            return F.transform(
                F.filter(
                    indices(ev),
                    lambda k: ~F.get(ev, k)["closes"]
                    & ~F.get(ev, k)["empty"]
                    & F.coalesce(F.get(ev, k + 1)["closes"], F.lit(False)),
                ),
                lambda k: F.struct(
                    F.get(ev, k)["pos"].alias("pos"),
                    F.get(ev, k)["tag"].alias("tag"),
                    F.get(ev, k + 1)["pos"].alias("last"),
                ),
            )

        return let(events, pick)

    return let(ts, find)


def rule_positions(ts: Column) -> Column:
    """Positions of ``hr`` tags."""
    return let(ts, lambda t: F.filter(indices(t), lambda i: _is_rule(F.get(t, i))))


def _inside(ts: Column, leaf: Column) -> Column:
    return F.slice(ts, leaf["pos"] + 2, leaf["last"] - leaf["pos"] - 1)


def block_text(ts: Column, leaf: Column) -> Column:
    """Text runs of a leaf, one per line, decoded but not stripped."""
    return F.array_join(F.transform(F.filter(_inside(ts, leaf), is_text), token_text), "\n")


def raw_items(ts: Column) -> Column:
    """Items in document order: cleaned paragraphs of leaves, and scenes for ``hr``."""

    def build(t):
        leaves = F.transform(
            leaf_blocks(t),
            lambda b: F.struct(b["pos"].alias("pos"), let(block_text(t, b), paragraph_items).alias("items")),
        )
        rules = F.transform(
            rule_positions(t),
            lambda i: F.struct(i.alias("pos"), F.array(scene_item()).cast(ITEMS_TYPE).alias("items")),
        )
        ordered = F.sort_array(F.concat(leaves, rules))
        return F.flatten(F.transform(ordered, lambda x: x["items"]))

    return dedupe_scene_breaks(let(ts, build))


def legacy_paragraphs(ts: Column) -> Column:
    """Older paragraph cleanup: every ``p`` up to the next block tag, its text runs joined
    by blanks; runs of blanks and of blank lines collapsed; empty paragraphs dropped."""

    def build(t):
        events = F.filter(indices(t), lambda i: _is_block_tag(F.get(t, i)))

        def pick(ev):
            spans = F.transform(
                F.filter(
                    indices(ev),
                    lambda k: F.get(t, F.get(ev, k)).rlike(r"(?i)^<p(?:\s[^>]*)?>"),
                ),
                lambda k: F.slice(
                    t,
                    F.get(ev, k) + 2,
                    F.coalesce(F.get(ev, k + 1), F.size(t)) - F.get(ev, k) - 1,
                ),
            )
            return F.filter(
                F.transform(
                    spans,
                    lambda inside: F.regexp_replace(
                        F.regexp_replace(
                            F.array_join(
                                F.transform(F.filter(inside, is_text), token_text), " "
                            ),
                            r"[ \t]+",
                            " ",
                        ),
                        rf"\n[{P.SPACE}]*\n+",
                        "\n",
                    ),
                ),
                lambda x: py_strip(x) != "",
            )

        return let(events, pick)

    return let(ts, build)


def has_content(ts: Column) -> Column:
    """Whether the tokens hold a leaf with a visible character, or a rule. This is so exactly when
    they have items, but it stops at the first one; it cleans and decodes nothing."""
    def visible(t):
        return F.exists(leaf_blocks(t), lambda b: F.exists(_inside(t, b), lambda x: is_text(x) & is_visible(x)))

    return let(ts, lambda t: F.exists(t, _is_rule) | visible(t))


def has_more_than(ts: Column, heading: Column) -> Column:
    """Whether the tokens hold a rule, or a leaf with characters that the heading lacks: without
    it, their items may be nothing but the heading."""
    def squeezed(c):
        return F.regexp_replace(_fold_for_compare(c), " ", "")

    def more(v):
        return F.exists(v["t"], _is_rule) | F.exists(
            leaf_blocks(v["t"]), lambda b: ~F.contains(v["h"], squeezed(block_text(v["t"], b))))

    return let_all({"t": ts, "h": squeezed(F.coalesce(heading, F.lit("")))}, more)


# --- rendering --------------------------------------------------------------------


def items_html(items: Column) -> Column:
    return F.array_join(
        F.transform(
            items,
            lambda x: F.when(x["kind"] == "scene", F.lit('<hr class="scene-break" />')).otherwise(
                F.concat(F.lit("<p>"), escape_html(x["text"]), F.lit("</p>"))
            ),
        ),
        "\n",
    )


def _fold_for_compare(c: Column) -> Column:
    return let(c, lambda t: F.replace(F.lower(squeeze_spaces(t)), F.lit("ß"), F.lit("ss")))


# where a text splits into lines
_LINE_ENDS = r"\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}"


def strip_duplicate_heading(html_col: Column, heading: Column) -> Column:
    """Drop the first paragraph when it only repeats the section heading.

    Only the first line is looked at, unless it has to go."""

    def body(v):
        first = py_strip(F.regexp_extract(v["html"], rf"^[{P.SPACE}]*+([^{_LINE_ENDS}]*+)", 1))
        repeats = let(first, lambda f: f.rlike(r"^<p>.*</p>\z") & let(
            F.regexp_extract(f, r"^<p>(.*)</p>\z", 1),
            lambda inner: _fold_for_compare(decode_entities(inner)) == _fold_for_compare(v["heading"])))
        lines = F.filter(
            F.split(v["html"], rf"\r\n|[{_LINE_ENDS}]"), lambda x: py_strip(x) != ""
        )
        rest = let(lines, lambda ls: py_strip(F.array_join(F.slice(ls, 2, F.size(ls)), "\n")))
        return F.when((py_strip(v["heading"]) != "") & repeats, rest).otherwise(v["html"])

    return let_all({"html": html_col, "heading": heading}, body)
