from __future__ import annotations

import html as pyhtml
import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from quirework.functions import html as H
from quirework.functions import patterns as P

BLOCKS = set(P.BLOCK_TAGS)


def items_of(evaluate, fragments, drop_notes=False):
    got = evaluate(lambda c: H.raw_items(H.drop_boilerplate(H.tokens(c), drop_notes)), fragments)
    return [[(x.kind, x.text) for x in row] for row in got]


def random_fragment(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.random()
        if kind < 0.35 or depth > 4:
            out.append(rng.choice(["text", " &amp; ", "x", "<em>i</em>"]))
        elif kind < 0.42:
            out.append(rng.choice(["<hr/>", "<br/>", "<p/>"]))
        else:
            tag = rng.choice(["p", "div", "li", "blockquote", "span", "nav", "section"])
            attr = rng.choice(["", "", "", ' class="a notes b"', ' class="download"', ' id="notes"', " class='x'", ' class="notesx"'])
            out.append(f"<{tag}{attr}>{random_fragment(rng, depth + 1)}</{tag}>")
    return "".join(out)


def tree_leaves(fragment, drop_notes):
    """Leaf blocks by walking a tree."""
    root = ElementTree.fromstring(f"<root>{fragment}</root>")
    drop = set(P.DROP_CLASSES) | (set(P.NOTE_CLASSES) if drop_notes else set())

    def dropped(e):
        return (e.tag == "nav" or bool(drop & set(e.get("class", "").split()))
                or (drop_notes and e.get("id") in P.NOTE_IDS))

    def kept(e):
        for child in list(e):
            if dropped(child):
                e.remove(child) if not child.tail else (child.clear(), setattr(child, "tag", "gone"))
            else:
                kept(child)

    kept(root)
    return [e.tag for e in root.iter() if e is not root and e.tag in BLOCKS
            and not any(x is not e and x.tag in BLOCKS for x in e.iter())]


def test_leaves_agree_with_a_tree_walk(evaluate):
    rng = random.Random(11)
    fragments = [random_fragment(rng) for _ in range(1500)]
    for notes in (False, True):
        got = evaluate(lambda c: F.transform(H.leaf_blocks(H.drop_boilerplate(H.tokens(c), notes)), lambda b: b["tag"]), fragments)
        for f, tags in zip(fragments, got):
            # an empty element without end tag counts as a leaf in the tree but has no text
            want = tree_leaves(f, notes)
            assert len(tags) <= len(want)
            if "<p/>" not in f:
                assert tags == want, f


def test_items(evaluate):
    fragments = [
        '<div>lost<p>One <em>and</em> two</p><hr/><hr class="x"/><p>a<br/>b</p></div>',
        '<div class="notes"><div><p>N</p></div></div><p>kept</p>',
        "<ul><li>x</li><li><p>y</p></li></ul><table><tr><td>cell</td></tr></table>",
        "<p>A</p><!-- <p>no</p> --><p>B<!-- x -->C</p>",
        '<p title="a > b">t</p>',
        "<P>Upper</P>",
        "<p>one<p>two</p>",
    ]
    assert items_of(evaluate, fragments) == [
        [("p", "One and two"), ("scene", "***"), ("p", "a b")],
        [("p", "N"), ("p", "kept")],
        [("p", "x"), ("p", "y")],
        [("p", "A"), ("p", "B C")],
        [("p", "t")],
        [("p", "Upper")],
        [("p", "two")],
    ]
    assert items_of(evaluate, fragments[1:2], True) == [[("p", "kept")]]


def test_boilerplate_with_nested_and_unclosed_tags(evaluate):
    def kept(f):
        return evaluate(lambda c: F.array_join(H.drop_boilerplate(H.tokens(c)), ""), [f])[0]

    assert kept('<div class="actions"><div>a</div>b</div>c') == "c"
    assert kept('<div class="actions"><p>a<br></div>c') == "c"
    assert kept('<ul class="download"><li>a') == ""
    assert kept('<img class="download">c<nav/>d') == "cd"
    assert kept('a<nav>x</nav>' * 30000) == "a" * 30000
    assert kept("<p>nothing</p>") == "<p>nothing</p>"


def test_entities(evaluate):
    values = ["a &amp; b", "&amp;lt;", "&#65;&#x42;", "&eacute;&nbsp;&hellip;&mdash;", "&bogus; &", "&#128512;", "&apos;&quot;", "&#0;&#xD800;&#99999999;", "&;&#;"]
    got = evaluate(H.decode_entities, values)
    assert got[:7] == [pyhtml.unescape(v) for v in values[:7]]
    assert got[7:] == ["�" * 3, "&;&#;"]
    raw = ["<a href=\"x\">it's & more</a>", "&lt;"]
    assert evaluate(H.escape_html, raw) == [pyhtml.escape(v) for v in raw]
    assert evaluate(lambda c: H.decode_entities(H.escape_html(c)), raw) == raw


def test_references_of_html_5(evaluate):
    from html.entities import html5

    every = [f"x&{n}" for n in html5] + [f"&{n}z" for n in html5]
    rng = random.Random(1)
    names = [n.strip(";") for n in html5 if not n.endswith(";")] + ["notin", "amplt", "Aacut", "x"]
    mixed = ["".join(rng.choice(["&", ";", "#", "x", "1", "8", "0", " ", "=", rng.choice(names), "&" + rng.choice(names), "&#" + str(rng.randrange(200)),
                                 "&#x" + "%x" % rng.randrange(0x110100)]) for _ in range(8)) for _ in range(800)]
    assert evaluate(H.decode_entities, every + mixed) == [pyhtml.unescape(v) for v in every + mixed]


def test_visible_text_is_told_without_decoding(evaluate):
    from html.entities import html5

    rng = random.Random(4)
    names = [f"&{n}" for n in html5]
    numbers = [f % n for n in [*range(0x3010), *range(0xFDC0, 0xFE00), 0xFFFD, 0x1FFFE, 0x10FFFF, 0x110000]
               for f in ("&#%d;", "&#00%d", "&#x%x;", "&#X0%X")]
    parts = ["&nbsp", "&nbsp;", "&Tab;", "&tab;", "&", "&#", ";", " ", "\u3000", "\x85", "&#32", "&#x20", "&#160;", "&#133;", "&#1;", "4", "a", "x;"]
    mixed = ["".join(rng.choice(parts[: 18 if k % 2 else 9]) for _ in range(rng.randrange(5))) for k in range(2000)]
    values = names + numbers + mixed + ["&nbsp;" * 100_000, " &#9;" * 100_000 + "."]
    got = evaluate(lambda c: H.has_content(H.tokens(F.concat(F.lit("<p>"), c, F.lit("</p>")))), values)
    assert [v for v, g in zip(values, got) if g != (pyhtml.unescape(v).strip(P.SPACE_CHARS) != "")] == []
    cdata = ["<p><![CDATA[&nbsp;]]></p>", "<p><![CDATA[ \n]]>&nbsp;</p>", "<p> <!-- a --></p>", "<p>\n<i></i>&#32;<b>x</b></p>"]
    assert evaluate(lambda c: H.has_content(H.tokens(c)), cdata) == [True, False, False, True]


def test_references_in_attributes(evaluate):
    values = {"?a=1&copy=2&amp;b&lt;c": "?a=1&copy=2&b<c", "&copy": "\u00a9", "&copy x": "\u00a9 x", "&notit;": "&notit;", "&copyx": "&copyx", "&#65&#x42=": "AB="}
    got = evaluate(lambda c: H.attribute(F.concat(F.lit('<a href="'), c, F.lit('">')), "href"), list(values))
    assert got == list(values.values())


def test_script_style_and_body(evaluate):
    values = [
        '<html><head><script>var a="</p><body>";</script><style>p{}</style></head><body class="x"> <p>A</p> </body></html>',
        "<body><p>open end",
        "<p>no body</p>",
        "<body>a<!-- <script> -->b<script/>c<SCRIPT x='1'>d</SCRIPT>e</body>",
        "<html><body>  </body></html>",
        "<scripty>x</scripty>",
    ]
    assert evaluate(H.body_content, values) == [
        "<p>A</p>", "<p>open end", "<p>no body</p>", "a<!-- <script> -->bce", "", "<scripty>x</scripty>"]


def test_first_heading(evaluate):
    values = ["<h2> </h2><h3>Three <b>3</b></h3><h1>One</h1>", "<h4>x</h4>", "<h1>A &amp;<br/>B</h1>", "<header>no</header><h1 id='x'>yes</h1>"]
    assert evaluate(H.first_heading, values) == ["Three 3", "", "A & B", "yes"]


def test_duplicate_heading(spark):
    rows = [
        ("<p>chapter  ONE</p>\n<p>text</p>", "Chapter One", "<p>text</p>"),
        ("<p>Chapter One</p>", " Chapter One ", ""),
        ("<p>Stra&szlig;e</p>\n<p>x</p>", "STRASSE", "<p>x</p>"),
        ("<p>A &amp; B</p>\n<p>x</p>", "a & b", "<p>x</p>"),
        ('<hr class="scene-break" />\n<p>T</p>', "T", '<hr class="scene-break" />\n<p>T</p>'),
        ("<p>T</p>\n<p>x</p>", "", "<p>T</p>\n<p>x</p>"),
        ("<p>Other</p>", "T", "<p>Other</p>"),
        ("", "T", ""),
    ]
    df = spark.createDataFrame(rows, "h string, t string, want string")
    for r in df.select("want", H.strip_duplicate_heading(F.col("h"), F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_legacy_paragraphs(evaluate):
    got = evaluate(lambda c: H.legacy_paragraphs(H.tokens(c)), ["<p>a \t b<i>c</i>\n \n\nd</p><p> </p><p>open<div>x</div>"])
    assert got == [["a b c \nd", "open"]]


def test_comments_cdata_and_quoting(evaluate):
    heads = ["<!-- <h1>Old</h1> --><h2>New</h2>", "<h1>open <h2>Two</h2>", "<H3\nid=x>a <b>b</b></H3>", "<h1></h1><h2> </h2>"]
    assert evaluate(H.first_heading, heads) == ["New", "Two", "a b", ""]
    bodies = ["<!-- <body>no</body> --><body data-x=\"a>b\"><p>x</p></body>tail", "<!-- <body> --><p>y</p>", "<BODY\n>z"]
    assert evaluate(H.body_content, bodies) == ["<p>x</p>", "<!-- <body> --><p>y</p>", "z"]
    texts = ["a <![CDATA[b > &amp; c]]> d &amp;", "<![CDATA[]]>"]
    assert evaluate(H.element_text, texts) == ["a b > &amp; c d &", ""]
    tags = ['<a HREF=/x>', "<a title=' href=no' href = 'y&amp;z'>", '<a data-href="no">', '<a href="">', "<a href=>"]
    assert evaluate(lambda c: H.attribute(c, "href"), tags) == ["/x", "y&z", "", "", ""]
    tags = ['<p class="page-title heading">', "<p class='heading title x'>", "<p class=title>"]
    assert evaluate(lambda c: H.has_class(c, "title", "heading"), tags) == [False, True, False]
