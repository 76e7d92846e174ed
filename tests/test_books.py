from __future__ import annotations

from pyspark.sql import functions as F

from quirework import settings as S
from quirework.functions import naming as N
from quirework.operators import books as B
from quirework.operators import layout as L
from quirework.operators import variants as V


def sections(spark, rows):
    return spark.createDataFrame(rows, "book_id string, section_idx bigint, heading string, html string")


def books(spark, rows):
    return spark.createDataFrame(rows, "book_id string, used_title string, used_author string")


SECTIONS = [
    ("b", 3, "Two", "<p>x_y</p><hr/><p>last*</p>"),
    ("b", 1, "Title", "<p>title</p>"),
    ("b", 2, "", '<p>"Hi,"</p><p>she said.</p>'),
    ("c", 1, "E", "<div>lost<p/></div><nav><p>n</p></nav>"),
    ("c", 9, "Z", "<p>zz</p>"),
    ("d", 1, "none", "<table/>"),
]
BOOKS = [("b", "A <b>", "Me_1"), ("c", "C", " "), ("d", "D", "x")]


def test_slugs(evaluate):
    values = ["Running on Air", "  My Weird Book_v2 ", "é½ñ_x--y", "!!!", "", "a  b", "-_-"]
    assert evaluate(N.slugify, values) == [
        "running-on-air", "my-weird-book-v2", "é½ñ-x-y", "book", "book", "a-b", "book"]


def test_book_slug(spark):
    rows = [
        ("Running on Air", "eleventy7", None, "eleventy7__running-on-air"),
        (None, None, "My Weird Book_v2", "my-weird-book-v2"),
        ("", "", None, "book"),
        ("T", None, "x", "t"),
        (None, "!", "x", "book"),
    ]
    df = spark.createDataFrame(rows, "t string, a string, s string, want string")
    for r in df.select("want", N.book_slug(F.col("t"), F.col("a"), F.col("s")).alias("got")).collect():
        assert r.got == r.want


def test_paths_and_names(spark, evaluate):
    paths = {
        r"C:\books\eleventy7__running-on-air_output\eleventy7__running-on-air__interior.pdf": "eleventy7__running-on-air",
        r"C:\books\running-on-air_output\interior.pdf": "running-on-air",
        "/x/_output/interior.pdf": "book",
        "/x/plain/interior.pdf": "plain",
        "interior.pdf": "book",
        "/x/My Book.v2.pdf": "my-bookv2",
        "noext": "noext",
    }
    assert evaluate(N.slug_from_path, list(paths)) == list(paths.values())
    slug = F.lit("eleventy7__running-on-air")
    row = spark.range(1).select(N.interior_name(slug), N.imposed_name(slug, F.lit(4), F.lit(16))).first()
    assert list(row) == ["eleventy7__running-on-air__interior.pdf", "eleventy7__running-on-air__imposed__4sheets__16pages.pdf"]
    names = ["", " .a<b>  c. ", "x/y:z", "\t"]
    assert evaluate(N.safe_component, names) == ["Unknown", "ab c", "xyz", "Unknown"]
    assert evaluate(N.safe_download_name, names + ["q" * 200]) == ["ao3_work", ".a_b_ c.", "x_y_z", "ao3_work", "q" * 180]
    assert evaluate(N.safe_underscored, names) == ["book", ".a_b__c.", "x_y_z", "book"]


def test_first_metadata_value_decides(spark):
    df = spark.createDataFrame(
        [("a", 2, "Second", "S"), ("a", 1, "", None), ("b", 5, " T ", " A "), ("b", 7, "x", "y")],
        "book_id string, pos int, title string, creator string")
    got = {r.book_id: r[1:] for r in B.book_metadata(df).collect()}
    assert got == {"a": ("Unknown Title", "Unknown Author"), "b": ("T", "A")}


def joined(parts, content):
    """The document of each book from its parts."""
    out = {}
    for r in sorted(parts.collect(), key=lambda r: (r.book_id, r.part_no)):
        out[r.book_id] = out.get(r.book_id, "") + r[content]
    return out


def test_documents_in_parts(spark):
    cleaned = B.clean_section_html(B.section_items(sections(spark, SECTIONS)), True)
    blocks = B.section_blocks(cleaned)
    marked = {(r.book_id, r.section_idx): "first-body" in r.block for r in blocks.collect()}
    assert marked == {("b", 2): True, ("b", 3): False, ("c", 9): True}
    named = books(spark, BOOKS)
    parts = B.html_documents(cleaned, named, B.stylesheet())
    numbers = sorted(r.part_no for r in parts.filter("book_id = 'b'").collect())
    assert numbers == [B.FRONT, 2, 3, B.END]
    whole = joined(parts, "html")
    assert {"b", "c"} <= set(whole)
    assert "<title>A &lt;b&gt;</title>" in whole["b"]
    assert whole["b"].index("she said.") < whole["b"].index("x_y") and whole["b"].endswith("</body>\n</html>\n")
    assert '<section class="chapter"><h1 class="chapter-title">Two</h1><p>x_y</p>\n<hr class="scene-break" />\n<p>last*</p></section>' in whole["b"]


def test_no_book_is_lost(spark):
    """A book whose sections clean to nothing, one without metadata, one without sections."""
    rows = spark.createDataFrame(
        [("empty", 1, "", ""), ("anon", 4, "H", "<p>text</p>")], "book_id string, section_idx bigint, heading string, html string")
    named = spark.createDataFrame([("empty", "E", "A"), ("bare", "B", "")], "book_id string, used_title string, used_author string")
    whole = joined(B.html_documents(rows, named, "css"), "html")
    assert set(whole) == {"empty", "anon", "bare"}
    assert "<h1>Unknown Title</h1>" in whole["anon"] and "<p>text</p>" in whole["anon"]
    assert all('class="title-page"' in x and x.endswith("</html>\n") for x in whole.values())
    assert "<section class=\"chapter" not in whole["empty"] + whole["bare"]
    texts = rows.select("book_id", "section_idx", "heading", F.when(F.col("book_id") == "anon", "text").otherwise("").alias("text"))
    assert joined(B.markdown_documents(texts, named), "markdown") == {
        "empty": "# E\n\n_By A_\n", "bare": "# B\n", "anon": "# Unknown Title\n\n_By Unknown Author_\n\n## H\n\ntext\n"}


def test_markdown(spark):
    texts = B.clean_section_text(B.section_items(sections(spark, SECTIONS)))
    got = joined(B.markdown_documents(texts, books(spark, BOOKS)), "markdown")
    assert got["b"] == (
        "# A <b>\n\n_By Me\\_1_\n\n## Title\n\ntitle\n\n\n\"Hi,\"\n\nshe said.\n\n\n## Two\n\nx\\_y\n\n***\n\nlast\\*\n")
    assert got["c"] == "# C\n\n## Z\n\nzz\n"


def test_styled_paragraphs(spark):
    texts = B.clean_section_text(B.section_items(sections(spark, SECTIONS)))
    rows = B.styled_paragraphs(texts, books(spark, BOOKS), S.spacing_modes(spark)).collect()
    mine = sorted((r for r in rows if r.book_id == "b" and r["mode"] == "traditional"), key=lambda r: (r.section_idx, r.para_idx))
    assert [(r.role, r.indent_pt, r.after_pt) for r in mine] == [
        ("title", 0, 0), ("author", 0, 0),
        ("heading", 0, 20.7), ("body", 0, 7.475),
        ("body", 0, 7.475), ("body", 13.8, 7.475),
        ("heading", 0, 20.7), ("body", 0, 7.475), ("scene", 0, 13.8), ("body", 0, 7.475),
    ]
    assert not any(r.role == "author" for r in rows if r.book_id == "c")
    assert all(r.indent_pt == 0 for r in rows if r["mode"] in ("uniform", "no-indents"))


def test_profiles_differ_where_they_should(spark):
    html = '<p>"Hi,"</p><p>she said.</p><p>A<br/>b</p>'
    base = B.section_items(sections(spark, [("b", 1, "h", html)]))
    rows = B.clean_section_text(B.fan_out(base, S.variant_groups(spark))).collect()
    text = {(r.profile, r.variant): r.text for r in rows}
    assert len(text) == len(S.VARIANTS)
    assert text["app", "standard"] == text["app", "aggressive-cleanup"] == text["script", "standard"] == text["script", "edit-friendly"]
    assert text["script", "aggressive-cleanup"] == text["app", "paragraph-dialogue-merge"] == '"Hi," she said.\n\nA b'
    assert text["script", "standard"] == '"Hi,"\n\nshe said.\n\nA b'


def layouts(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "layout_id int, spacing string, margin string, size string, custom_width double, custom_height double, "
        "custom_top double, custom_bottom double, custom_inside double, custom_outside double")


def test_layouts(spark):
    none = (None,) * 6
    got = L.resolve_layouts(layouts(
        spark, ("traditional", None, "", *none), ("uniform", " Compact ", "A5", *none), ("", "odd", "a4", *none), ("", "wide", "x", *none),
        ("", "custom", "a4", *none), ("", "custom", "a4", None, None, 1.0, 1.0, 0.0, 1.0), ("", "wide", "custom", 10.0, -1.0, *none[:4]),
        ("", "custom", "custom", 10.0, 12.0, 1.0, 2.0, 3.0, 4.0))).orderBy("layout_id").collect()
    assert [r.error for r in got] == [
        None, None, "unknown_margins", "unknown_page_size", "custom_margins_missing", "custom_margins_not_positive",
        "custom_size_not_positive", None]
    assert (got[0].width_cm, got[0].inside_cm, got[1].height_cm, got[1].top_cm) == (15.24, 1.8, 21.0, 1.2)
    assert (got[7].width_cm, got[7].bottom_cm, got[7].outside_cm) == (10.0, 2.0, 4.0)


def test_page_estimate(spark):
    caps = L.with_capacity(L.resolve_layouts(layouts(spark, ("traditional", "standard", "default-trade", *(None,) * 6))))
    c = caps.first()
    # 12.44 cm at half of 11.5 pt per character; 19.86 cm at 11.5 * 1.35 pt per line
    assert (c.chars_per_line, c.lines_per_page, c.gap_hundredths) == (61, 36, 65)
    items = [("p", "x" * 61)] * 21 + [("p", "x" * 62)]
    df = spark.createDataFrame([("b", 1, items), ("b", 2, [("p", "y")])], "book_id string, section_idx int, items array<struct<kind:string,text:string>>")
    wanted = caps.select(F.lit("b").alias("book_id"), "layout_id")
    r = L.page_estimate(df, wanted, caps).first()
    assert (r.pages, r.sections) == (2 + 2 + 1, 2)  # 23 lines and 22 gaps need two pages


def test_preview_and_changes(spark):
    long = "word " * 500
    rows = [("b", i, f"h{i}", f"<p>{long}\nend</p>") for i in range(5)] + [("c", 1, "h", "<p>same</p>")]
    samples = V.preview_samples(sections(spark, rows)).orderBy("book_id", "sample_no").collect()
    assert [(r.book_id, r.sample_no, r.heading) for r in samples] == [("b", 1, "h0"), ("b", 2, "h1"), ("b", 3, "h2"), ("c", 1, "h")]
    assert samples[0].before.endswith("word wo...") and len(samples[0].after) <= 1400
    found = V.changed_sections(sections(spark, rows), S.variant_groups(spark, "script")).collect()
    got = {(r.book_id, r.variant): (r.n_sections, r.n_changed) for r in found}
    assert len(got) == 10
    assert (got["b", "standard"], got["c", "standard"]) == ((5, 5), (1, 0))
    assert got["b", "edit-friendly"] == (5, 5)  # it strips line ends, but joins nothing


def test_baseline_deltas_are_zero_for_the_baseline(spark):
    df = spark.createDataFrame(
        [("b", 1, "standard", 10, 100), ("b", 1, "other", 8, 90), ("c", 1, "other", 5, 50)],
        "book_id string, layout_id int, variant string, pages bigint, html_bytes bigint")
    got = {(r.book_id, r.variant): (r.page_delta, r.byte_delta) for r in V.with_baseline(df, ["book_id", "layout_id"]).collect()}
    assert got == {("b", "standard"): (0, 0), ("b", "other"): (-2, -10), ("c", "other"): (None, None)}


def test_unknown_variants_and_failures(spark):
    jobs = spark.createDataFrame([("b", "standard", 0), ("b", "nope", 0), ("c", "standard", 0), ("c", "standard", 1)], "book_id string, variant string, layout_id int")
    counts = spark.createDataFrame([("b", 2), ("c", 0)], "book_id string, n_sections int")
    res = L.resolve_layouts(layouts(spark, ("", "wide", "a4", *(None,) * 6), ("", "bad", "a4", *(None,) * 6)))
    status = V.run_status(jobs, counts, S.variants(spark), res)
    got = {(r.book_id, r.variant, r.layout_id): r.error for r in status.collect()}
    assert got == {("b", "standard", 0): None, ("b", "nope", 0): "unknown_variant",
                   ("c", "standard", 0): "no_readable_sections", ("c", "standard", 1): "unknown_margins"}
    assert {r.book_id: r.all_failed for r in V.book_outcomes(status).collect()} == {"b": False, "c": True}
    assert [r.variant for r in V.unknown_variants(jobs, S.variants(spark)).collect()] == ["nope"]


def test_stylesheets_of_all_modes_and_custom_boxes(spark):
    rows = [(mode, "standard", "a5", *(None,) * 6) for mode, *_ in S.SPACING_MODES] + [
        ("uniform", "custom", "custom", 10.0, 20.0, 1.0, 2.0, 3.0, 4.0), ("uniform", "custom", "a5", *(None,) * 6)]
    got = B.layout_stylesheets(L.resolve_layouts(layouts(spark, *rows))).collect()
    css = {r.layout_id: r.css for r in got}
    assert len(css) == 5  # the incomplete custom layout is rejected
    for i, (mode, *_rest) in zip(sorted(css), rows, strict=False):
        box = dict(zip(B.BOX, (10.0, 20.0, 1.0, 2.0, 3.0, 4.0), strict=True)) if i == sorted(css)[4] else None
        assert css[i] == B.stylesheet(mode, "a5", "standard", box)
    assert "$" not in "".join(css.values())


def test_marks_agree_with_the_cleaned_sections(spark):
    html = ["", " ", "<p></p>", "<p> &nbsp;\n</p>", "<p>&#32;</p><hr/>", "<p>Title</p>", "<p>Tit</p><p>le</p>", "<p> title</p><hr>", "<p>TITLE</p><p>x</p>",
            "<nav><p>a</p></nav>", "<nav><hr/></nav><p> </p>", "<div class='notes'><p>n</p></div>", "text only", "<li>Title</li>", "<p>***</p>", "<p>Strasse</p>",
            "<p>\u200b</p>", "<div>Ti<b>tle</b></div>", "<p>Tit,</p><p>le</p>"]
    rows = [(f"b{h}", i, h, x) for h in ("", "Title", "Stra\u00dfe", "Tit, le") for i, x in enumerate(html)]
    df = spark.createDataFrame(rows, "book_id string, section_idx int, heading string, html string")
    for notes in (False, True):
        for repeat in (False, True):
            cleaned = B.clean_section_html(B.section_items(df, notes), repeat)
            want = {(r.book_id, r.section_idx): bool(r.html.strip()) for r in cleaned.collect()}
            marks = B.section_marks(df, notes, repeat).collect()
            assert {(r.book_id, r.section_idx): r.filled for r in marks} == want
    names = books(spark, [("bTitle", "T", "A")])
    cleaned, marks = B.clean_section_html(B.section_items(df), True), B.section_marks(df, False, True)
    for with_marks, without in ((B.html_documents(cleaned, names, "css", marks), B.html_documents(cleaned, names, "css")),
                                (B.section_blocks(cleaned, marks), B.section_blocks(cleaned))):
        assert sorted(map(tuple, with_marks.collect())) == sorted(map(tuple, without.collect()))
