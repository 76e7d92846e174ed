"""Page breaks, page numbers, sheets of sections, unique slugs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from quirework import settings as S
from quirework.functions import typeset as Y
from quirework.operators import books as B
from quirework.operators import imposition as I
from quirework.operators import layout as L
from quirework.operators import pages as P
from quirework.operators.skew import running_totals, spread_ranks
from quirework.plans import registry

LAYOUT = ("layout_id int, spacing string, margin string, size string, custom_width double, custom_height double, "
          "custom_top double, custom_bottom double, custom_inside double, custom_outside double")


def width(word):
    return sum(next((w for w, chars in Y.WIDTHS if c in chars), Y.DEFAULT_WIDTH) for c in word)


def lines_of(text, measure, indent):
    lines, used = 0, None
    for size in map(width, text.split()):
        if used is not None and used + 250 + size <= measure:
            used += 250 + size
        else:
            used = (indent if lines == 0 else 0) + size
            lines += 1
    return lines


def pages_of(items, heading, box):
    """Line by line: a line opens a page if there is no room, and a paragraph may be cut at a line
    only with two lines on either side (or on a page of two lines and less, anywhere)."""
    full = box["lines_per_page"] * 100
    h = lines_of(heading, box["heading_measure"], 0)
    used = round(h * 145 + 261) if h else 0
    starts = [(0, 0)]
    for i, (kind, text) in enumerate(items):
        if kind == "scene":
            if used and used + Y.SCENE_HEIGHT > full:
                starts.append((i, 0))
                used = 0
            used += Y.SCENE_HEIGHT
            continue
        follows = i > 0 and items[i - 1][0] == "p"
        n, done = lines_of(text, box["measure"], box["indent"] if follows else 0), 0
        while n - done:
            room = max(0, full - used) // 100
            if n - done <= room:
                used += (n - done) * 100 + box["gap_hundredths"]
                done = n
                continue
            cuts = [c for c in range(2, room + 1) if n - done - c >= 2]
            if not cuts and not used:
                cuts = [room]
            done += max(cuts, default=0)
            starts.append((i, done))
            used = 0
    return starts


@pytest.fixture(scope="module")
def book(spark):
    """Sections with random items, one very long paragraph and one of a word wider than a line."""
    rng = random.Random(11)
    words = ["lorem", "I", "Wim", "mmmmm", "ill", "é", "end.", "—", "a", "quick,", "W" * 60]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = []
    for s in range(60):
        items = []
        for _ in range(rng.randint(0 if s % 9 else 0, 14)):
            if rng.random() < 0.2 and items and items[-1][0] == "p":
                items.append(("scene", "***"))
            else:
                items.append(("p", text(rng.choice([1, 3, 8, 20, 30, 60, 400]))))
        rows.append((f"b{s % 3}", s * 70_000, rng.choice(["", text(3), text(40)]), items))
    df = spark.createDataFrame(rows, "book_id string, section_idx int, heading string, items array<struct<kind:string,text:string>>")
    layouts = spark.createDataFrame(
        [(1, "traditional", "custom", "custom", 8.0, 8.0, 1.0, 1.0, 1.0, 1.0), (2, "uniform", "custom", "custom", 8.0, 4.0, 1.0, 1.0, 1.0, 1.0),
         (3, "no-indents", "standard", "a6", *[None] * 6), (4, "uniform", "custom", "custom", 5.0, 2.6, 1.0, 1.0, 1.0, 1.0),
         (5, "uniform", "custom", "custom", 8.0, 4.0, 1.0, 1.0, 1.0, 1.0), (6, "x", "x", "x", *[None] * 6)], LAYOUT)
    boxes = P.with_measure(L.resolve_layouts(layouts))
    wanted = df.select("book_id").distinct().crossJoin(layouts.select("layout_id"))
    return rows, df, wanted, boxes


def test_page_breaks_against_a_line_by_line_model(book):
    rows, df, wanted, boxes = book
    box = {r.layout_id: r.asDict() for r in boxes.filter("status = 'ok'").collect()}
    assert box[4]["lines_per_page"] == 1 and box[2]["lines_per_page"] == 3
    got = defaultdict(list)
    for r in P.page_breaks(df, wanted, boxes).collect():
        got[r.book_id, r.layout_id].append((r.page, r.section_idx, r.first_paragraph, r.first_line))
    assert {k for _, k in got} == {1, 2, 3, 4, 5}
    for (name, layout), found in got.items():
        want, page = [], 2
        for b, s, heading, items in sorted(rows, key=lambda r: r[1]):
            if b == name and items:
                for i, line in pages_of(items, heading, box[layout]):
                    page += 1
                    want.append((page, s, i, line))
        assert sorted(found) == want, (name, layout)
    assert got["b0", 2] == got["b0", 5] or sorted(got["b0", 2]) == sorted(got["b0", 5])
    ranges = P.section_pages(df, wanted, boxes).collect()
    for r in ranges:
        mine = [p for p, s, _, _ in got[r.book_id, r.layout_id] if s == r.section_idx]
        assert (min(mine), max(mine), len(mine)) == (r.first_page, r.last_page, r.last_page - r.first_page + 1)


def test_orphans_and_widows(book):
    rows, df, wanted, boxes = book
    lines = {r.layout_id: r.lines_per_page for r in boxes.filter("status = 'ok'").collect()}
    for r in P.page_breaks(df, wanted, boxes).filter("first_line > 0").collect():
        assert r.first_line >= 2 or lines[r.layout_id] <= 2


def test_line_count(spark):
    cases = [("", 1000, 0), ("a", 1000, 0), ("a a a", 1170, 0), ("a a a", 1169, 0), ("a a a", 1170, 400), ("W" * 9, 100, 0), ("x " * 5000, 3000, 90)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, m bigint, d bigint")
    got = df.select("i", Y.line_count(Y.word_widths(F.col("t")), F.col("m"), F.col("d")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [lines_of(*c) for c in cases]


def test_sheets_of_sections(spark):
    ranges = spark.createDataFrame([("b", 1, 1, 3, 3), ("b", 1, 2, 4, 9), ("b", 1, 3, 10, 40), ("c", 1, 1, 3, 1000)],
                                   "book_id string, layout_id int, section_idx int, first_page long, last_page long")
    specs = I.signature_spec(spark.createDataFrame(
        [("b", None, 8, None, "rtl"), ("c", None, 16, None, None)],
        "book_id string, sheets int, pages int, max_end_padding int, direction string"))
    jobs = I.signature_padding(P.imposition_jobs(P.book_pages(ranges), specs))
    plan = I.imposition_plan(jobs, ["book_id", "layout_id"])
    got = {tuple(r) for r in P.section_sheets(ranges, plan, width=5).collect()}
    slots = [tuple(r) for r in plan.select("book_id", "signature_no", "sheet_no", "side", "page_no").collect()]
    want = {(b, 1, r.section_idx, g, s, side) for b, g, s, side, page in slots for r in ranges.collect()
            if r.book_id == b and r.first_page <= page <= r.last_page}
    assert got == want and ("b", 1, 1, 1, 2, "front") in got


def test_sections_meet_sheets_by_bins_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("section_sheets", "page_breaks", "unique_slugs"):
            plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan, name
            assert plan.count("SortMergeJoin") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_running_totals(spark, bits):
    rng = random.Random(bits)
    rows = [("hot" if i % 3 else f"k{i % 50}", i * 7 % 1000, rng.randint(0, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i int, v long")
    got = {(r.k, r.i): r.t for r in running_totals(df, ["k"], "i", F.col("v"), "t", bits).collect()}
    assert got == {(k, i): sum(v2 for k2, i2, v2 in rows if k2 == k and i2 < i) for k, i, _ in rows}


def test_lines_are_filled_once(spark):
    df = registry.queries()["page_breaks"](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert "ReusedExchange" in final


def test_ranks_of_a_hot_key_meet_in_no_group(spark):
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    ranked = spark_rows = spread_ranks(df, ["k"], ["id"], "rank")
    hot = [r.rank for r in spark_rows.filter("k = 'hot'").collect()]
    assert sorted(hot) == list(range(1, n // 3 + 1))
    # a window of the key alone holds one row for each range of digests, whatever the size of the key
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2
    groups = df.filter("k = 'hot'").groupBy(F.substring(F.md5(F.col("id").cast("string")), 1, 3)).count()
    assert groups.agg(F.max("count")).first()[0] < 40


def test_unique_slugs(spark):
    rows = [(i, "same" if i % 3 == 0 else f"book-{i // 2}") for i in range(900)] + [(1000, "same-2"), (1001, "same__2")]
    df = spark.createDataFrame(rows, "book_id int, slug string")
    first = {r.book_id: r.unique_slug for r in B.unique_slugs(df, ["book_id"]).collect()}
    assert len(set(first.values())) == len(rows)
    slug_of = dict(rows)
    assert all(u == slug_of[i] or u.startswith(slug_of[i] + "~") for i, u in first.items())
    assert Counter(u.split("~")[0] for u in first.values()) == Counter(slug_of.values())
    # books with other slugs and another number of partitions change nothing
    more = df.unionByName(df.select((F.col("book_id") + 5000).alias("book_id"), F.concat("slug", F.lit("x")).alias("slug"))).repartition(7)
    again = {r.book_id: r.unique_slug for r in B.unique_slugs(more, ["book_id"]).filter("book_id < 5000").collect()}
    assert again == first


def test_registered_face_is_that_of_the_sql():
    from quirework.plans.queries_pages import FACE

    assert [(w, set(c.replace("''", "'"))) for w, c in FACE] == [(w, set(c)) for w, c in Y.WIDTHS]
    letters = "".join(c for _, c in Y.WIDTHS)
    assert len(set(letters)) == len(letters) and S.HEADING_SCALE == 1.45


def test_lines_of_sections_are_those_of_the_folds(spark):
    rng = random.Random(5)
    words = ["a", "Mmm", "x" * 90, "—", "\u00a0", "\ue000\ue003", "😀é", "it's", "\u2028", "W"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\f"]) for _ in range(rng.randrange(60)))
    rows = [(k, [None if rng.random() < 0.2 else text() for _ in range(rng.randrange(6))], text(), rng.choice([1, 700, 20_000]), rng.choice([0, 1200]))
            for k in range(60)]
    df = spark.createDataFrame(rows, "k int, texts array<string>, heading string, m bigint, d bigint")
    box = F.array(F.struct(F.col("m").alias("measure"), (F.col("m") * 2).alias("heading_measure"), F.col("d").alias("indent")))
    flags = F.transform("texts", lambda t, i: i % 2 == 1)
    got = df.select("k", F.inline(Y.section_lines()("texts", flags, "heading", box))).select("k", "counts", "heading").collect()
    one = lambda t, m, d: Y.line_count(Y.word_widths(t), m, d)
    model = df.select(
        "k", F.transform("texts", lambda t, i: F.when(t.isNull(), -1).otherwise(
            one(t, F.col("m"), F.when(i % 2 == 1, F.col("d")).otherwise(F.lit(0))))).alias("counts"),
        one(F.col("heading"), F.col("m") * 2, F.lit(0).cast("bigint")).alias("heading")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, model))
