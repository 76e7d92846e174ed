from __future__ import annotations

import random
import time
from functools import lru_cache

from hypothesis import given, settings, strategies as st
from paths import SMALL
from pyspark.sql import functions as F

from quirework import settings as S
from quirework.functions import edits
from quirework.operators import books as B
from quirework.operators import variants as V
from quirework.plans import fixtures as X

SHORT = st.lists(st.sampled_from("abcd"), max_size=12)


def length(a, b):
    @lru_cache(None)
    def of(i, j):
        if i == len(a) or j == len(b):
            return 0
        if a[i] == b[j]:
            return 1 + of(i + 1, j + 1)
        return max(of(i + 1, j), of(i, j + 1))

    return of(0, 0)


def first_by_rule(a, b):
    """The canonical common subsequence, by its definition."""
    rows = [i for i, x in enumerate(a) if x in b]
    columns = [j for j, x in enumerate(b) if x in a]
    out = []
    while rows and columns:
        x, y = [a[i] for i in rows], [b[j] for j in columns]
        if x[0] == y[0]:
            out.append((rows.pop(0), columns.pop(0)))
        elif length(tuple(x[1:]), tuple(y)) >= length(tuple(x), tuple(y[1:])):
            rows.pop(0)
        else:
            columns.pop(0)
    return out


@settings(max_examples=300, deadline=None)
@given(SHORT, SHORT, st.integers(1, 5))
def test_common(a, b, block):
    old, edits.ROWS = edits.ROWS, block
    try:
        found = edits.common(a, b)
    finally:
        edits.ROWS = old
    assert found == first_by_rule(a, b)
    assert len(found) == length(tuple(a), tuple(b))


def check(a, b, rows):
    """Every paragraph of both sides is in one row, and each row is right."""
    assert sorted(j for *_, j in rows if j is not None) == list(range(len(b)))
    used = [i for _, x, y, _ in rows if x is not None for i in range(x, y + 1)]
    assert sorted(used) == list(range(len(a)))
    for change, x, y, j in rows:
        if change == "kept":
            assert x == y and a[x] == b[j]
        elif change == "joined":
            assert y > x and " ".join(a[x: y + 1]) == b[j]
        elif change == "removed":
            assert x == y and j is None
        else:
            assert change == "inserted" and x is None and y is None
    pairs = [(x, j) for c, x, _, j in rows if c in ("kept", "joined")]
    assert pairs == sorted(pairs) and [j for _, j in pairs] == sorted(j for _, j in pairs)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "a b", "c", "b c"]), max_size=10), st.lists(st.sampled_from(["a", "b", "a b", "c", "b c", "a b c", "a a"]), max_size=8))
def test_script(a, b):
    check(a, b, edits.script(a, b))


def test_joined_paragraphs():
    a = ["one", "***", '"Wait," ', "he said", "and went.", "two", "x", "x", "y"]
    a = [p.strip() for p in a]
    b = ["one", '"Wait," he said and went.', "two", "new", "x y"]
    assert edits.script(a, b) == [
        ("kept", 0, 0, 0), ("removed", 1, 1, None), ("joined", 2, 4, 1), ("kept", 5, 5, 2), ("inserted", None, None, 3),
        ("removed", 6, 6, None), ("joined", 7, 8, 4)]
    assert edits.script([], []) == [] and edits.script([], ["a"]) == [("inserted", None, None, 0)]


def test_long_sections():
    rng = random.Random(1)
    a = [f"p{i}" if i % 3 else "***" for i in range(6000)]
    b = [x for x in a if rng.random() < 0.9]
    rows = edits.script(a, b)
    check(a, b, rows)
    assert sum(r[0] == "kept" for r in rows) == len(b)
    halves = [" ".join(p) for p in zip(a[::2], a[1::2], strict=True)]
    check(a, halves, edits.script(a, halves))
    assert sum(r[0] == "joined" for r in edits.script(a, halves)) == 3000


def test_changes_of_tables(spark):
    sections = X.book_sections(spark, SMALL)
    rows = V.paragraph_changes(sections, S.variant_groups(spark))
    totals = {tuple(r)[:1] + (r.change,): r.n for r in rows.groupBy("variant", "change").agg(F.count("*").alias("n")).collect()}
    assert totals["paragraph-dialogue-merge", "joined"] > 0 and ("edit-friendly", "joined") not in totals
    empty = sections.limit(0)
    assert V.paragraph_changes(empty, S.variant_groups(spark)).count() == 0
    odd = spark.createDataFrame([("b", 1, "", "<p>a</p><hr/>"), ("b", 2, "", ""), ("c", 1, "", "<p>  </p><p>\n x  y </p>")],
                                "book_id string, section_idx int, heading string, html string")
    got = V.paragraph_changes(odd, S.variant_groups(spark, "script")).filter("variant = 'standard'")
    assert sorted((r.book_id, r.section_idx, r.change, r.before_first, r.after_idx) for r in got.collect()) == [
        ("b", 1, "kept", 0, 0), ("b", 1, "kept", 1, 1), ("c", 1, "kept", 0, 0)]
    counts = V.change_counts(got).collect()
    assert {(r.book_id, r.section_idx): (r.kept, r.joined, r.removed, r.inserted) for r in counts} == {("b", 1): (2, 0, 0, 0), ("c", 1): (1, 0, 0, 0)}


def test_variants_that_differ_in_line_switches_share_a_section(spark):
    sections = spark.createDataFrame(
        [("b", 1, "", "<p>a,</p><p>b</p>"), ("b", 2, "", "<p>a\n***\nb</p>")], "book_id string, section_idx int, heading string, html string")
    groups = S.variant_groups(spark)
    ways = B.fan_out(B.section_items(sections), groups, lambda df: df.withColumn("way", F.monotonically_increasing_id()))
    counts = {r.section_idx: r.n for r in ways.groupBy("section_idx").agg(F.count_distinct("way").alias("n")).collect()}
    assert counts == {1: len({v[4:6] + v[7:] for v in S.VARIANTS}), 2: groups.count()}
    assert ways.filter("section_idx = 1").count() == len(S.VARIANTS)


def test_long_tables_are_rows_of_bits():
    rng = random.Random(2)
    a, b = ([rng.choice("abcdef") for _ in range(4000)] for _ in range(2))
    start = time.process_time()
    pairs = edits.common(a, b)
    seconds = time.process_time() - start
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) > 2000 and seconds < 0.5
