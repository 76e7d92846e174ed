"""Positions of regular expression matches with built-in functions only.

``split`` gives the text between the matches and ``regexp_extract_all`` the matches, both
leftmost and non-overlapping, so running sums of their lengths are the positions in code
points. The sums are built block by block and stay close to linear in the matches of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quirework.functions.expr import let, let_all

SHIFT = 8
BLOCK = 1 << SHIFT
#: Characters before a match that are kept with it.
CONTEXT = 48

MATCH = "array<struct<start:int,end:int,hit:string,left:string>>"


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Array of (start, end, hit, left) of all matches; end is exclusive, ``left`` is what
    stands just before the match, after the match before it. ``guard`` is a cheap test that
    every text with a match passes; ``text`` must not be null."""
    def length(z: Column) -> Column:
        return z["gap"] + z["size"]

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, z: a + length(z))

    def placed(v: dict[str, Column]) -> Column:
        pieces = F.zip_with(
            F.slice(v["gaps"], 1, F.size(v["hits"])), v["hits"],
            lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"),
                                  h.alias("hit"), F.right(g, F.lit(CONTEXT)).alias("left")))
        return let(pieces, positions)

    def positions(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(z) - 1, F.lit(BLOCK)),
                             lambda first: total(F.slice(z, first + 1, BLOCK)))
        def ends(b: Column) -> Column:
            return F.transform(b, lambda _, i: F.aggregate(F.slice(b, 1, i), F.lit(0), lambda a, x: a + x))

        def one(sums: Column) -> Column:
            def at(p: Column, i: Column) -> Column:
                block = F.shiftright(i, SHIFT)
                rest = F.slice(z, block * BLOCK + 1, i.bitwiseAND(F.lit(BLOCK - 1)))
                start = F.get(sums, block) + total(rest) + p["gap"]
                return let(start, lambda s: F.struct(s.alias("start"), (s + p["size"]).alias("end"),
                                                     p["hit"].alias("hit"), p["left"].alias("left")))
            return F.transform(z, at)

        return let(blocks, lambda b: let(ends(b), one))

    none = F.array().cast(MATCH)
    cut = {"gaps": F.split(text, pattern, -1), "hits": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))}
    found = let_all(cut, lambda v: F.when(F.size(v["hits"]) > 0, placed(v)).otherwise(none))
    return F.when(guard, found).otherwise(none)


def named(found: Column, kind: int, value: Callable[[Column], Column], accept: Callable[[Column], Column]) -> Column:
    """Accepted matches as (start, end, kind, value, left)."""
    good = F.filter(found, accept)
    return F.transform(good, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"),
        value(m).alias("value"), m["left"].alias("left")))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_row_ids(df: DataFrame) -> DataFrame:
    """Rows may repeat an id; this tells them apart. Stage the result before using it twice."""
    return df.withColumn("rid", F.monotonically_increasing_id())
