"""Paragraph items: building, de-duplicating, filtering and merging them.

An item is ``struct(kind, text)``; kind is ``p`` or ``scene``. The items of one section
are an array in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P
from .expr import fold_flags, indices, let, split_at
from .text import (
    clean_text,
    first_is,
    is_scene_break,
    last_is,
    py_strip,
    starts_lower,
    starts_with_tag,
)

ITEMS_TYPE = "array<struct<kind:string,text:string>>"


def item(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"))


def scene_item() -> Column:
    return item(F.lit("scene"), F.lit(P.SCENE_MARK))


def chunk_items(cleaned: Column) -> Column:
    """Cleaned text -> items: split at blank lines; a chunk may be a scene break."""
    def items(text: Column) -> Column:
        # most cleaned texts are one chunk
        cut = F.when(F.contains(text, F.lit("\n\n")), F.split(text, "\n\n")).otherwise(F.array(text))
        return F.transform(
            F.filter(F.transform(cut, py_strip), lambda x: x != ""),
            lambda x: F.when(is_scene_break(x), scene_item()).otherwise(item(F.lit("p"), x)),
        )

    return let(cleaned, items)


def paragraph_items(text: Column) -> Column:
    return chunk_items(clean_text(text))


def dedupe_scene_breaks(items: Column) -> Column:
    """Keep one of several scene breaks in a row; repeated paragraphs stay."""
    return let(
        items,
        lambda a: F.filter(
            a,
            lambda x, i: ~(
                (x["kind"] == "scene")
                & F.coalesce(F.get(a, i - 1)["kind"] == "scene", F.lit(False))
            ),
        ),
    )


def filter_scene_breaks(items: Column, preserve) -> Column:
    keep = preserve if isinstance(preserve, Column) else F.lit(bool(preserve))
    return F.filter(items, lambda x: keep | (x["kind"] != "scene"))


def has_lines(x: Column) -> Column:
    """The item is a paragraph of several lines."""
    return (x["kind"] == "p") & F.contains(x["text"], F.lit("\n"))


def reclean_items(items: Column, soft, dialogue, collapse, preserve) -> Column:
    """Second cleaning with the chosen settings.

    A one-line paragraph that was cleaned before stays as it is under every setting, so
    only paragraphs that still hold a line break (around a scene line) are cleaned again.
    """
    return F.filter(
        F.transform(
            items,
            lambda x: F.when(
                has_lines(x),
                item(F.lit("p"), clean_text(x["text"], soft, dialogue, collapse, preserve)),
            ).otherwise(x),
        ),
        lambda x: x["text"] != "",
    )


# --- merging ----------------------------------------------------------------------


def ends_open(c: Column) -> Column:
    """The paragraph ends in a way that lets a continuation follow."""
    return last_is(c, P.OPEN_PARAGRAPH_MARKS + P.CLOSING_QUOTES)


def ends_terminal(c: Column) -> Column:
    return F.substring(c, -2, 2).rlike(rf"[.!?][{P.CLOSING_QUOTES}]?\z")


def starts_with_quote(c: Column) -> Column:
    return first_is(c, P.OPENING_QUOTES)


def _few_dashes(c: Column) -> Column:
    """At most three dashes and nothing else: may be, or merge into, a scene break."""
    return first_is(c, r"\-") & c.rlike(rf"^-[{P.SPACE}]*(?:-[{P.SPACE}]*){{0,2}}\z")


def should_merge(prev: Column, nxt: Column, words=P.DIALOGUE_TAG_WORDS) -> Column:
    """Does ``nxt`` continue ``prev``? Both stripped. (The plain, pairwise rule.)"""
    return (
        (prev != "")
        & (nxt != "")
        & ends_open(prev)
        & (starts_lower(nxt) | starts_with_tag(nxt, words))
        & ~is_scene_break(prev)
        & ~is_scene_break(nxt)
    )


def _features(x: Column, aggressive: Column, words) -> Column:
    t = x["text"]
    return F.struct(
        (x["kind"] == "p").alias("para"),
        ends_open(t).alias("open"),
        ends_terminal(t).alias("final"),
        (starts_lower(t) | starts_with_tag(t, words)).alias("cont"),
        is_scene_break(t).alias("scene"),
        starts_with_quote(t).alias("quoted"),
        F.length(t).alias("len"),
        F.when(_few_dashes(t), t).alias("dashes"),
    )


def merge_starts_pairwise(items: Column, words=P.DIALOGUE_TAG_WORDS) -> Column:
    """Indices at which a new paragraph begins, judged by neighbours only."""
    return F.filter(
        indices(items),
        lambda i: (i == 0)
        | (F.get(items, i)["kind"] != "p")
        | (F.get(items, i - 1)["kind"] != "p")
        | ~should_merge(F.get(items, i - 1)["text"], F.get(items, i)["text"], words),
    )


def merge_starts_folded(items: Column, aggressive: Column, words=P.DIALOGUE_TAG_WORDS) -> Column:
    """The same, where the decision depends on the paragraph merged so far.

    The state is small: its length, whether it opens with a quote, and its text while it
    is only dashes (three of them would be a scene break).
    """

    def run(fs: Column) -> Column:
        def step(acc: Column, i: Column):
            f, p = F.get(fs, i), F.get(fs, i - 1)
            acc_scene = F.when(acc["dashes"].isNotNull(), is_scene_break(acc["dashes"])).otherwise(
                p["scene"] & (acc["len"] == p["len"])
            )
            plain = p["open"] & f["cont"]
            bold = (
                aggressive
                & ~p["final"]
                & (
                    (f["cont"] & ((acc["len"] <= P.SHORT_PREVIOUS) | (f["len"] <= P.SHORT_NEXT)))
                    | (acc["quoted"] & (acc["len"] <= P.SHORT_QUOTED_PREVIOUS))
                )
            )
            merge = F.coalesce(
                (i > 0) & f["para"] & p["para"] & ~acc_scene & ~f["scene"] & (plain | bold),
                F.lit(False),
            )
            dashes = let(
                F.concat(acc["dashes"], F.lit(" "), f["dashes"]),
                lambda d: F.when(_few_dashes(d), d),
            )
            state = {
                "len": F.when(merge, acc["len"] + 1 + f["len"]).otherwise(f["len"]),
                "quoted": F.when(merge, acc["quoted"]).otherwise(f["quoted"]),
                "dashes": F.when(merge, dashes).otherwise(f["dashes"]),
            }
            return state, F.when(merge, "m").otherwise("s")

        zero = {
            "len": F.lit(0),
            "quoted": F.lit(False),
            "dashes": F.lit(None).cast("string"),
        }
        return let(
            fold_flags(F.size(fs), zero, step),
            lambda flags: F.filter(indices(fs), lambda i: F.get(flags, i) == "s"),
        )

    return let(F.transform(items, lambda x: _features(x, aggressive, words)), run)


def merge_starts(items: Column, aggressive=False, words=P.DIALOGUE_TAG_WORDS) -> Column:
    """Indices at which the merged paragraphs (and scene breaks) begin. ``items`` must be
    cheap to evaluate repeatedly."""
    bold = aggressive if isinstance(aggressive, Column) else F.lit(bool(aggressive))
    # neighbours decide alone unless lengths count or a dash run may turn into a scene
    fold_needed = bold | F.exists(
        items, lambda x: (x["kind"] == "p") & _few_dashes(x["text"])
    )
    return F.when(fold_needed, merge_starts_folded(items, bold, words)).otherwise(
        merge_starts_pairwise(items, words)
    )


def merge_items(items: Column, merge, aggressive=False, words=P.DIALOGUE_TAG_WORDS) -> Column:
    """Merge continuation paragraphs into the one before. Switches may be columns."""
    if merge is False:
        return items
    on = merge if isinstance(merge, Column) else F.lit(True)

    def glue(a: Column, starts: Column) -> Column:
        return F.transform(
            split_at(a, starts),
            lambda g: item(
                F.get(g, F.lit(0))["kind"],
                F.array_join(F.transform(g, lambda x: x["text"]), " "),
            ),
        )

    def body(a: Column) -> Column:
        merged = let(merge_starts(a, aggressive, words), lambda s: glue(a, s))
        return F.when(on, merged).otherwise(a)

    return let(items, body)


# --- rendering --------------------------------------------------------------------


def items_text(items: Column) -> Column:
    """Paragraphs separated by a blank line."""
    return py_strip(F.array_join(F.transform(items, lambda x: x["text"]), "\n\n"))
