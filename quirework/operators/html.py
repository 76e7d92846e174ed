"""HTML operators on ``(key..., html)`` frames. All are map-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H
from ..functions.expr import compute, explode_rows, reuse


def page_bodies(df: DataFrame, keys, html: str = "html") -> DataFrame:
    """Body content without scripts and styles; pages without content are dropped."""
    bodies = compute(df.select(*keys, html), "body", H.body_content(F.col(html)))
    return bodies.select(*keys, "body").filter(F.col("body") != "")


def heading_of(html: str) -> Column:
    return reuse(("first_heading", html), lambda: H.first_heading(F.col(html)))


def sections_from_html(df: DataFrame, keys, html: str = "html") -> DataFrame:
    """``(keys, heading, html)``: the heading is looked up before anything is dropped."""
    bodies = page_bodies(df, keys, html)
    return bodies.select(*keys, heading_of("body").alias("heading"), F.col("body").alias("html"))


def with_tokens(df: DataFrame, html: str = "html", drop_notes: bool = False) -> DataFrame:
    """Tokens of what is left after dropping boilerplate."""
    return compute(df, "tokens", kept_tokens(html, drop_notes))


def kept_tokens(html: str, drop_notes: bool) -> Column:
    return reuse(
        ("kept_tokens", html, drop_notes),
        lambda: H.drop_boilerplate(H.tokens(F.col(html)), drop_notes),
    )


def items_of_tokens() -> Column:
    return reuse(("raw_items",), lambda: H.raw_items(F.col("tokens")))


def kept_html(df: DataFrame, keys, html: str = "html") -> DataFrame:
    return df.select(
        *keys,
        F.array_join(kept_tokens(html, False), "").alias("kept"),
        F.array_join(kept_tokens(html, True), "").alias("kept_without_notes"),
    )


def leaf_blocks(df: DataFrame, keys) -> DataFrame:
    """Leaves of ``with_tokens`` output with their raw text."""
    leaves = F.transform(
        H.leaf_blocks(F.col("tokens")),
        lambda b: F.struct(
            b["pos"].alias("pos"),
            b["tag"].alias("tag"),
            H.block_text(F.col("tokens"), b).alias("text"),
        ),
    )
    fields = {n: (lambda b, n=n: b[n]) for n in ("pos", "tag", "text")}
    return explode_rows(df, keys, leaves, "leaf_idx", fields)


def block_and_rule_rows(df: DataFrame, keys) -> DataFrame:
    """Leaves and ``hr`` tags in document order."""
    ts = F.col("tokens")
    rows = F.array_sort(
        F.concat(
            F.transform(H.leaf_blocks(ts), lambda b: F.struct(b["pos"].alias("pos"), F.lit("block").alias("kind"))),
            F.transform(H.rule_positions(ts), lambda i: F.struct(i.alias("pos"), F.lit("scene").alias("kind"))),
        )
    )
    return explode_rows(df, keys, rows, "row_idx", {"kind": lambda r: r["kind"]})


def legacy_paragraphs(df: DataFrame, keys) -> DataFrame:
    paragraphs = H.legacy_paragraphs(F.col("tokens"))
    return explode_rows(df, keys, paragraphs, "para_idx", {"text": lambda p: p})
