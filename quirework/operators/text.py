"""Text operators on ``(key..., text)`` frames. All are map-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import merge as M
from ..functions import text as T
from ..functions.expr import explode_rows, let


def text_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return explode_rows(df, keys, T.text_lines(F.col(text)), "line_idx", {"line": lambda x: x})


def scene_break_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return text_lines(df, keys, text).withColumn("is_scene", T.is_scene_break(F.col("line")))


def text_blocks(df: DataFrame, keys: list[str], text: str = "text", preserve=True) -> DataFrame:
    blocks = T.line_blocks(T.text_lines(_normalized(text)), preserve)
    return explode_rows(
        df, keys, blocks, "block_idx",
        {
            "kind": lambda b: b["kind"],
            "first_line": lambda b: b["first_line"],
            "n_lines": lambda b: F.size(b["lines"]),
            "text": lambda b: F.array_join(b["lines"], "\n"),
        },
    )


def _normalized(text: str) -> Column:
    return T.normalize_spaces(T.normalize_line_endings(F.col(text)))


def dialogue_lines(df: DataFrame, keys, text: str = "text", strict: bool = False) -> DataFrame:
    """Every text block's lines after the pairwise join; blanks and scenes dropped."""
    joined = F.flatten(
        F.transform(
            F.filter(T.line_blocks(T.text_lines(_normalized(text))), lambda b: b["kind"] == "text"),
            lambda b: T.join_dialogue_lines(b["lines"], strict),
        )
    )
    return explode_rows(df, keys, joined, "out_idx", {"line": lambda x: x})


def soft_wrapped_blocks(df: DataFrame, keys, text: str = "text") -> DataFrame:
    """One line per text block."""
    wrapped = F.transform(
        F.filter(T.line_blocks(T.text_lines(_normalized(text))), lambda b: b["kind"] == "text"),
        lambda b: T.soft_wrap(b["lines"]),
    )
    return explode_rows(df, keys, wrapped, "block_no", {"text": lambda x: x})


_ITEM = {"kind": lambda x: x["kind"], "text": lambda x: x["text"]}


def explode_items(df: DataFrame, keys, items: str = "items") -> DataFrame:
    return explode_rows(df, keys, F.col(items), "item_idx", _ITEM)


def with_items(df: DataFrame, text: str = "text", dedupe: bool = False) -> DataFrame:
    items = M.paragraph_items(F.col(text))
    return df.withColumn("items", M.dedupe_scene_breaks(items) if dedupe else items)


def line_items(df: DataFrame, text: str = "text") -> DataFrame:
    """Each non-empty line is an item."""
    lines = F.filter(T.text_lines(F.col(text)), lambda x: x != "")
    items = F.transform(
        lines,
        lambda x: F.when(T.is_scene_break(x), M.scene_item()).otherwise(M.item(F.lit("p"), x)),
    )
    return df.withColumn("items", items)


def merged(df: DataFrame, aggressive: bool = False) -> DataFrame:
    return df.withColumn("items", M.merge_items(F.col("items"), True, aggressive))


def merge_report(df: DataFrame, group: str) -> DataFrame:
    """Paragraphs before and after merging per group. Only counts are shuffled."""
    counts = let(
        F.col("items"),
        lambda a: F.struct(F.size(a).alias("before"), F.size(M.merge_starts(a)).alias("after")),
    )
    counted = df.select(group, counts.alias("n"))
    return counted.groupBy(group).agg(
        F.sum("n.before").alias("paragraphs_before"),
        F.sum("n.after").alias("paragraphs_after"),
        F.sum(F.col("n.before") - F.col("n.after")).alias("paragraphs_merged"),
    )
