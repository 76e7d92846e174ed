"""Dimension tables: cleanup variants, page sizes, margins, spacing modes, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- fixed values -----------------------------------------------------------------
# profile, name, soft wraps, dialogue lines, merge, aggressive, collapse, preserve
VARIANTS = (
    ("script", "standard", True, True, False, False, True, True),
    ("script", "edit-friendly", False, False, False, False, True, True),
    ("script", "aggressive-cleanup", True, True, True, False, True, True),
    ("script", "no-dialogue-join", True, False, False, False, True, True),
    ("script", "paragraph-dialogue-merge", False, False, True, False, True, True),
    ("app", "standard", True, True, False, False, True, True),
    ("app", "aggressive-cleanup", True, True, False, False, True, True),
    ("app", "paragraph-dialogue-merge", True, True, True, False, True, True),
    ("extra", "aggressive-merge", True, True, True, True, True, True),
    ("extra", "no-scene-breaks", True, True, True, False, True, False),
)
VARIANT_COLUMNS = (
    "profile", "variant", "join_soft_wrapped_lines", "join_dialogue_continuations",
    "merge_dialogue_paragraphs", "aggressive_mode", "collapse_extra_blank_lines",
    "preserve_scene_breaks",
)
VARIANT_LABELS = (
    ("standard", "Standard Cleanup"),
    ("paragraph-dialogue-merge", "Dialogue Merge"),
    ("aggressive-cleanup", "Aggressive Cleanup"),
)
BASELINE_VARIANT = "standard"

# key, label, width and height in cm
PAGE_SIZES = (
    ("default-trade", "Default trade (6 x 9 in)", 15.24, 22.86),
    ("a4", "A4", 21.0, 29.7),
    ("a5", "A5", 14.8, 21.0),
    ("a6", "A6", 10.5, 14.8),
    ("letter", "US Letter", 21.59, 27.94),
    ("half-letter", "Half Letter", 13.97, 21.59),
    ("trade-5x8", "Trade 5 x 8 in", 12.70, 20.32),
    ("trade-6x9", "Trade 6 x 9 in", 15.24, 22.86),
)
DEFAULT_PAGE_SIZE = "default-trade"

# key, label, top, bottom, inside, outside in cm
MARGINS = (
    ("standard", "Standard", 1.5, 1.5, 1.8, 1.0),
    ("compact", "Compact", 1.2, 1.2, 1.5, 0.8),
    ("wide", "Wide", 1.8, 1.8, 2.1, 1.2),
    ("large-print", "Large print friendly", 2.0, 2.0, 2.3, 1.5),
)
DEFAULT_MARGINS = "standard"
CUSTOM_MARGINS_LABEL = "Custom margins"
CUSTOM_SIZE_LABEL = "Custom size"

# key, label, space after (lines of the font size), indent (ditto)
SPACING_MODES = (
    ("traditional", "Traditional (paragraph spacing + indents)", 0.65, 1.2),
    ("no-indents", "No indents (keep paragraph spacing)", 0.65, 0.0),
    ("indented-compact", "Indented compact (minimal paragraph gap + indents)", 0.0, 1.2),
    ("uniform", "Uniform (no paragraph gap, no indents)", 0.0, 0.0),
)
DEFAULT_SPACING = "traditional"

FONT_SIZE_PT = 11.5
LINE_HEIGHT = 1.35
FONT_STACK = '"Garamond", "EB Garamond", "Cormorant Garamond", serif'
# scale of title, author and heading, space after a heading, space around a scene break
TITLE_SCALE, AUTHOR_SCALE, HEADING_SCALE = 2.0, 1.15, 1.45
HEADING_SPACE, SCENE_SPACE = 1.8, 1.2
POINTS_PER_CM = 28.3465

DEFAULT_SHEETS = 4
PREVIEW_SECTIONS, PREVIEW_CHARS = 3, 1400

IMPOSITION_LABELS = (("none", "Do not create imposed PDF"), ("also", "Also create imposed PDF"))
DIRECTION_LABELS = (("ltr", "Left-to-right"), ("rtl", "Right-to-left"))
# --- end of fixed values ----------------------------------------------------------


def variants(spark: SparkSession, profile: str | None = None) -> DataFrame:
    """The cleanup variants, of one profile or of all (ten rows)."""
    rows = [v for v in VARIANTS if profile in (None, v[0])]
    schema = "profile string, variant string, " + ", ".join(
        f"{c} boolean" for c in VARIANT_COLUMNS[2:]
    )
    return spark.createDataFrame(rows, schema)


def variant_groups(spark: SparkSession, profile: str | None = None, rows=VARIANTS) -> DataFrame:
    """One row per distinct group of switches, with the variants that share it.

    Several variants clean in the same way; each way needs to run only once."""
    groups: dict[tuple, list[tuple]] = {}
    for row in rows:
        if profile in (None, row[0]):
            groups.setdefault(row[2:], []).append(row[:2])
    flags = ", ".join(f"{c} boolean" for c in VARIANT_COLUMNS[2:])
    return spark.createDataFrame(
        [(names, *switches) for switches, names in groups.items()],
        f"names array<struct<profile:string,variant:string>>, {flags}",
    )


def page_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(PAGE_SIZES), "key string, label string, width_cm double, height_cm double"
    )


def margins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(MARGINS),
        "key string, label string, top double, bottom double, inside double, outside double",
    )


def spacing_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(SPACING_MODES), "key string, label string, gap double, indent double"
    )


def lookup(column, pairs, otherwise=None):
    """CASE over a small fixed table of ``(key, value)``."""
    expr = None
    for key, value in pairs:
        expr = F.when(column == key, value) if expr is None else expr.when(column == key, value)
    return expr.otherwise(column if otherwise is None else otherwise)
