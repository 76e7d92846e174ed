"""Fixed values of the oracle SQL.

The SQL has values of its own, so that a wrong pattern, word or measure in the library shows as
a difference. Nothing here is imported from the library.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------
SPACE = r" \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}\n"
WORD = r"\p{L}\p{N}_"
SCENE = (
    r"\*[ \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}\n]*\*[ \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}\n]*\*[ \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}\n*]*"
    r"|#{3,}"
    r"|-[ \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}\n]*-[ \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}\n]*-"
    r"|~[ \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}\n]*~[ \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}\n]*~"
)
DIALOGUE_TAG_WORDS = (
    "he|she|they|i|we|it|you|his|her|their|the|"
    "said|asked|whispered|murmured|replied|answered|shouted|yelled|"
    "cried|called|snapped|hissed|muttered|breathed|added|continued|"
    "harry|ron|hermione|draco|ginny|luna|neville|snape|remus|sirius|"
    "malfoy|potter|granger|he'd|she'd|they'd|he'll|she'll|they'll"
)
PRONOUN_TAG_WORDS = "he|she|they|i|we|it|you|his|her|their|the"
CLOSING_QUOTES = "\"”’"
OPENING_QUOTES = "\"“‘"
LOWER_START, LOWER_START_STRICT = "a-z(\\[—\\-'", "a-z("
OPEN_LINE_MARKS, OPEN_PARAGRAPH_MARKS = ",—\\-", ",;:—\\-"
SHORT_PREVIOUS, SHORT_QUOTED_PREVIOUS, SHORT_NEXT = 110, 90, 120
BLOCK_TAGS = "p|blockquote|div|li"
VOID_TAGS = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr'"
DROP_CLASSES, NOTE_CLASSES, NOTE_IDS = "landmark|actions|download", "preface|notes|endnotes", "notes|work_endnotes"

VARIANT_COLUMNS = (
    "profile, variant, join_soft_wrapped_lines, join_dialogue_continuations, merge_dialogue_paragraphs, "
    "aggressive_mode, collapse_extra_blank_lines, preserve_scene_breaks"
)
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
VARIANT_LABELS = (
    ("standard", "Standard Cleanup"),
    ("paragraph-dialogue-merge", "Dialogue Merge"),
    ("aggressive-cleanup", "Aggressive Cleanup"),
)
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
# key, label, top, bottom, inside, outside in cm
MARGINS = (
    ("standard", "Standard", 1.5, 1.5, 1.8, 1.0),
    ("compact", "Compact", 1.2, 1.2, 1.5, 0.8),
    ("wide", "Wide", 1.8, 1.8, 2.1, 1.2),
    ("large-print", "Large print friendly", 2.0, 2.0, 2.3, 1.5),
)
# key, label, space after, indent
SPACING_MODES = (
    ("traditional", "Traditional (paragraph spacing + indents)", 0.65, 1.2),
    ("no-indents", "No indents (keep paragraph spacing)", 0.65, 0.0),
    ("indented-compact", "Indented compact (minimal paragraph gap + indents)", 0.0, 1.2),
    ("uniform", "Uniform (no paragraph gap, no indents)", 0.0, 0.0),
)
FONT_SIZE_PT, LINE_HEIGHT, POINTS_PER_CM = 11.5, 1.35, 28.3465
# --- end of fixed values ----------------------------------------------------------
