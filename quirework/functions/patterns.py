"""Patterns, word lists and names that decide results."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------
# White space as Unicode text processing sees it, as the inside of a regex class.
SPACE_IN_LINE = r" \t\x0b\f\r\x1c-\x1f\x{85}\p{Z}"
SPACE = SPACE_IN_LINE + r"\n"
# The same white space, character by character.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A letter, digit, numeral or underscore, as the inside of a regex class.
WORD = r"\p{L}\p{N}_"

# Scene-break lines: three or more stars or hashes, exactly three dashes or tildes.
SCENE_TEMPLATE = (
    r"\*[{s}]*\*[{s}]*\*[{s}*]*"
    r"|#{{3,}}"
    r"|-[{s}]*-[{s}]*-"
    r"|~[{s}]*~[{s}]*~"
)
SCENE_MARK = "***"

# Words that continue a quoted sentence ("...," she said). Matched without case.
DIALOGUE_TAG_WORDS = (
    "he", "she", "they", "i", "we", "it", "you", "his", "her", "their", "the",
    "said", "asked", "whispered", "murmured", "replied", "answered", "shouted", "yelled",
    "cried", "called", "snapped", "hissed", "muttered", "breathed", "added", "continued",
    "harry", "ron", "hermione", "draco", "ginny", "luna", "neville", "snape", "remus", "sirius",
    "malfoy", "potter", "granger", "he'd", "she'd", "they'd", "he'll", "she'll", "they'll",
)
# The shorter list of the strict dialect.
PRONOUN_TAG_WORDS = (
    "he", "she", "they", "i", "we", "it", "you", "his", "her", "their", "the",
)

CLOSING_QUOTES = "\"”’"
OPENING_QUOTES = "\"“‘"
LOWER_START = "a-z(\\[—\\-'"
LOWER_START_STRICT = "a-z("
OPEN_LINE_MARKS = ",—\\-"
OPEN_PARAGRAPH_MARKS = ",;:—\\-"

# Length limits of the aggressive paragraph merge, in characters.
SHORT_PREVIOUS = 110
SHORT_QUOTED_PREVIOUS = 90
SHORT_NEXT = 120

BLOCK_TAGS = ("p", "blockquote", "div", "li")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "source", "track", "wbr",
)
DROP_TAGS = ("nav",)
DROP_CLASSES = ("landmark", "actions", "download")
NOTE_CLASSES = ("preface", "notes", "endnotes")
NOTE_IDS = ("notes", "work_endnotes")

DOWNLOAD_FORMATS = ("epub", "html", "pdf", "mobi", "azw3")
DEFAULT_FORMAT_ORDER = ("epub", "html", "pdf")
DEFAULT_WORK_HOST = "archiveofourown.org"
DEFAULT_WORK_SCHEME = "https"
DEFAULT_WORK_TITLE = "AO3 Work"
DEFAULT_WORK_FILE = "ao3_work"

UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_AUTHOR = "Unknown Author"

# Characters that file systems refuse.
ILLEGAL_FILE_CHARS = r'<>:"/\\|?*'
# --- end of fixed values ----------------------------------------------------------


def scene_pattern(space: str) -> str:
    return SCENE_TEMPLATE.format(s=space)


def any_of(words) -> str:
    return "|".join(words)
