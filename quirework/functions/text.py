"""Text normalisation, scene breaks, line joining and the whole clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P
from .expr import indices, islands, let

# A Unicode noncharacter: never part of interchanged text. Rows that hold it anyway
# take the array path of ``clean_text``, so nothing is lost.
_MARK = "\ufdd0"


def py_strip(c: Column) -> Column:
    """Strip all Unicode white space on both ends (plain ``trim`` knows only U+0020).

    Looks at the ends only, where a pattern would be tried at every character.
    """
    return F.trim(c, F.lit(P.SPACE_CHARS))


def py_rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(P.SPACE_CHARS))


def squeeze_spaces(c: Column) -> Column:
    """White space of every kind as single blanks, none at the ends. ``c`` should be cheap to
    evaluate repeatedly."""
    # a quick look, which takes a few other characters for spaces: most texts are squeezed already
    odd = F.contains(c, F.lit("  ")) | c.rlike(r"[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}-\x{3000}]")
    return py_strip(F.when(odd, F.regexp_replace(c, f"[{P.SPACE}]+", " ")).otherwise(c))


def first_is(c: Column, chars: str) -> Column:
    """The first character is one of a regex class."""
    return F.substring(c, 1, 1).rlike(f"^[{chars}]")


def last_is(c: Column, chars: str) -> Column:
    """The last character is one of a regex class."""
    return F.substring(c, -1, 1).rlike(f"^[{chars}]")


def normalize_line_endings(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_spaces(c: Column, nbsp: bool = True) -> Column:
    """Collapse blanks and tabs, and drop the blanks around line ends."""
    if nbsp:
        c = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), r" {2,}", " ")
    # at most one blank is left on either side of a line end
    return F.replace(F.replace(c, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))


def collapse_blank_lines(c: Column) -> Column:
    return py_strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def is_scene_break(stripped: Column) -> Column:
    """``stripped`` must have no white space at its ends."""
    return first_is(stripped, r"*#\-~") & stripped.rlike(rf"^(?:{P.scene_pattern(P.SPACE)})\z")


# --- predicates on stripped, non-empty lines or paragraphs ------------------------


def starts_lower(c: Column, strict: bool = False) -> Column:
    return first_is(c, P.LOWER_START_STRICT if strict else P.LOWER_START)


def starts_with_tag(c: Column, words=P.DIALOGUE_TAG_WORDS) -> Column:
    head = F.substring(c, 1, max(map(len, words)) + 1)
    return head.rlike(rf"^(?i:{P.any_of(words)})(?![{P.WORD}])")


def ends_with_quote(c: Column) -> Column:
    return last_is(c, P.CLOSING_QUOTES)


def lines_joinable(cur: Column, nxt: Column, strict: bool = False, words=None) -> Column:
    """May the next line be put behind the current one?

    The loose dialect looks for a comma or dash anywhere in the current line, the strict
    one only at its end.
    """
    if strict:
        words = words or P.PRONOUN_TAG_WORDS
        opened = last_is(cur, P.OPEN_LINE_MARKS + P.CLOSING_QUOTES)
    else:
        words = words or P.DIALOGUE_TAG_WORDS
        opened = cur.rlike(rf"[{P.OPEN_LINE_MARKS}]") | ends_with_quote(cur)
    return (opened & starts_lower(nxt, strict)) | (
        ends_with_quote(cur) & starts_with_tag(nxt, words)
    )


# --- arrays of lines --------------------------------------------------------------


def text_lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n"), py_strip)


def join_dialogue_lines(lines: Column, strict: bool = False, words=None) -> Column:
    """Join neighbouring lines in pairs, left to right; a joined pair is not tested again.

    Lines that are joinable one after the other form an island. Inside an island every
    neighbour pair is joinable, so the pairs are simply (0,1), (2,3), ...
    """
    return let(
        lines,
        lambda ls: F.flatten(
            F.transform(
                islands(
                    ls,
                    lambda line, i: (i == 0)
                    | ~lines_joinable(F.get(ls, i - 1), line, strict, words),
                ),
                _pairs,
            )
        ),
    )


def _pairs(island: Column) -> Column:
    return F.when(F.size(island) < 2, island).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size(island), F.lit(2)),
            lambda k: F.array_join(F.slice(island, k, 2), " "),
        )
    )


def soft_wrap(lines: Column) -> Column:
    """One line out of many."""
    joined = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return py_strip(F.regexp_replace(joined, r" {2,}", " "))


def line_blocks(lines: Column, preserve_scene_breaks=True) -> Column:
    """Lines -> blocks ``struct(kind, first_line, lines)`` with kind text, scene or blank.

    A blank line and a scene line stand alone; text lines between them form a block.
    """
    preserve = _flag(preserve_scene_breaks)

    def kinds(ls):
        return F.transform(
            ls,
            lambda x: F.when(x == "", F.lit("blank"))
            .when(preserve & is_scene_break(x), F.lit("scene"))
            .otherwise(F.lit("text")),
        )

    def build(ls):
        return let(
            kinds(ls),
            lambda ks: let(
                F.filter(
                    indices(ks),
                    lambda i: (i == 0)
                    | (F.get(ks, i) != "text")
                    | (F.get(ks, i - 1) != "text"),
                ),
                lambda starts: F.transform(
                    starts,
                    lambda s, k: F.struct(
                        F.get(ks, s).alias("kind"),
                        s.alias("first_line"),
                        F.slice(
                            ls, s + 1, F.coalesce(F.get(starts, k + 1), F.size(ls)) - s
                        ).alias("lines"),
                    ),
                ),
            ),
        )

    return let(lines, build)


def _flag(value) -> Column:
    return value if isinstance(value, Column) else F.lit(bool(value))


def clean_text(
    c: Column,
    soft_wrapped=True,
    dialogue=True,
    collapse=True,
    preserve=True,
    *,
    strict: bool = False,
    nbsp: bool = True,
    words=None,
) -> Column:
    """The main text operator. The four switches may be booleans or boolean columns.

    With constant switches and soft wrapping on, it is a chain of replacements inside
    generated code. All other settings use arrays of lines.
    """
    full = _clean_multiline(
        c, soft_wrapped, dialogue, collapse, preserve, strict=strict, nbsp=nbsp, words=words
    )
    if soft_wrapped is True:
        # one block of text without scene lines: joining its lines is all there is to do
        ws = P.SPACE_IN_LINE
        several = (
            F.contains(c, F.lit("\r")) | F.contains(c, F.lit(_MARK)) | c.rlike(rf"\n[{ws}]*+[\n*#~\-]")
            | first_is(F.ltrim(c, F.lit(P.SPACE_CHARS)), r"*#~\-")
        )
        # patterns that begin with a line end pass quickly over all else
        spaced = c.rlike(rf"\n(?:[{ws}]|(?<=[{ws}]\n))")
        lines = F.when(spaced, F.regexp_replace(c, rf"[{ws}]*+\n[{ws}]*+", " ")).otherwise(F.regexp_replace(c, "\n", " "))
        blanks = r"\t\x{a0}" if nbsp else r"\t"
        joined = let(lines, lambda t: F.when(
            F.contains(t, F.lit("  ")) | t.rlike(f"[{blanks}]"), F.regexp_replace(t, f"[ {blanks}]+", " ")).otherwise(t))
        full = F.when(several, full).otherwise(py_strip(joined))
    # most paragraphs are a single line without anything to repair, under any setting
    odd = F.contains(c, F.lit("\n")) | F.contains(c, F.lit("  ")) | c.rlike(rf"[\r\t\x{{a0}}{_MARK}]")
    return F.when(odd, full).otherwise(py_strip(c))


def _clean_multiline(c, soft_wrapped, dialogue, collapse, preserve, *, strict, nbsp, words):
    constant = all(isinstance(x, bool) for x in (soft_wrapped, collapse, preserve))
    normalized = normalize_spaces(normalize_line_endings(c), nbsp)
    if not (constant and soft_wrapped):
        return _clean_by_lines(
            normalized, soft_wrapped, dialogue, collapse, preserve, strict, words
        )
    fast = _clean_by_regex(normalized, collapse, preserve)
    if not preserve:
        return fast
    return F.when(
        F.contains(c, F.lit(_MARK)),
        _clean_by_lines(normalized, soft_wrapped, dialogue, collapse, preserve, strict, words),
    ).otherwise(fast)


def _clean_by_regex(normalized: Column, collapse: bool, preserve: bool) -> Column:
    ws = P.SPACE_IN_LINE
    # blanks next to line ends are gone already; this takes the rarer kinds of space
    c = F.regexp_replace(normalized, rf"(?md)^[{ws}]++|[{ws}]++$", "")
    if preserve:
        c = F.regexp_replace(c, rf"(?md)^(?:{P.scene_pattern(ws)})$", f"{_MARK}$0{_MARK}")
        c = F.regexp_replace(c, rf"\n(?<![\n{_MARK}]\n)(?![\n{_MARK}])", " ")
        c = F.replace(c, F.lit(_MARK), F.lit(""))
    else:
        c = F.regexp_replace(c, r"\n(?<!\n\n)(?!\n)", " ")
    return collapse_blank_lines(c) if collapse else py_strip(c)


def _clean_by_lines(normalized, soft_wrapped, dialogue, collapse, preserve, strict, words):
    soft, dia = _flag(soft_wrapped), _flag(dialogue)

    def block_text(b):
        joined = F.when(dia & ~soft, join_dialogue_lines(b["lines"], strict, words)).otherwise(
            b["lines"]
        )
        return F.when(b["kind"] != "text", F.get(b["lines"], F.lit(0))).otherwise(
            F.when(soft, soft_wrap(b["lines"])).otherwise(F.array_join(joined, "\n"))
        )

    joined = F.array_join(
        F.transform(line_blocks(text_lines(normalized), preserve), block_text), "\n"
    )
    if isinstance(collapse, bool):
        return collapse_blank_lines(joined) if collapse else py_strip(joined)
    return let(
        joined, lambda j: F.when(collapse, collapse_blank_lines(j)).otherwise(py_strip(j))
    )
