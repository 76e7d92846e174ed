"""Lines of paragraphs and pages of lines: greedy fills, as folds over a section's arrays.

Widths are whole numbers, in thousandths of the font size, so results don't depend on the
order of additions. Heights are hundredths of a line.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .expr import fold_text, indices

#: Width of the characters of a book face; all others have DEFAULT_WIDTH.
WIDTHS = (
    (230, "ijl.,;:'|!’‘·"),
    (340, "frtIJ()[]{}-/\\*\"”“"),
    (460, "acegksvxyz?"),
    (660, "ABCDEFGHKLNOPQRSTUVXYZ&"),
    (840, "mMwW@%—…"),
)
DEFAULT_WIDTH, SPACE_WIDTH = 520, 250
#: Height of a scene break with the space around it, in hundredths of a line.
SCENE_HEIGHT = 240
#: Lines of a paragraph that must stay together before and after a page break.
ORPHANS = WIDOWS = 2
#: What separates words.
BLANKS = r"[ \t\n\r\f]+"


def word_widths(text: Column, widths=WIDTHS, default: int = DEFAULT_WIDTH) -> Column:
    """Widths of the words of a paragraph, in order.

    Each character is first put in place of its width, in one pass over the paragraph; a word is
    then measured by counting the marks. Marks are characters that no text should hold.
    """
    marks = "".join(chr(0xE000 + k) for k in range(len(widths)))
    other = chr(0xE000 + len(widths))
    plain = F.translate(
        text, "".join(characters for _, characters in widths) + marks,
        "".join(mark * len(characters) for mark, (_, characters) in zip(marks, widths, strict=True)) + other * len(marks))

    def measured(word: Column) -> Column:
        total = F.length(word) * (default + sum(width - default for width, _ in widths))
        for mark, (width, _) in zip(marks, widths, strict=True):
            total = total - F.length(F.replace(word, F.lit(mark), F.lit(""))) * (width - default)
        return total.cast("bigint")

    return F.transform(F.filter(F.split(plain, BLANKS), lambda w: w != ""), measured)


def line_count(sizes: Column, measure: Column, indent: Column, space: int = SPACE_WIDTH) -> Column:
    """Lines of a paragraph with words of these ``sizes``, filled greedily up to ``measure``.

    The first line is indented. A word wider than a line has a line of its own. The state of
    the fold is the number of lines and the width of the last one.
    """
    def state(lines: Column, used: Column) -> Column:
        return F.struct(lines.cast("int").alias("lines"), used.cast("bigint").alias("used"))

    def add(acc: Column, size: Column) -> Column:
        longer = acc["used"] + space + size
        start = F.when(acc["lines"] == 0, indent).otherwise(F.lit(0)) + size
        return F.when(longer <= measure, state(acc["lines"], longer)).otherwise(state(acc["lines"] + 1, start))

    # a full line before the first word: whatever comes starts a line
    return F.aggregate(sizes, state(F.lit(0), measure), add, lambda acc: acc["lines"])


#: For each box of a section the lines of its texts and of its heading.
LINES_TYPE = "array<struct<counts:array<int>,heading:int>>"


def section_lines(widths=WIDTHS, default: int = DEFAULT_WIDTH, space: int = SPACE_WIDTH):
    """A function of texts (null for a scene break), whether each of them is indented, a heading and
    boxes ``(measure, heading_measure, indent)``: for each box the lines of every text (-1 for a
    scene break) and of the heading.

    Widths and lines are those of ``word_widths`` and ``line_count``. A fold of Spark's takes a
    dozen small steps for each word and box; here it is one addition, on Arrow batches.
    """
    counted = lines_of_arrays(widths, default, space)

    @F.arrow_udf(LINES_TYPE)
    def lines(texts: pa.Array, indented: pa.Array, headings: pa.Array, boxes: pa.Array) -> pa.Array:
        return counted(texts, indented, headings, boxes)

    return lines


def with_section_lines(df: DataFrame, keep: list[str], arguments: list[Column], name: str) -> DataFrame:
    """The columns ``keep``, and ``name``: the ``section_lines`` of the arguments."""
    given = [f"_{i}" for i in range(len(arguments))]
    counted = lines_of_arrays()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lines = counted(*[batch.column(c) for c in given])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lines], [*keep, name])

    rows = df.select(*keep, *[a.alias(c) for a, c in zip(arguments, given, strict=True)])
    schema = T.StructType([*rows.select(*keep).schema.fields, *T.StructType.fromDDL(f"{name} {LINES_TYPE}")])
    return rows.mapInArrow(run, schema)


def lines_of_arrays(widths=WIDTHS, default: int = DEFAULT_WIDTH, space: int = SPACE_WIDTH):
    """``section_lines`` as a function of Arrow arrays; a closure, so that it travels by value."""
    def lines(texts, indented, headings, boxes):
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa

        table = np.full(1 << 16, default, np.int64)
        for w, characters in widths:
            table[[ord(c) for c in characters]] = w
        blanks = np.zeros(1 << 16, bool)
        blanks[[ord(c) for c in " \t\n\r\f"]] = True

        def ends(paragraphs: list[str]) -> tuple[list[int], list[int]]:
            """Places of the ends of all words as if they stood in one line, a space behind each,
            and how many words there are up to each paragraph's end."""
            codes = np.frombuffer("\n".join([*paragraphs, ""]).encode("utf-32-le"), np.uint32)
            codes = np.minimum(codes, len(table) - 1)
            blank = blanks[codes]
            last = np.flatnonzero(~blank[:-1] & blank[1:])
            placed = np.cumsum(np.where(blank, 0, table[codes]))[last] + space * np.arange(1, len(last) + 1)
            stops = np.cumsum([len(p) + 1 for p in paragraphs]) - 1
            return placed.tolist(), np.searchsorted(last, stops).tolist()

        def count(of: list[int], first: int, stop: int, measure: int, indent: int) -> int:
            n, room = 0, measure + space - indent
            while first < stop:
                first = max(bisect_right(of, room + (of[first - 1] if first else 0), first, stop), first + 1)
                n, room = n + 1, measure + space
            return n

        out = []
        for paragraphs, flags, heading, wanted in zip(texts, indented, headings, boxes, strict=True):
            paragraphs, flags = paragraphs.as_py(), flags.as_py()
            of, stops = ends([*[p or "" for p in paragraphs], heading.as_py()])
            firsts = [0, *stops]
            parts = list(zip(paragraphs, flags, firsts, stops))  # without the heading, which is last
            out.append([{
                "counts": [-1 if p is None else count(of, first, stop, b["measure"], b["indent"] if f else 0)
                           for p, f, first, stop in parts],
                "heading": count(of, firsts[-2], stops[-1], b["heading_measure"], 0)} for b in wanted.as_py()])
        return pa.array(out, pa.list_(pa.struct([("counts", pa.list_(pa.int32())), ("heading", pa.int32())])))

    return lines


def on_empty_page(rest: Column, lines: Column) -> tuple[Column, Column, Column]:
    """(lines on this page, pages begun after it, lines on the last one) when ``rest`` > 0 lines
    start on an empty page of so many ``lines``. No page ends so that one line is left over."""
    more = F.ceil(rest / lines).cast("int") - 1
    last = (rest - more * lines).cast("int")
    lonely = (last < WIDOWS) & (more > 0) & (lines > ORPHANS)
    last = F.when(lonely, F.lit(WIDOWS)).otherwise(last)
    first = F.when(more == 0, rest).when((more == 1) & lonely, lines - 1).otherwise(lines)
    return first.cast("int"), more, last.cast("int")


def page_marks(blocks: Column, lines: Column, gap: Column, top: Column) -> Column:
    """For each block ``(height, n)`` the page on which it stands or would begin, from 1, and the
    lines that this page takes of it: an array of ``page:lines``.

    ``n`` is the number of lines of a paragraph, or 0 for a scene break, which is never split.
    The first page has ``top`` hundredths of a line used for the heading. A paragraph that
    doesn't fit is split so that at least two lines stay on either side, or moves as a whole.
    """
    full = lines * 100

    def step(acc: dict[str, Column], i: Column) -> tuple[dict[str, Column], Column]:
        block = F.get(blocks, i)
        n = block["n"]
        room = F.greatest(F.floor((full - acc["used"]) / 100), F.lit(0)).cast("int")
        split = F.least(room, n - WIDOWS)
        empty = acc["used"] == 0
        fits = F.when(n == 0, empty | (acc["used"] + block["height"] <= full)).otherwise(n <= room)
        here = F.when(fits, n).otherwise(F.when(split >= ORPHANS, split).otherwise(0))
        first, more, last = on_empty_page(F.when(empty, n).otherwise(n - here), lines)
        added = F.when(n == 0, block["height"]).otherwise(n * 100 + gap)
        used = (
            F.when(fits, acc["used"] + added)
            .when(n == 0, block["height"])
            .otherwise(last * 100 + gap)
        )
        page = acc["page"] + F.when(fits, 0).when(empty, more).when(n == 0, 1).otherwise(1 + more)
        taken = F.when(fits, F.when(n == 0, 1).otherwise(n)).when(empty & (n > 0), first).otherwise(here)
        mark = F.concat(acc["page"].cast("string"), F.lit(":"), taken.cast("string"), F.lit(" "))
        return {"page": page.cast("int"), "used": used.cast("bigint")}, mark

    zero = {"page": F.lit(1), "used": top.cast("bigint")}
    return F.filter(F.split(fold_text(F.size(blocks), zero, step), " "), lambda m: m != "")


def page_starts(blocks: Column, marks: Column, lines: Column) -> Column:
    """``(page, first_paragraph, first_line)`` of each page of a section, from its marks."""
    def of_block(block: Column, i: Column, mark: Column) -> Column:
        page = F.substring_index(mark, ":", 1).cast("int")
        taken = F.substring_index(mark, ":", -1).cast("int")
        n = F.greatest(block["n"], F.lit(1))
        _, more, last = on_empty_page(n - taken, lines)
        start = lambda j: F.when((j == more) & (more > 0), n - last).otherwise(taken + j * lines)
        new = F.transform(F.sequence(F.lit(0), more), lambda j: F.struct(
            (page + 1 + j).cast("int").alias("page"), i.cast("int").alias("first_paragraph"), start(j).cast("int").alias("first_line")))
        none = F.array().cast("array<struct<page:int,first_paragraph:int,first_line:int>>")
        return F.when(taken < n, new).otherwise(none)

    first = F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("first_paragraph"), F.lit(0).alias("first_line")))
    later = F.transform(indices(blocks), lambda i: of_block(F.get(blocks, i), i, F.get(marks, i)))
    return F.concat(first, F.flatten(later))
