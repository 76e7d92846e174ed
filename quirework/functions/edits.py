"""Shortest edit scripts of two lists of paragraphs.

Plain Python on one section at a time; Spark hands the sections out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

#: Rows of the table that are computed again at once, on the way back.
ROWS = 256

KEPT, JOINED, REMOVED, INSERTED = "kept", "joined", "removed", "inserted"


def common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, the same one for the same lists.

    Paragraphs that the other list lacks are left out first; they can't be common. On what is
    left a match at the heads is always taken; else the head of ``a`` is skipped if that loses
    nothing, and if it does, the head of ``b``. Lists that agree, or are a beginning of one
    another, need no table. Otherwise lengths of common subsequences of all tails are computed
    row by row, a bit for each; of the rows only every ``ROWS``-th is kept, and the others once
    more when the walk comes to them, so memory is far from the product of the lengths.
    """
    in_a, in_b = set(a), set(b)
    rows = [i for i, x in enumerate(a) if x in in_b]
    columns = [j for j, x in enumerate(b) if x in in_a]
    start = 0
    while start < min(len(rows), len(columns)) and a[rows[start]] == b[columns[start]]:
        start += 1
    out = list(zip(rows[:start], columns[:start], strict=True))
    rows, columns = rows[start:], columns[start:]
    if not rows or not columns:
        return out
    # Rows of bits, for the tails of ``b`` from their ends: of two neighbouring lengths the bit tells
    # whether they are equal. A row follows from the one below it by an addition.
    width = len(columns)
    whole = (1 << width) - 1
    places: dict[str, int] = defaultdict(int)
    for k, j in enumerate(reversed(columns)):
        places[b[j]] |= 1 << k

    def above(i: int, below: int) -> int:
        met = below & places[a[rows[i]]]
        return ((below + met) | (below - met)) & whole

    n = len(rows)
    kept = {n: whole}
    row = whole
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % ROWS == 0:
            kept[i] = row
    i = j = 0
    table: dict[int, int] = {}
    while i < n and j < width:
        if i not in table or i + 1 not in table:
            end = min((i // ROWS + 1) * ROWS, n)
            table = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                table[k] = above(k, table[k + 1])
        if a[rows[i]] == b[columns[j]]:
            out.append((rows[i], columns[j]))
            i, j = i + 1, j + 1
            continue
        # the head of a may go if its tail is as long a match for the same tail of b
        tail = (1 << (width - j)) - 1
        if (table[i + 1] & tail).bit_count() == (table[i] & tail).bit_count():
            i += 1
        else:
            j += 1
    return out


def script(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int | None, int | None, int | None]]:
    """(change, first and last place in ``a``, place in ``b``) for every paragraph of both lists.

    Between two kept paragraphs, one of ``b`` that is two or more neighbours of ``a`` joined by
    spaces is ``joined`` and names the first such neighbours that are still free; the
    others are ``inserted`` or ``removed``.
    """
    out: list[tuple[str, int | None, int | None, int | None]] = []
    low = at = 0
    for i, j in [*common(a, b), (len(a), len(b))]:
        out += _between(a, b, low, i, at, j)
        if i < len(a):
            out.append((KEPT, i, i, j))
        low, at = i + 1, j + 1
    return out


def _between(a, b, low: int, high: int, at: int, end: int):
    places: dict[str, list[int]] = defaultdict(list)
    if at < end:
        for i in range(low, high):
            places[a[i]].append(i)
    free = low
    for j in range(at, end):
        run = _joined(a, b[j], places, free, high)
        if run is None:
            yield INSERTED, None, None, j
            continue
        for i in range(free, run[0]):
            yield REMOVED, i, i, None
        yield JOINED, *run, j
        free = run[1] + 1
    for i in range(free, high):
        yield REMOVED, i, i, None


def _joined(a, text: str, places, free: int, high: int) -> tuple[int, int] | None:
    starts = []
    cut = text.find(" ")
    while cut > 0:
        found = places.get(text[:cut], ())
        starts += found[bisect_left(found, free):] if found else []
        cut = text.find(" ", cut + 1)
    for first in sorted(starts):
        last, size = first, len(a[first])
        while size < len(text) and last + 1 < high and text.startswith(a[last + 1], size + 1) and text[size] == " ":
            last += 1
            size += 1 + len(a[last])
        if size == len(text) and last > first:
            return first, last
    return None
