"""Character references of HTML 5, decoded as text or as an attribute's value."""

from __future__ import annotations

from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column, functions as F

from . import patterns as P
from .expr import let

#: The references that are looked for first.
FREQUENT = ("amp", "lt", "gt", "quot", "apos", "nbsp")
REPLACEMENT = "�"
#: Numbers that give no character, besides the last two of each plane.
SILENT = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF))


def _names() -> list[str]:
    """All names, without the semicolon, in order."""
    return sorted({n.removesuffix(";") for n in html5})


def _short_names() -> list[str]:
    """Names that need no semicolon, the longest first: a name may begin with another one."""
    return sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _constant(values: list[str]) -> Column:
    """An array that is folded to a constant."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def named_value(name: Column) -> Column:
    """The characters of a name, or null. The names are searched by halves: ``place`` is the number
    of names up to ``name`` as far as the steps so far can tell."""
    names = _names()
    table, values = _constant(names), _constant([html5[f"{n};"] for n in names])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(names).bit_length()))])

    def found(n: Column) -> Column:
        place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= len(names)) & (F.get(table, at + step - 1) <= n), at + step).otherwise(at))
        return let(place, lambda at: F.when((at > 0) & (F.get(table, at - 1) == n), F.get(values, at - 1)))

    return let(name, found)


def _c1(n: int) -> str:
    """What a reference to a control character from 0x80 to 0x9F means: Windows-1252, if it has one."""
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


def code_point(n: Column) -> Column:
    """The character of a numeric reference. Numbers that are no characters of a text give none."""
    wrong = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    silent = reduce(or_, [n.between(*pair) for pair in SILENT]) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    controls = _constant([_c1(k) for k in range(0x80, 0xA0)])
    return (
        F.when(wrong, REPLACEMENT)
        .when(n.between(0x80, 0x9F), F.get(controls, (n - 0x80).cast("int")))
        .when(silent, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def blank_reference() -> str:
    """A pattern: a reference in a text that stands for white space, or for no character."""
    names = [n for n, value in html5.items() if not value.strip(P.SPACE_CHARS)]
    whole, short = ("|".join(n.removesuffix(";") for n in names if n.endswith(";") == end) for end in (True, False))
    numbers = [ord(c) for c in P.SPACE_CHARS if not 0x80 <= ord(c) < 0xA0]
    numbers += [n for first, last in SILENT for n in range(first, last + 1)]
    numbers += [plane << 16 | n for plane in range(17) for n in (0xFFFE, 0xFFFF)]
    decimal, hexes = "|".join(map(str, numbers)), "|".join(f"{n:x}" for n in numbers)
    return (rf"&(?:{whole});|&(?:{short})(?![A-Za-z0-9])|&#0*+(?:{decimal})(?![0-9]);?"
            rf"|&#[xX]0*+(?i:{hexes})(?![0-9a-fA-F]);?")


def _numeric(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"^&#0*([0-9]{1,9});?$", 1)
    hexes = F.regexp_extract(ref, r"^&#[xX]0*([0-9a-fA-F]{1,7});?$", 1)
    return (
        F.when(digits != "", let(digits.cast("bigint"), code_point))
        .when(hexes != "", let(F.conv(hexes, 16, 10).cast("bigint"), code_point))
        .otherwise(REPLACEMENT)
    )


def _named(ref: Column, attribute: bool) -> Column:
    """A name with its semicolon, or else the longest name at its beginning that needs none. In an
    attribute a name without semicolon must be the whole reference."""
    short = "|".join(_short_names())
    name = F.substring_index(F.substring(ref, 2, 64), ";", 1)
    whole = F.when(ref.endswith(";"), named_value(name))
    if attribute:
        rest = F.when(name.rlike(f"^(?:{short})$") & ~ref.endswith(";"), named_value(name))
    else:
        rest = let(F.regexp_extract(ref, f"^&({short})", 1), lambda s: F.when(
            s != "", F.concat(named_value(s), F.substring(ref, F.length(s) + 2, F.length(ref)))))
    return F.coalesce(whole, rest, ref)


def decode(c: Column, attribute: bool = False) -> Column:
    """Character references, each decoded once, left to right."""
    # in an attribute a name before an equals sign is a parameter of a query
    end = "(?:;|(?!=))" if attribute else ";?"
    part = rf"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+{end})|[^&]++|&"

    def one(t: Column) -> Column:
        out = F.when(~t.startswith("&") | (F.length(t) < 3), t)
        for name in FREQUENT:
            out = out.when(t == f"&{name};", html5[f"{name};"])
        return out.when(F.substring(t, 2, 1) == "#", _numeric(t)).otherwise(_named(t, attribute))

    decoded = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(part), F.lit(0)), one), "")
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)
