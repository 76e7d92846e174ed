"""Plain Python statements of the rules, for comparison on small random inputs."""

from __future__ import annotations

import re
from itertools import groupby

from quirework.functions import patterns as P

SCENE = re.compile(r"(?:(?:\*\s*){3,}|#{3,}|-\s*-\s*-|~\s*~\s*~)")
TAG = re.compile("(?:" + "|".join(P.DIALOGUE_TAG_WORDS) + r")\b", re.I)
LOWER = re.compile("[a-z(\\[—\\-']")
QUOTES = tuple(P.CLOSING_QUOTES)


def is_scene(s):
    return SCENE.fullmatch(s) is not None


def joinable(a, b):
    loose = any(m in a for m in ",—-") or a.endswith(QUOTES)
    return bool((loose and LOWER.match(b)) or (a.endswith(QUOTES) and TAG.match(b)))


def pair_up(lines):
    out, rest = [], list(lines)
    while rest:
        first = rest.pop(0)
        if rest and joinable(first, rest[0]):
            first = f"{first} {rest.pop(0)}"
        out.append(first)
    return out


def clean(text, soft=True, dialogue=True, collapse=True, preserve=True):
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    lines = [re.sub(r"[ \t]+", " ", line).strip() for line in text.split("\n")]

    def kind(line):
        return "blank" if not line else "scene" if preserve and is_scene(line) else "text"

    out = []
    for k, group in groupby(lines, kind):
        group = list(group)
        if k == "blank":
            out += [""] if collapse else group
        elif k == "scene":
            out += group
        elif soft:
            out.append(re.sub(" {2,}", " ", " ".join(group)).strip())
        else:
            out += pair_up(group) if dialogue else group
    joined = "\n".join(out)
    if collapse:
        joined = re.sub(r"\n{3,}", "\n\n", joined)
    return joined.strip()


# A joint is written "before NUL after"; these say what a joint must look like to be closed.
OPENING = "(?:[a-z(\\[—\\-']|(?i:" + "|".join(P.DIALOGUE_TAG_WORDS) + r")\b)"
CARRIED_ON = re.compile(f"[,;:—\\-\"”’]\0{OPENING}")
CONTINUES = re.compile(f"\0{OPENING}")
FINISHED = re.compile("[.!?][\"”’]?\0")
QUOTED = re.compile("[\"“‘]")


def closed(before, after, bold):
    """Whether two neighbouring paragraphs belong together; scene marks never do."""
    joint = f"{before}\0{after}"
    if not before or not after or is_scene(before) or is_scene(after):
        return False
    if CARRIED_ON.search(joint):
        return True
    short = len(before) <= 110 or len(after) <= 120
    quoted = len(before) <= 90 and QUOTED.match(before)
    return bool(bold and not FINISHED.search(joint) and (quoted or short and CONTINUES.search(joint)))


def faults(items, result, bold=False):
    """What is wrong with ``result`` as the merge of ``items``: every piece must be a run of
    items, all joints within a piece closed, and the joint to the next piece open."""
    wrong, rest = [], list(items)
    for kind, text in result:
        if not rest or rest[0][0] != kind:
            return [*wrong, ("kind", kind, text)]
        built = rest.pop(0)[1]
        while built != text:
            if kind != "p" or not rest or rest[0][0] != "p" or not closed(built, rest[0][1], bold):
                return [*wrong, ("should be apart", built, text)]
            built += " " + rest.pop(0)[1]
        if kind == "p" and rest and rest[0][0] == "p" and closed(built, rest[0][1], bold):
            wrong.append(("should be joined", built, rest[0][1]))
    return wrong + [("lost", x) for x in rest]
