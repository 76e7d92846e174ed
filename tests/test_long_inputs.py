"""Very long cells: patterns must not recurse or go quadratic."""

from __future__ import annotations

import time

import models
import pytest
from pyspark.sql import functions as F

from quirework.functions import html as H
from quirework.functions import merge as M
from quirework.functions import naming as N
from quirework.functions import text as T

LONG = 200_000

CASES = {
    "attributes": (lambda c: F.size(H.tokens(c)), "<p " + 'a="b" ' * LONG + ">x</p>", 3),
    "comment": (lambda c: F.size(H.tokens(c)), "<!--" + "x>" * LONG + "--><p>", 2),
    "unclosed quotes": (lambda c: F.size(H.tokens(c)), "<p a='>" * 2000, None),
    "script": (lambda c: F.length(H.body_content(c)), "<script>" + "</p>" * LONG + "</script>x", 1),
    "entities": (lambda c: F.length(H.decode_entities(c)), "&amp;&#65;" * LONG, 2 * LONG),
    "stars": (lambda c: T.is_scene_break(c), "* " * LONG + "*", True),
    "no scene": (lambda c: T.is_scene_break(c), "* " * LONG + "a", False),
    "one line": (lambda c: F.length(T.clean_text(c)), "word " * LONG, 5 * LONG - 1),
    "wrapped": (lambda c: F.length(T.clean_text(c)), "word\n" * LONG, 5 * LONG - 1),
    "blank lines": (lambda c: F.length(T.clean_text(c)), "a" + "\n" * LONG + "b", 4),
    "spaces": (lambda c: F.length(T.clean_text(c)), "a" + " " * LONG + "\n" + " " * LONG + "b", 3),
    "chunks": (lambda c: F.size(M.paragraph_items(c)), "a\n\n" * 50_000, 50_000),
    "slug": (lambda c: F.length(N.slugify(c)), "-a_" * LONG, 2 * LONG - 1),
    "path": (lambda c: F.length(N.slug_from_path(c)), "a" * LONG + ".pdf", LONG),
    "leaves": (lambda c: F.size(H.raw_items(H.tokens(c))), "<div>" + "<p>x</p>" * 30_000 + "</div>", 30_000),
    "deep": (lambda c: F.size(H.raw_items(H.drop_boilerplate(H.tokens(c)))), "<div class='actions'>" + "<div>" * 30_000, 0),
}


@pytest.mark.parametrize("name", list(CASES))
def test_long_input(evaluate, name):
    expr, value, want = CASES[name]
    start = time.time()
    got = evaluate(expr, [value])[0]
    assert want is None or got == want
    assert time.time() - start < 30


def test_pairwise_rule_on_long_lists(evaluate):
    text = '"Yes,"\nhe said\n' * 20_000
    got = evaluate(lambda c: T.clean_text(c, False, True, True, True), [text])[0]
    assert got == models.clean('"Yes,"\nhe said\n' * 50, soft=False)[: 15 * 50].rstrip() + got[len('"Yes," he said\n' * 50) - 1:]
    assert got.count("\n") == 20_000 - 1
