from __future__ import annotations

import itertools
import random
import string

import models
from pyspark.sql import functions as F

from quirework.functions import text as T

PIECES = [
    "a", "The", "he said", "Said", "theé", "word,", "end.", '"quote"', "‘hi’", "“x,”", "-", "—", "- - -", "---", "----",
    "***", "* * *", "** *", "###", "####", "~~~", "~ ~ ~", "# #", " ", "  ", "\t", "\u00a0", " ", "\n", "\n\n", "\n\n\n",
    "\r\n", "\r", "é", "(x", "'tis", "[y", "she'd", "I", "It,", "\u0085", "﷐",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_clean_text_matches_the_model_under_all_settings(evaluate):
    texts = random_texts(1500, 1)
    for flags in itertools.product([True, False], repeat=4):
        got = evaluate(lambda c: T.clean_text(c, *flags), texts)
        assert got == [models.clean(t, *flags) for t in texts], flags


def test_clean_text_with_column_switches_is_the_same(spark):
    texts = random_texts(300, 2)
    flags = list(itertools.product([True, False], repeat=4))
    df = spark.createDataFrame([(i, t, *f) for i, t in enumerate(texts) for f in flags],
                               "i int, x string, a boolean, b boolean, c boolean, d boolean")
    rows = df.select("*", T.clean_text(F.col("x"), *[F.col(k) for k in "abcd"]).alias("y")).collect()
    for r in rows:
        assert r.y == models.clean(r.x, r.a, r.b, r.c, r.d)


def test_clean_text_is_idempotent_with_default_settings(evaluate):
    once = evaluate(T.clean_text, random_texts(1500, 3))
    assert evaluate(T.clean_text, once) == once


def test_clean_text_keeps_all_visible_characters(evaluate):
    texts = random_texts(500, 4)
    for t, c in zip(texts, evaluate(lambda c: T.clean_text(c, False, True, True, True), texts)):
        assert "".join(t.split()) == "".join(c.split())


def test_pairs_follow_the_greedy_scan(spark):
    rng = random.Random(5)
    lists = [[rng.choice(["a,", "b", "C.", '"', "he", "The", "d-", "E"]) for _ in range(rng.randint(0, 9))] for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, x array<string>")
    rows = df.select("i", T.join_dialogue_lines(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r.y == models.pair_up(lists[r.i])


def test_strict_dialect(spark):
    def joined(lines):
        df = spark.createDataFrame([(lines,)], "x array<string>")
        return df.select(T.join_dialogue_lines(F.col("x"), strict=True)).first()[0]

    assert joined(["a, b", "c"]) == ["a, b", "c"]  # comma not at the end
    assert joined(["a b,", "c"]) == ["a b, c"]
    assert joined(["a b,", "—c"]) == ["a b,", "—c"]
    assert joined(['"x"', "They"]) == ['"x" They']
    assert joined(['"x"', "Said"]) == ['"x"', "Said"]


def test_scene_breaks(evaluate):
    yes = ["***", "* * *", "*  ****", "###", "#####", "---", "- - -", "~~~", "~ ~  ~", "***\n***"]
    no = ["**", "##", "# # #", "----", "- -", "~~~~", "*** a", "", "a", "-- --"]
    assert evaluate(T.is_scene_break, yes) == [True] * len(yes)
    assert evaluate(T.is_scene_break, no) == [False] * len(no)


def test_strip_takes_what_python_takes(evaluate):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = [f"{s}a{s}b{s}{s}" for s in spaces] + [chr(0x200b) + "a", "", " "]
    assert evaluate(T.py_strip, values) == [v.strip() for v in values]
    assert evaluate(T.py_rstrip, values) == [v.rstrip() for v in values]


def test_normalize_spaces(evaluate):
    rng = random.Random(6)
    values = ["".join(rng.choice([" ", "\t", "\n", "a", "\u00a0"]) for _ in range(12)) for _ in range(400)]

    def model(v, nbsp):
        import re
        v = v.replace("\u00a0", " ") if nbsp else v
        return re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", v))

    for nbsp in (True, False):
        assert evaluate(lambda c: T.normalize_spaces(c, nbsp), values) == [model(v, nbsp) for v in values]


def test_word_boundary_is_unicode(evaluate):
    values = ["the cat", "theé", "the½", "the_", "THE.", "he'd", "hers", "I", string.ascii_letters]
    assert evaluate(T.starts_with_tag, values) == [True, False, False, False, True, True, False, True, False]


def test_both_paths_agree_on_spaces_and_strictness(spark):
    """Constant and column switches are built differently; the answers must not differ."""
    rng = random.Random(11)
    parts = ["a", "B.", "\u00a0", " ", "\u00a0 ", "\n", "\r\n", "\n\n", '"c,"', "he said", "***", "\t", "x,", "  ", "---"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["a\u00a0b"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").withColumns({"yes": F.lit(True), "no": F.lit(False)})
    df = df.select(F.col("x"), *[F.when(F.length("x") >= 0, F.lit(v)).alias(n) for n, v in (("yes", True), ("no", False))])
    for soft in (True, False):
        for strict in (True, False):
            for nbsp in (True, False):
                fixed = T.clean_text(F.col("x"), soft, True, True, True, strict=strict, nbsp=nbsp)
                column = T.clean_text(F.col("x"), F.col("yes" if soft else "no"), F.col("yes"), F.col("yes"), F.col("yes"),
                                      strict=strict, nbsp=nbsp)
                wrong = df.select("x", fixed.alias("a"), column.alias("b")).filter("a <> b").collect()
                assert wrong == [], (soft, strict, nbsp)
    assert df.filter("x = 'a\u00a0b'").select(T.clean_text(F.col("x"), nbsp=False).alias("y")).first().y == "a\u00a0b"
