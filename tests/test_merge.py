from __future__ import annotations

import random

import models
import pytest
from pyspark.sql import functions as F

from quirework.functions import merge as M

TYPE = "i int, items array<struct<kind:string,text:string>>"
TEXTS = [
    '"I don\'t know,"', "she said quietly.", "The room was silent.", "and then", "Snow drifted", '"Wait —"', "but no.",
    "- -", "-", "--", "---", "***", "x" * 60, "y" * 115, "z" * 125 + ",", '"' + "q" * 40, "“" + "r" * 95, "Who?", "it's;", "A:", "‘b’",
]


def run(spark, cases, **kw):
    df = spark.createDataFrame(list(enumerate(cases)), TYPE)
    rows = df.select("i", M.merge_items(F.col("items"), **kw).alias("y")).collect()
    return {r.i: [tuple(x) for x in r.y] for r in rows}


@pytest.mark.parametrize("aggressive", [False, True])
def test_merge_matches_the_sequential_model(spark, aggressive):
    rng = random.Random(7 + aggressive)
    cases = [
        [("scene", "***") if rng.random() < 0.08 else ("p", rng.choice(TEXTS)) for _ in range(rng.randint(0, 12))]
        for _ in range(2500)
    ]
    got = run(spark, cases, merge=True, aggressive=aggressive)
    for i, case in enumerate(cases):
        assert models.faults(case, got[i], aggressive) == [], case


def test_switch_columns(spark):
    case = [("p", '"Hello,"'), ("p", "he said.")]
    df = spark.createDataFrame([(0, case), (1, case)], TYPE)
    rows = df.select("i", M.merge_items(F.col("items"), F.col("i") == 1).alias("y")).collect()
    assert {r.i: len(r.y) for r in rows} == {0: 2, 1: 1}


def test_labelled_expectations(spark):
    pairs = {
        ('"I don\'t know,"', "she said quietly, staring at the floor."): True,
        ('"You can\'t be serious,"', "he muttered."): True,
        ('"Wait —"', "but the door had already slammed shut."): True,
        ('"Where are you going?" Harry asked.', '"Out," said Draco.'): False,
        ("The room was silent except for the ticking clock.", "Snow drifted softly against the windowpanes."): False,
    }
    got = run(spark, [[("p", a), ("p", b)] for a, b in pairs], merge=True)
    assert [len(got[i]) == 1 for i in range(len(pairs))] == list(pairs.values())


def test_scene_items(spark):
    items = [("scene", "***"), ("scene", "***"), ("p", "a"), ("p", "a"), ("scene", "***")]
    df = spark.createDataFrame([(0, items)], TYPE)
    row = df.select(
        M.dedupe_scene_breaks(F.col("items")).alias("d"),
        M.filter_scene_breaks(F.col("items"), False).alias("f"),
    ).first()
    assert [x.kind for x in row.d] == ["scene", "p", "p", "scene"]
    assert [x.text for x in row.f] == ["a", "a"]


def test_chunk_items(evaluate):
    got = evaluate(lambda c: F.to_json(M.paragraph_items(c)), ["a\nb\n\n* * *\n\nc\n***\nd\n\n\n\n-\n-\n-"])
    assert got == ['[{"kind":"p","text":"a b"},{"kind":"scene","text":"***"},'
                   '{"kind":"p","text":"c\\n***\\nd"},{"kind":"scene","text":"***"}]']


def test_second_cleaning_changes_nothing_where_scenes_are_kept(spark):
    rng = random.Random(9)
    parts = ["A", "***", "b,", "\n", "\n\n", " ", '"c"', "he", "---"]
    texts = ["".join(rng.choice(parts) + "\n" * rng.randint(0, 1) for _ in range(10)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(M.paragraph_items(F.col("x")).alias("i"))
    for soft, dialogue in ((True, True), (False, False), (True, False)):
        again = df.select("i", M.reclean_items(F.col("i"), *[F.lit(v) for v in (soft, dialogue, True, True)]).alias("j"))
        assert again.filter(~F.col("i").eqNullSafe(F.col("j"))).count() == 0


def test_a_long_run_is_merged_whole(spark):
    case = [("p", "word,")] + [("p", "go on,")] * 20000
    assert len(run(spark, [case], merge=True)[0]) == 1
    assert len(run(spark, [case], merge=True, aggressive=True)[0]) == 1
    # many paragraphs that stay apart: the fold must not slow down with their number
    apart = [("p", "No end here but a capital next"), ("p", "Other")] * 30000
    assert len(run(spark, [apart], merge=True, aggressive=True)[0]) == 60000
