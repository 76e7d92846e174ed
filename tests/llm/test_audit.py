from __future__ import annotations

import math
import random
import re
from itertools import permutations

import pytest
from cases import HARD
from hypothesis import given, settings, strategies as st

from quirework.llm import audit


def step_counts(weights, names, order, step):
    """One step by its definition, from the masks."""
    f = names.index(order[step - 1])
    before = sum(1 << names.index(c) for c in order[: step - 1])
    here = {m: w for m, w in weights.items() if m >> f & 1}
    reached = {m: w for m, w in weights.items() if not m & before}
    lost = [w for m, w in here.items() if not m & before]
    kept = sum(w[0] for m, w in reached.items() if m not in here)
    return (kept, sum(w[0] for w in lost), sum(w[0] for m, w in here.items() if m & before),
            sum(w[0] for m, w in here.items() if m == 1 << f), sum(w[1] for w in lost), sum(w[2] for w in lost))


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5), st.data())
def test_steps_of_every_order(n, data):
    names = "ABCDE"[:n]
    counts = st.tuples(*[st.integers(0, 50)] * 3)
    weights = data.draw(st.dictionaries(st.integers(0, 2**n - 1), counts, min_size=1))
    rows = audit.table(weights, names)
    assert len(rows) == n * math.factorial(n)
    assert {r[0] for r in rows} == {"".join(p) for p in permutations(names)}
    for r in rows:
        assert r[2:8] == step_counts(weights, names, r[0], r[1])
        assert r[8] == sum(x[3] for x in rows if x[0][x[1] - 1] == r[0][r[1] - 1])


def test_swaps_touch_two_levels_and_keep_the_diagram_reduced():
    rng = random.Random(3)
    weights = {m: (rng.randint(0, 1), 0, 0) for m in range(32)}
    d = audit.Diagram(weights, 5)
    for k in audit.neighbours(5):
        others = [list(x) for i, x in enumerate(d.levels) if i not in (k, k + 1)]
        d.swap(k)
        assert others == [x for i, x in enumerate(d.levels) if i not in (k, k + 1)]
        again = audit.Diagram({sum((m >> f & 1) << i for i, f in enumerate(d.order)): w for m, w in weights.items()}, 5)
        assert [len(x) for x in d.levels] == [len(x) for x in again.levels]  # equal nodes are one
        assert list(d.steps()) == list(again.steps())


def test_own_failures():
    many = " ".join(f"w{i}" for i in range(200))
    rules = {"": 1, many: 0, many + " A": 0, many + " " + "A" * 40: 4, many + "|": 8, "a " * 200: 2, "a a": 1,
             "é" * 10 + "A": 5, many.replace(" ", "\x0b"): 0, many.replace(" ", " "): 1, "a b a b a": 3, "a b a b": 1}
    for text, mask in rules.items():
        assert audit.own_failures(text.encode()) == mask, text[:20]


def plain_rows(rows, labels):
    out = []
    for d, text, lang, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        mask += 8 * bool(re.search(r"[#$%&*|]", t))
        mask += 16 * any(o is not None and d is not None and o < d and (x or "") == t for o, x, _, _ in rows)
        mine = [x for x in labels if x[0] == d and d is not None]
        out.append((d, lang or "", mask, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (5, 1, 1), (6, 0, 1), (6, 1, None), (None, 1, 1), (99, 1, 1), (9, None, None)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def test_hard_rows(make_docs, hard, labels):
    got = audit.failures(hard, labels[1])
    assert sorted(map(tuple, got.collect()), key=repr) == plain_rows(HARD, labels[0])
    copies = [(i, ["same", "other", None][i % 3], ["en", None][i % 2], "s") for i in range(40)] + [(None, "same", "en", "s")] * 2 + [(0, "same", "fr", "s")]
    got = audit.failures(make_docs(copies), labels[1])
    assert sorted(map(tuple, got.collect()), key=repr) == plain_rows(copies, labels[0])


def test_no_table_is_broadcast(spark, make_docs, tmp_path):
    """Labels and first ids are copied once per salt; files small enough to broadcast hold millions of them."""
    texts = [(i, f"text {i // 2}", "en", "s") for i in range(60)]
    given = [(i, i % 2, i % 3) for i in range(0, 90, 2)]
    spark.createDataFrame(given, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    got = audit.failures(make_docs(texts), spark.read.parquet(f"{tmp_path}/labels"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_rows(texts, given)
    counted = audit.interactions(audit.counts(got))
    assert counted.count() == 600
    for df in (got, counted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_audit_of_tables(spark, hard, empty, labels):
    rows = audit.interactions(audit.counts(audit.failures(hard, labels[1])))
    assert dict(rows.dtypes) == {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(audit.COLUMNS, "bigint")}
    found = rows.collect()
    assert len(found) == 600 * len({(r[2] or "") for r in HARD})
    plain = plain_rows(HARD, labels[0])
    for part in {r[1] for r in plain}:
        weights = {}
        for _, p, mask, good, toxic in plain:
            if p == part:
                old = weights.get(mask, (0, 0, 0))
                weights[mask] = (old[0] + 1, old[1] + good, old[2] + toxic)
        mine = {(r.filter_order, r.step): tuple(r)[3:9] for r in found if r.part == part}
        assert all(v == step_counts(weights, "ABCDE", *k) for k, v in mine.items()) and len(mine) == 600
    assert audit.interactions(audit.counts(audit.failures(empty, labels[1]))).count() == 0
