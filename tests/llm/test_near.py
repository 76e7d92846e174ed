from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import HARD, SMALL
from pyspark.sql import functions as F, types as T

from quirework.llm import graph, lattice, simhash
from quirework.llm.queries import op7_simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i: i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, ids, linked):
    """Smallest id that can be reached, by walking."""
    n, seen, out = len(marks), {}, [None] * len(marks)
    for i in range(n):
        if i in seen:
            continue
        group, todo = [], [i]
        seen[i] = True
        while todo:
            x = todo.pop()
            group.append(x)
            for y in range(n):
                if y not in seen and linked(marks[x], marks[y]):
                    seen[y] = True
                    todo.append(y)
        known = [ids[x] for x in group if ids[x] is not None]
        for x in group:
            out[x] = min(known, default=None)
    return out


def near(a, b):
    return bin(a ^ b).count("1") <= 4


def test_registered_simhash(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    marks = [plain_fingerprint(r.text) for r in rows]
    comp = plain_components(marks, [r.doc_id for r in rows], near)
    want = Counter((r.doc_id, f"{m:016x}", c) for r, m, c in zip(rows, marks, comp, strict=True))
    assert Counter(tuple(r) for r in op7_simhash(spark, SMALL).collect()) == want


def test_simhash_on_hard_rows(hard, empty):
    got = Counter((r.id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(hard).collect())
    marks = [plain_fingerprint(t) for _, t, *_ in HARD]
    comp = plain_components(marks, [r[0] for r in HARD], near)
    assert got == Counter((r[0], m, c) for r, m, c in zip(HARD, marks, comp, strict=True))
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_leaves_one_row_of_each_component(hard, empty):
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    marks = {i: plain_fingerprint(t) for i, t, *_ in HARD}
    comp = plain_components(list(marks.values()), list(marks), near)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, c in zip(marks, comp, strict=True) if i == c or c is None)
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize(("bands", "block"), [(5, 4096), (6, 4096), (8, 4096), (5, 40)])
def test_links_connect_what_pairs_connect(spark, bands, block):
    rng = random.Random(bands + block)
    marks = {rng.getrandbits(64) for _ in range(150)}
    for m in list(marks)[:40]:  # chains and tight clusters
        for _ in range(rng.randint(1, 12)):
            for _ in range(rng.randint(0, 4)):
                m ^= 1 << rng.randrange(64)
            marks.add(m)
    marks = [int(np.array(m, dtype="<u8").view("<i8")) for m in marks]
    fps = spark.createDataFrame([(m,) for m in marks], "fp long")
    links = simhash.links_between(fps, block=block, bands=bands)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    comp = plain_components(marks, marks, lambda a, b: bin((a ^ b) % 2**64).count("1") <= 4)
    assert [roots.get(m, m) for m in marks] == comp
    assert all(near(r.a % 2**64, r.b % 2**64) for r in links.collect())


def clusters(rng, n, size):
    out = []
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(size):
            m = centre
            for _ in range(rng.randint(0, 3)):
                m ^= 1 << rng.randrange(64)
            out.append(m)
    return np.array(out, dtype="<u8")


@pytest.mark.parametrize("seed", range(4))
def test_a_tree_prunes_and_loses_no_pair(seed):
    rng = random.Random(seed)
    fp = np.unique(clusters(rng, 40, 60))
    leaves = simhash.tree_leaves(fp)
    assert len(leaves) > 20 and sum(len(x) ** 2 for x in leaves) < 0.25 * len(fp) ** 2  # comparisons that are left
    together = {(a, b) for x in leaves for a in x.tolist() for b in x.tolist()}
    distance = np.bitwise_count(fp[:, None] ^ fp[None])
    assert all((a, b) in together for a, b in np.argwhere(distance <= simhash.RADIUS).tolist())


def test_pairs_across_a_boundary_are_found(monkeypatch):
    """Two linked points on either side of the root's boundary."""
    monkeypatch.setattr(simhash, "SPLIT", 4)
    monkeypatch.setattr(simhash, "SAVED", 1)
    monkeypatch.setattr(simhash, "VANTAGES", 1)
    fp = np.array([(1 << k) - 1 for k in range(0, 64, 2)], dtype="<u8")  # distances 0, 2, 4 ... from the first
    leaves = simhash.tree_leaves(fp)
    assert len(leaves) > 2 and sum(map(len, leaves)) > len(fp)  # points near a boundary are on both sides
    links = simhash.search_leaves(np.zeros(len(fp), dtype=int), fp, np.zeros(len(fp), dtype=int)).view("<u8")
    roots = {int(x): int(x) for x in fp}
    for a, b in links.tolist():
        old, new = roots[a], roots[b]
        roots = {k: new if v == old else v for k, v in roots.items()}
    assert len(set(roots.values())) == 1  # a chain of steps of two bits, over every boundary


def test_more_bands_for_more_fingerprints():
    assert simhash.bands_for(10**6) == 5
    counts = [simhash.bands_for(10**k) for k in range(3, 13)]
    assert counts == sorted(counts) and counts[-1] > 5
    for bands in (5, 6, 7):
        assert len(simhash.leaf_masks(bands)) == len(set(simhash.leaf_masks(bands)))


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    assert {r.root for r in graph.components(links).collect()} == {0}


def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("label", T.IntegerType()), T.StructField("uid", T.StringType())])
    return spark.createDataFrame([(*r, "x") for r in rows], schema)


def test_e8_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(scale=2, size=(500, 8))
    near_ = lattice.nearest_point(x)
    assert np.allclose(near_ * 2, np.rint(near_ * 2)) and np.allclose(near_.sum(1) % 2, 0)
    whole = np.isclose(near_, np.rint(near_)).all(1)
    half = np.isclose(near_ - 0.5, np.rint(near_ - 0.5)).all(1)
    assert (whole ^ half).all()
    short = lattice.minimal_vectors()
    assert len(np.unique(short, axis=0)) == 240 and np.allclose((short**2).sum(1), 2)
    gap = ((x - near_) ** 2).sum(1)
    for v in short:  # no neighbour is closer: the cell of E8 is bounded by its minimal vectors
        assert (((x - near_ - v) ** 2).sum(1) >= gap - 1e-9).all()


@pytest.mark.parametrize("block", [2048, 16])
def test_lattice_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 48))
    v = np.concatenate([centres] + [centres[:30] + rng.normal(scale=0.1, size=(30, 48)) for _ in range(12)])
    v = np.concatenate([v, v[:25]]).astype(np.float32)
    label = rng.integers(0, 2, len(v))
    rows = [(i, [float(x) for x in v[i]], int(label[i])) for i in range(len(v))]
    out = {r.vec_id: r for r in lattice.near_classes(vectors(spark, rows), block=block).collect()}
    unit = v.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    got = np.array([out[i].n_links for i in range(len(v))])
    assert (got <= link.sum(1)).all()  # none below the threshold
    assert got.sum() >= 0.97 * link.sum()
    comp = plain_components(list(range(len(v))), list(range(len(v))), lambda a, b: link[a, b])
    assert np.mean([out[i].component_id == comp[i] for i in range(len(v))]) > 0.97
    assert all(out[i].kept == (out[i].component_id == i) for i in range(len(v)))


def test_vectors_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, one, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [nan, 0.0, 1.0], 1),
            (7, [inf, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, one, 2), (10, [], 1), (11, [1.0, 0.0], 1), (None, one, 1),
            (12, [1e-30, 0.0, 0.0], 1), (13, [3e38, 0.0, 0.0], 1)]
    out = sorted((str(r.vec_id), r.n_links, r.component_id) for r in lattice.near_classes(vectors(spark, rows)).collect())
    linked = {"1", "2", "None", "12", "13"}
    assert out == sorted((str(i), 5 if str(i) in linked else 0, 1 if str(i) in linked else i) for i, *_ in rows)
    assert lattice.near_classes(vectors(spark, [])).count() == 0


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert sorted((r.vec_id, r.component_id) for r in lattice.near_classes(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    halves = df.withColumn("label", F.when(F.col("vec_id") < 3, 1.5).otherwise(1.0))
    assert sorted((r.vec_id, r.component_id) for r in lattice.near_classes(halves).collect()) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_hidden_hot_group_is_split(spark):
    """A third of all vectors at one lattice point meet in blocks, none of them whole."""
    from quirework.llm.common import meetings

    rows = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = meetings(rows, groups, ["key"], "v", 50)
    assert met.groupBy("key", "low", "high").count().agg(F.max("count")).first()[0] < 150
    pairs = met.alias("a").join(met.alias("b"), ["key", "low", "high"]).filter("a.v < b.v").select("a.v", "b.v").distinct()
    assert pairs.count() == 300 * 299 // 2


def test_rows_of_one_fingerprint_go_to_many_tasks(make_docs):
    docs = make_docs([(i, "the same text in every row of this table") for i in range(300)])
    found = simhash.near_duplicates(docs)
    assert "_salt" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert sorted(r.id for r in rows) == list(range(300)) and {r.component_id for r in rows} == {0}
